"""Cosine similarity between items described by unit vectors.

An index is a table ``(name, family, vector)`` with one row per item and vectors of length
one, so a dot product is the cosine. Whole-catalog work (all pairs, nearest neighbours) is
cut into pairs of blocks (see :mod:`.tiles`): every task holds blocks of bounded size, multiplies
them, and keeps only what the threshold or the k admits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.names import name_key
from ..functions.money import round_to
from ..functions.vector import same_length_dot, unit
from ..plans import joins
from ..plans.joins import lookup_join
from ..plans.scratch import kept
from . import tiles

BLOCK_MIN, BLOCK_MAX = 256, 16_384
# Scores that differ by less than this many decimals rank as ties (broken by name).
RANK_DECIMALS = 12


@dataclass(frozen=True)
class ItemIndex:
    """Item vectors; their number and size decide how they may be joined.

    Nothing runs when an index is made: rows and size are found by one aggregate, when an
    operator first needs them.
    """

    items: DataFrame

    @staticmethod
    def of(
        df: DataFrame, name: str = "name", vector: str = "vector", family: str = "family",
        missing: str = "refuse",
    ) -> ItemIndex:
        """Normalise the vectors.

        A NULL vector, or one with a NULL component, stops the job with the item's name; with
        ``missing="drop"`` such items are left out. Vectors of different lengths stop every
        operator that compares them. Items of one name are never neighbours of each other;
        ``quality_checks`` reports repeated names.
        """
        if missing not in ("refuse", "drop"):
            raise ValueError(f"missing must be 'refuse' or 'drop', not {missing!r}")
        columns = df.select(
            F.col(name).cast("string").alias("name"),
            F.col(family).cast("string").alias("family"),
            F.col(vector).cast("array<double>").alias("vector"),
        )
        whole = F.col("vector").isNotNull() & ~F.coalesce(F.exists("vector", F.isnull), F.lit(False))
        if missing == "drop":
            return ItemIndex(columns.where(whole).withColumn("vector", unit(F.col("vector"))))
        refused = F.raise_error(F.concat(F.lit("no whole vector for item "), F.coalesce("name", F.lit("NULL"))))
        checked = F.when(whole, F.col("vector")).otherwise(refused.cast("array<double>"))
        return ItemIndex(columns.withColumn("vector", checked).withColumn("vector", unit(F.col("vector"))))

    @cached_property
    def _measured(self) -> tuple[int, int, int]:
        text = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in ("name", "family")), F.lit(96))
        row = self.items.agg(
            F.count("*"), F.coalesce(F.sum((text + F.size("vector") * 8).cast("bigint")), F.lit(0)),
            F.coalesce(F.sum(text.cast("bigint")), F.lit(0)),
        ).first()
        return row[0], row[1], row[2]

    @property
    def rows(self) -> int:
        return self._measured[0]

    @property
    def size(self) -> int:
        return self._measured[1]

    @property
    def text_size(self) -> int:
        """Bytes of the table without its vectors."""
        return self._measured[2]


# -- whole-catalog scoring ---------------------------------------------------------------

_SCORED = "a string, b string, similarity double"


def _tiling(index: ItemIndex) -> tiles.Tiling:
    rows = min(BLOCK_MAX, max(BLOCK_MIN, -(-index.rows // 16)))
    return tiles.tiling(index.items, index.rows, rows)


def _same_name(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Which of ``a`` (rows) are of one name with which of ``b`` (columns)."""
    code = np.asarray(pa.concat_arrays([a, b]).dictionary_encode(null_encoding="encode").indices)
    return code[: len(a), None] == code[None, len(a) :]


def _found(a: pa.Array, b: pa.Array, i: np.ndarray, j: np.ndarray, scores: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([a.take(pa.array(i)), b.take(pa.array(j)), pa.array(scores)], ["a", "b", "similarity"])


def _named_in(index: ItemIndex, names: DataFrame) -> ItemIndex:
    """The items that ``names`` (one column) names. The vectors of all others are still checked."""
    seen = index.items.agg(F.min(F.size("vector")).alias("least"), F.max(F.size("vector")).alias("most")).first()
    if seen.least != seen.most:
        raise ValueError(f"item vectors differ in length: {seen.least} to {seen.most}")
    wanted = names.select(F.col(names.columns[0]).cast("string").alias("name")).distinct()
    return ItemIndex(lookup_join(index.items, wanted, ["name"], "left_semi"))


def similarity_pairs(index: ItemIndex, threshold: float = 0.6, among: DataFrame | None = None) -> DataFrame:
    """All ordered pairs of different items with cosine >= threshold: (a, b, similarity).

    Tiles that hold nothing within the threshold's angle of an item are not visited; of two tiles
    one visits the other. Scores are compared rounded, so a pair on the threshold does not depend on
    the shape of its tile. ``among``, a table of one column, leaves the pairs of which it names both items,
    without making the others: what a question about those items can use.
    """
    if among is not None:
        index = _named_in(index, among)
    angle = float(np.arccos(np.clip(threshold - 1e-9, -1.0, 1.0))) if threshold > 0 else np.pi

    def score(names, here, home, visiting, there) -> Iterator[pa.RecordBatch]:
        scores = there @ here.T
        # Only what rounding may lift to the threshold is rounded.
        i, j = np.divmod(np.flatnonzero(scores >= threshold - 10.0 ** (1 - RANK_DECIMALS)), len(here))
        hit = (np.round(scores[i, j], RANK_DECIMALS) >= threshold) & ~_same_name(visiting, names)[i, j]
        i, j = i[hit], j[hit]
        yield _found(visiting, names, i, j, scores[i, j])
        away = ~home[i]
        i, j = i[away], j[away]
        if len(i):
            yield _found(names, visiting, j, i, scores[i, j])

    return tiles.against_tiles(
        index.items, _tiling(index), None,
        lambda names, here, visiting, there: np.full(len(there), angle), True, score, _SCORED,
    )


def _kth_at_least(scores: np.ndarray, k: int) -> np.ndarray:
    """What ``k`` scores of each row, of at least ``k``, reach: the k-th best of the bests of groups of columns."""
    wide = scores.shape[1]
    each = min(32, wide // k)
    groups = scores[:, : wide // each * each].reshape(len(scores), each, wide // each).max(axis=1)
    return np.partition(groups, wide // each - k, axis=1)[:, wide // each - k]


def _best(scores: np.ndarray, same: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the ``k`` best columns of each row, without those marked ``same``; of equals the first.

    The k-th best of the bests of groups of columns bounds what is rounded and ordered, with what may be
    a tie of it after rounding: columns are in name order, so the first equals are the first by name.
    """
    wide = scores.shape[1]
    if wide <= k:
        return np.nonzero(~same)
    if same.any():
        scores = np.where(same, -np.inf, scores)
    bound = _kth_at_least(scores, k)[:, None] - 10.0 ** (1 - RANK_DECIMALS)
    i, j = np.divmod(np.flatnonzero(scores >= bound), wide)
    other = ~same[i, j]
    i, j = i[other], j[other]
    order = np.lexsort((j, -np.round(scores[i, j], RANK_DECIMALS), i))
    i, j = i[order], j[order]
    place = np.arange(len(i)) - np.searchsorted(i, i)
    return i[place < k], j[place < k]


def _best_of_found(found: pa.Table, k: int) -> pa.Table:
    """The rows of ``found`` that may be among the ``k`` best of their ``a``: ties of the k-th stay, to be ranked by name."""
    a = found.column("a").combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
    scores = found.column("similarity").to_numpy()
    order = np.lexsort((-scores, a))
    first = np.searchsorted(a[order], np.arange(len(np.unique(a)) + 1))
    last = np.minimum(first[:-1] + k, first[1:]) - 1
    return found.filter(pa.array(scores >= scores[order][last][a] - 10.0 ** (1 - RANK_DECIMALS)))


def nearest_neighbours(index: ItemIndex, k: int = 10) -> DataFrame:
    """The ``k`` >= 1 most similar other items of every item, ties by name.

    A score that ``k`` others reach in an item's own tile bounds the angle within which it has to look, so it visits
    only tiles that may hold something as good. A task hands on the ``k`` best it finds for an item, and ties of the last.
    """

    def within(names, here, visiting, there) -> np.ndarray:
        # A zero vector scores 0 with everything, wherever it is: its cell is never ruled out.
        angle = np.full(len(there), np.pi)
        if len(here) <= k:
            return angle
        many = max(1, tiles.SCORES // len(here))
        for start in range(0, len(there), many):
            same = _same_name(visiting.slice(start, many), names)
            kth = _kth_at_least(np.where(same, -np.inf, there[start : start + many] @ here.T), k)
            angle[start : start + many] = np.where(np.isinf(kth), np.pi, np.arccos(np.clip(kth - 1e-9, -1.0, 1.0)))
        return angle

    def score(names, here, home, visiting, there) -> Iterator[pa.RecordBatch]:
        scores = there @ here.T
        i, j = _best(scores, _same_name(visiting, names), k)
        yield _found(visiting, names, i, j, scores[i, j])

    by_score = Window.partitionBy("a").orderBy(
        F.desc(F.round("similarity", RANK_DECIMALS)), "b"
    )
    return (
        tiles.against_tiles(index.items, _tiling(index), lambda found: _best_of_found(found, k), within, False, score, _SCORED)
        .withColumn("rank", F.row_number().over(by_score))
        .filter(F.col("rank") <= k)
    )


def neighbour_lists(index: ItemIndex, k: int = 10) -> DataFrame:
    """(name, family, neighbours array<struct<name, similarity, family>>), best first."""
    family = index.items.select(F.col("name").alias("b"), F.col("family").alias("b_family"))
    nearest = nearest_neighbours(index, k)
    if index.text_size > joins.BROADCAST_BYTES:
        # The join will count keys first: from a table, not by finding all neighbours again.
        nearest = kept(nearest, "neighbours")
    entry = F.struct(
        "rank",
        F.col("b").alias("name"),
        round_to("similarity", 4).alias("similarity"),
        F.col("b_family").alias("family"),
    )
    lists = (
        lookup_join(nearest, family, ["b"], size=index.text_size)
        .groupBy(F.col("a").alias("name"))
        .agg(F.array_sort(F.collect_list(entry)).alias("ranked"))
        .select(
            "name",
            F.transform(
                "ranked",
                lambda e: F.struct(
                    e["name"].alias("name"), e["similarity"].alias("similarity"), e["family"].alias("family")
                ),
            ).alias("neighbours"),
        )
    )
    empty = F.array().cast(lists.schema["neighbours"].dataType)
    return (
        index.items.select("name", "family")
        .join(lists, "name", "left")
        .withColumn("neighbours", F.coalesce("neighbours", empty))
    )


# -- one item ----------------------------------------------------------------------------


def _lookup(index: ItemIndex, item: str) -> DataFrame:
    """The single index row an item name stands for: the exact name if there is one, else
    the one with the same matching key."""
    exact = F.col("name") == F.lit(item)
    return (
        index.items.filter(exact | (F.lower("name") == name_key(F.lit(item))))
        .orderBy(F.desc(exact), "name")
        .limit(1)
    )


def _scored(index: ItemIndex, item: str) -> DataFrame:
    """All other items as (name, family, score) against one item.

    Its name and vector enter as one scalar subquery: no join, no job ahead. An unknown item
    has neither and gives no rows.
    """
    target = _lookup(index, item).select(F.struct("name", "vector")).scalar()
    return (
        index.items.withColumn("target", target)
        .filter(F.col("name") != F.col("target.name"))
        .select("name", "family", F.round(same_length_dot(F.col("vector"), F.col("target.vector"), F.col("name")),
                                          RANK_DECIMALS).alias("score"))
    )


def find_similar(
    index: ItemIndex, item: str, top_n: int = 5, threshold: float = 0.0
) -> DataFrame:
    """Ranked (name, similarity, family) of the items most like one item."""
    return (
        _scored(index, item)
        .filter(F.col("score") >= threshold)
        .orderBy(F.desc(F.round("score", RANK_DECIMALS)), "name")
        .limit(top_n)
        .select("name", round_to("score", 4).alias("similarity"), "family")
    )


def find_similar_checked(
    index: ItemIndex, item: str, top_n: int = 5, threshold: float = 0.4
) -> DataFrame:
    """One row that says whether anything qualified, and why not if nothing did."""
    entry = F.struct(
        (-F.col("similarity")).alias("sort"), "name", "similarity", "family"
    )
    found = find_similar(index, item, top_n, threshold).agg(
        F.array_sort(F.collect_list(entry)).alias("found")
    )
    qualifies = F.size("found") > 0
    return found.select(
        F.lit(item).alias("query_item"),
        F.lit(float(threshold)).alias("similarity_threshold"),
        qualifies.alias("qualifying_above_threshold"),
        F.when(
            ~qualifies,
            F.lit(
                f"nothing reaches the similarity threshold {threshold} for {item!r}; "
                "weaker neighbours are not offered as similar"
            ),
        ).alias("reason"),
        F.transform(
            "found",
            lambda e: F.struct(
                e["name"].alias("name"), e["similarity"].alias("similarity"), e["family"].alias("family")
            ),
        ).alias("similar"),
    )


def similar_set(index: ItemIndex, item: str, threshold: float = 0.6) -> DataFrame:
    """Names at or above the threshold, without a cap on their number."""
    return _scored(index, item).filter(F.col("score") >= threshold).select("name")


def pair_similarity(pairs: DataFrame, index: ItemIndex, a: str = "a", b: str = "b") -> DataFrame:
    """Add the cosine of two named items; 0.0 where a name is unknown. Each row of ``pairs`` stays one
    row: of a name's several vectors the smallest (by components, in order) counts."""
    named = index.items.groupBy("name").agg(F.min("vector").alias("vector"))

    def vectors(name: str, vector: str) -> DataFrame:
        return named.select(F.col("name").alias(name), F.col("vector").alias(vector))

    both = lookup_join(
        lookup_join(pairs, vectors(a, "__va"), [a], "left", size=index.size),
        vectors(b, "__vb"), [b], "left", size=index.size,
    )
    score = F.coalesce(same_length_dot(F.col("__va"), F.col("__vb"), F.col(a)), F.lit(0.0))
    return both.select(*pairs.columns, score.alias("similarity"))


def embedding_stats(index: ItemIndex) -> DataFrame:
    """Items, dimension, families and the mean of the full similarity matrix.

    For unit vectors the mean over all N x N cosines is the squared length of the vector
    sum divided by N squared, so one pass over the components replaces the matrix.
    """
    total = (
        index.items.select(F.posexplode("vector").alias("pos", "x"))
        .groupBy("pos")
        .agg(F.sum("x").alias("s"))
        .agg(F.sum(F.col("s") * F.col("s")).alias("squared"))
        .scalar()
    )
    return (
        index.items.agg(
            F.count("*").alias("total_items"),
            F.max(F.size("vector")).cast("bigint").alias("embedding_dim"),
            F.min(F.size("vector")).cast("bigint").alias("__least"),
            F.array_sort(F.collect_set("family")).alias("families"),
        )
        .withColumn(
            "embedding_dim",
            F.when(F.coalesce(F.col("embedding_dim") == F.col("__least"), F.lit(True)), F.col("embedding_dim"))
            .otherwise(F.raise_error(F.lit("item vectors differ in length")).cast("bigint")),
        )
        .drop("__least")
        .withColumn(
            "avg_similarity",
            F.coalesce(
                total / F.when(F.col("total_items") > 0, F.col("total_items") * F.col("total_items")),
                F.lit(0.0),
            ),
        )
    )


# -- vectors from text -------------------------------------------------------------------


@dataclass(frozen=True)
class TextEncoder:
    """Text to unit vector by hashed TF-IDF, fitted once and applied to any text.

    ``features`` fixes the dimension, so the fitted model is one weight per dimension
    however large the corpus. A sentence model takes its place as any function from a text
    column to an ``array<double>`` column, for example one made by :func:`batch_encoder`.
    """

    model: object

    @staticmethod
    def fit(df: DataFrame, text_col: str, features: int = 384) -> TextEncoder:
        from pyspark.ml import Pipeline
        from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer

        stages = [
            RegexTokenizer(inputCol="__text", outputCol="__words", pattern=r"\p{L}+", gaps=False),
            HashingTF(inputCol="__words", outputCol="__tf", numFeatures=features),
            IDF(inputCol="__tf", outputCol="__tfidf"),
            Normalizer(inputCol="__tfidf", outputCol="__unit"),
        ]
        text = F.coalesce(F.col(text_col), F.lit("")).alias("__text")
        return TextEncoder(Pipeline(stages=stages).fit(df.select(text)))

    def embed(self, df: DataFrame, text_col: str, vector_col: str = "vector") -> DataFrame:
        from pyspark.ml.functions import vector_to_array

        ready = df.withColumn("__text", F.coalesce(F.col(text_col), F.lit("")))
        return (
            self.model.transform(ready)
            .withColumn(vector_col, vector_to_array("__unit"))
            .drop("__text", "__words", "__tf", "__tfidf", "__unit")
        )


@dataclass(frozen=True)
class VocabularyEncoder:
    """Text to unit vector by TF-IDF over a fitted vocabulary: one dimension a term, no collisions.

    The vocabulary is the ``size`` terms (runs of letters, lower case) that most texts have, ties by term,
    so that its size bounds the model and the vectors however large the corpus.
    """

    model: object
    terms: tuple[str, ...]

    @staticmethod
    def fit(df: DataFrame, text_col: str, size: int = 1024) -> VocabularyEncoder:
        from pyspark.ml import PipelineModel
        from pyspark.ml.feature import IDF, CountVectorizerModel, Normalizer, RegexTokenizer

        words = RegexTokenizer(inputCol="__text", outputCol="__words", pattern=r"\p{L}+", gaps=False)
        cut = words.transform(df.select(F.coalesce(F.col(text_col), F.lit("")).alias("__text")))
        held = cut.select(F.explode(F.array_distinct("__words")).alias("term")).groupBy("term").count()
        top = held.orderBy(F.desc("count"), "term").limit(size).collect()
        terms = tuple(r.term for r in top)
        if not terms:
            raise ValueError("no text has a word: there is no vocabulary to fit")
        counts = CountVectorizerModel.from_vocabulary(list(terms), inputCol="__words", outputCol="__tf")
        weights = IDF(inputCol="__tf", outputCol="__tfidf").fit(counts.transform(cut))
        unit_ = Normalizer(inputCol="__tfidf", outputCol="__unit")
        return VocabularyEncoder(PipelineModel([words, counts, weights, unit_]), terms)

    def _unit(self, df: DataFrame, text_col: str) -> DataFrame:
        ready = df.withColumn("__text", F.coalesce(F.col(text_col), F.lit("")))
        return self.model.transform(ready).drop("__text", "__words", "__tf", "__tfidf")

    def embed(self, df: DataFrame, text_col: str, vector_col: str = "vector") -> DataFrame:
        from pyspark.ml.functions import vector_to_array

        return self._unit(df, text_col).withColumn(vector_col, vector_to_array("__unit")).drop("__unit")

    def weights(self, df: DataFrame, text_col: str, out: str = "weights") -> DataFrame:
        """Add the vector as an array of (term, weight), most common terms first, zeros left out."""
        names = F.array(*[F.lit(t) for t in self.terms])
        sparse = F.unwrap_udt("__unit")
        entries = F.zip_with(
            sparse["indices"], sparse["values"],
            lambda i, w: F.struct(F.get(F.col("__terms"), i).alias("term"), w.alias("weight")),
        )
        both = self._unit(df, text_col).withColumn("__terms", names)
        return both.withColumn(out, F.filter(entries, lambda e: e["weight"] != 0)).drop("__unit", "__terms")


def batch_encoder(
    make_model: Callable[[], Callable[[np.ndarray], np.ndarray]], batch_size: int = 256
) -> Callable[[Column], Column]:
    """An encoder that runs a model on batches of texts.

    ``make_model`` is called once per Python worker and loads the model; what it returns takes an array of
    texts and returns one row of numbers for each. NULL is the empty text.
    """
    from pyspark.ml.functions import predict_batch_udf
    from pyspark.sql import types as T

    udf = predict_batch_udf(make_model, return_type=T.ArrayType(T.DoubleType()), batch_size=batch_size)
    return lambda text: udf(F.coalesce(text, F.lit("")))


def embed_profiles(
    df: DataFrame,
    text_col: str,
    encoder: TextEncoder | VocabularyEncoder | Callable[[Column], Column] | None = None,
    vector_col: str = "vector",
) -> DataFrame:
    """Add the vector of a profile text. Profiles are embedded, never the item names."""
    if encoder is None:
        encoder = TextEncoder.fit(df, text_col)
    if isinstance(encoder, (TextEncoder, VocabularyEncoder)):
        return encoder.embed(df, text_col, vector_col)
    # Two steps: a Python encoder may not stand inside the functions that normalise.
    return df.withColumn(vector_col, encoder(F.col(text_col))).withColumn(vector_col, unit(F.col(vector_col)))


def embed_custom(df: DataFrame, text_col: str, encoder: TextEncoder | VocabularyEncoder) -> DataFrame:
    """Vectors of texts outside the index, in the index's own space."""
    return embed_profiles(df, text_col, encoder)
