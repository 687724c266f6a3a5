"""Near-duplicate documents by MinHash.

1. Per document: the set of distinct five-word shingles, as 64-bit hashes; the smallest value of
   each of 384 universal hash functions over it; 64 band keys of 6 minima each.
2. Documents with equal sets are one class from the start, named by its smallest doc_id.
3. Classes that share a band key are candidates. First every class is paired only with the hub
   of each of its buckets, the one that shares most with others. Candidates whose signatures
   agree enough are confirmed on their full sets, and the links give components.
4. Within a component nothing more can be learnt. What is left are pairs that share a bucket
   but no component, and all of those are dealt with in a second turn: the documents' shingles are
   counted by how many of these documents hold them, and a pair whose counts cannot add up to a
   link is no link; every other one is checked. So no bucket is paired out, and no pair of
   candidates of different components stays open.
5. Components by alternating large-star and small-star.

A pair at the threshold of 0.75 shares none of the 64 bands with a probability of
(1 - 0.75^6)^64 = 4e-6, and falls below the bar of the signatures, six deviations under its
expectation, with 1e-9; above the threshold both fall fast.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from purchaselens.llm.common import checked_join, counted_join, map_texts, stored
from purchaselens.llm.components import components

SHINGLE = 5
BANDS, ROWS = 64, 6
HASHES = BANDS * ROWS
#: A pair is a link if 100 * common >= PERCENT * all.
PERCENT = 75
#: Signature bytes that must agree for a pair to be confirmed on its sets: the expectation at
#: the threshold less six deviations.
AGREE = int(HASHES * 0.75 - 6 * (HASHES * 0.75 * 0.25) ** 0.5)

_MIX1, _MIX2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit (fixed constants of a public finaliser)."""
    x = (x ^ (x >> np.uint64(33))) * _MIX1
    x = (x ^ (x >> np.uint64(33))) * _MIX2
    return x ^ (x >> np.uint64(33))


_BYTES = _mix(np.arange(1, 257, dtype=np.uint64) * _BASE)
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_rng = np.random.default_rng(20)
_A = (_rng.integers(0, 2**32, HASHES, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_B = _rng.integers(0, 2**32, HASHES, dtype=np.uint64).astype(np.uint32)


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def word_hashes(raw: bytes) -> np.ndarray:
    """A 64-bit hash of each word of a text, in order: A-Z folded, words between white space.

    The letters of a word weigh in with a power of their place in it."""
    data = _FOLD[np.frombuffer(raw, np.uint8)]
    if not len(data):
        return np.zeros(0, np.uint64)
    inside = ~_SPACE[data]
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    data, inside = data[starts[0] : ends[-1]], inside[starts[0] : ends[-1]]
    starts = starts - starts[0]
    # Blanks after a word count on from its start, but weigh nothing.
    place = np.arange(len(data)) - np.repeat(starts, np.diff(starts, append=len(data)))
    weights = _powers(int(lengths.max()))
    values = np.where(inside, _BYTES[data] * weights[np.minimum(place, len(weights) - 1)], np.uint64(0))
    return _mix(np.add.reduceat(values, starts) + lengths.astype(np.uint64))


def shingles(text: str | None) -> np.ndarray:
    """The sorted, distinct shingle hashes of a text: runs of five words, or all words if fewer."""
    words = word_hashes((text or "").encode())
    if not len(words):
        return words
    size = min(SHINGLE, len(words))
    mixed = np.zeros(len(words) - size + 1, np.uint64)
    for k in range(size):
        mixed = mixed * _MIX1 + words[k : len(words) - size + 1 + k]
    return np.unique(_mix(mixed + np.uint64(size)))


def signature(hashes: np.ndarray) -> np.ndarray:
    """The smallest value of every hash function over a set that is not empty."""
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    low = np.full(HASHES, 2**32 - 1, np.uint32)
    for start in range(0, len(x), 512):
        block = x[start : start + 512, None] * _A
        block += _B
        np.minimum(low, block.min(axis=0), out=low)
    return low


def _digest(hashes: np.ndarray) -> tuple[int, int]:
    """Two 64-bit sums over the set."""
    with np.errstate(over="ignore"):
        a, b = _mix(hashes + _BASE).sum(), _mix(hashes ^ _MIX2).sum()
    return int(a.astype(np.int64)), int(b.astype(np.int64))


def signatures(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, set_1, set_2, bands, sketch): per document its set's size and
    digest, the band keys, and one byte of each minimum."""
    bands = np.arange(1, BANDS + 1, dtype=np.uint64) * _BASE

    def make():
        def work(texts: list[str | None]) -> list[list]:
            out: list[list] = [[] for _ in range(5)]
            for t in texts:
                hashes = shingles(t)
                row = (len(hashes), *_digest(hashes), None, None)
                if len(hashes):
                    low = signature(hashes)
                    keys = bands.copy()
                    for k in range(ROWS):
                        keys = _mix(keys * _MIX1 + low.reshape(BANDS, ROWS)[:, k])
                    row = (*row[:3], keys.astype(np.int64).tolist(), low.astype(np.uint8).tobytes())
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            return out

        return work

    fields = [
        T.StructField("n_shingles", T.LongType()), T.StructField("set_1", T.LongType()),
        T.StructField("set_2", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType())),
        T.StructField("sketch", T.BinaryType()),
    ]
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return map_texts(rows, "text", fields, make, keep_text=False)


@F.pandas_udf(T.IntegerType())
def _agreeing(a: pd.Series, b: pd.Series) -> pd.Series:
    left, right = (np.frombuffer(b"".join(s), np.uint8).reshape(-1, HASHES) for s in (a, b))
    return pd.Series((left == right).sum(axis=1).astype(np.int32))


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (a, b, text_a, text_b) the pairs whose full sets make a link; one pair of texts at a
    time, and the sets of the last few texts are kept: a hub stands in many pairs."""
    sets = lru_cache(maxsize=8)(shingles)

    def one(x: str | None, y: str | None) -> bool:
        left, right = sets(x), sets(y)
        common = len(np.intersect1d(left, right, assume_unique=True))
        return 100 * common >= PERCENT * (len(left) + len(right) - common)

    for batch in batches:
        a, b = batch.column("text_a"), batch.column("text_b")
        linked = pa.array([one(a[i].as_py(), b[i].as_py()) for i in range(len(batch))], pa.bool_())
        yield batch.select(["a", "b"]).filter(linked)


def _confirmed(pairs: DataFrame, classes: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) that are links: signatures first, then full sets of what remains."""
    sizes = classes.select("doc_id", "n_shingles", "sketch")
    for side in ("a", "b"):
        pairs = pairs.join(
            sizes.toDF(side, f"n_{side}", f"sketch_{side}"), side
        )
    likely = stored(
        pairs.where(
            (F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * PERCENT)
        ).where(_agreeing("sketch_a", "sketch_b") >= AGREE).select("a", "b"),
        "likely-pairs",
    )
    ids = likely.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    needed = checked_join(texts, ids, "doc_id", "left_semi")
    both = likely.join(needed.toDF("a", "text_a"), "a").join(needed.toDF("b", "text_b"), "b")
    return stored(both.select("a", "b", "text_a", "text_b").mapInArrow(_linked, "a bigint, b bigint"), "links")


#: Ends of the classes of shingles, by how many open documents hold one; one document's own
#: shingles are shared with nobody.
_HELD = (3, 10, 100)
_SHARED = ("held_3", "held_10", "held_100", "held_more")


def _profiles(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, n, texts, held_...): per document its shingles, and how many of them 2 to 3, up
    to 10, up to 100 and more of the documents ``ids`` hold. Rows that repeat an id and a set
    count once; the numbers of an id with several ``texts`` are sums over these."""

    def make():
        return lambda values: [[shingles(t).astype(np.int64).tolist() for t in values]]

    field = T.StructField("shingles", T.ArrayType(T.LongType()))
    sets = map_texts(checked_join(texts, ids, "doc_id", "left_semi"), "text", [field], make, keep_text=False)
    sets = stored(sets, "open-sets")
    again = stored(sets.groupBy("doc_id").count().where("count > 1").select("doc_id"), "open-repeats")
    if not again.isEmpty():
        once = checked_join(sets, again, "doc_id", "left_semi").dropDuplicates(["doc_id", "shingles"])
        sets = stored(checked_join(sets, again, "doc_id", "left_anti").unionByName(once), "open-sets-once")
    rows = sets.select("doc_id", F.explode("shingles").alias("shingle"))
    rare = stored(
        rows.groupBy("shingle").agg(F.count("*").alias("held")).where(F.col("held") <= _HELD[-1]), "rare-shingles"
    )
    counts, low = [F.sum(F.when(F.col("held") == 1, 1).otherwise(0)).alias("own")], 1
    for name, high in zip(_SHARED, _HELD, strict=False):
        counts.append(F.sum(F.when(F.col("held").between(low + 1, high), 1).otherwise(0)).alias(name))
        low = high
    found = rows.join(rare, "shingle").groupBy("doc_id").agg(*counts)
    sizes = sets.where(F.size("shingles") > 0).groupBy("doc_id").agg(
        F.sum(F.size("shingles")).alias("n"), F.count("*").alias("texts")
    )
    filled = {c: F.coalesce(c, F.lit(0)) for c in ("own", *_SHARED[:-1])}
    all_ = sizes.join(found, "doc_id", "left").withColumns(filled)
    rest = F.col("n") - sum((F.col(c) for c in _SHARED[:-1]), F.col("own"))
    return all_.select("doc_id", "n", "texts", *_SHARED[:-1], rest.alias("held_more"))


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): one row per row of ``docs``.

    Texts without words (NULL, empty, white space) have an empty set and no links; each is a
    component of its own. A row with a NULL doc_id counts its shingles, links to nothing, has
    no component and is kept. Rows that repeat a doc_id each take the component of their text's
    class. An empty table gives an empty result. Other columns are not read.
    """
    own = stored(signatures(docs, doc_id=doc_id, text=text), "signatures")
    linkable = own.where("doc_id IS NOT NULL AND n_shingles > 0")
    firsts = stored(
        linkable.groupBy("set_1", "set_2", "n_shingles").agg(F.min("doc_id").alias("class")), "class-names"
    )
    members = stored(
        linkable.select("doc_id", "n_shingles", "set_1", "set_2")
        .join(firsts, ["set_1", "set_2", "n_shingles"]).select("doc_id", "n_shingles", "class"),
        "classes",
    )
    classes = checked_join(
        linkable, firsts.select(F.col("class").alias("doc_id")).distinct(), "doc_id", "left_semi"
    )
    texts = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))

    keys = classes.select(F.explode("bands").alias("band"), "doc_id")
    shared = stored(
        keys.groupBy("band").agg(
            F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("n")
        ).where("first < last").select("band", "n"),
        "shared-bands",
    )
    buckets = stored(counted_join(keys, shared, "band"), "buckets")
    weights = buckets.groupBy("doc_id").agg(F.sum("n").alias("weight"))
    hubs = stored(
        buckets.select("band", "doc_id").join(weights, "doc_id").groupBy("band")
        .agg(F.max_by("doc_id", "weight").alias("hub"), F.count("*").alias("n")),
        "hubs",
    )
    tried = stored(
        counted_join(buckets.select("band", "doc_id"), hubs, "band").where("doc_id <> hub")
        .select(F.least("hub", "doc_id").alias("a"), F.greatest("hub", "doc_id").alias("b")).distinct(),
        "hub-pairs",
    )
    links = _confirmed(tried, classes, texts)
    found = components(links)

    # Second turn: buckets that still hold more than one component.
    labelled = buckets.select("band", "doc_id").join(
        found.toDF("doc_id", "component"), "doc_id", "left"
    ).withColumn("component", F.coalesce("component", "doc_id"))
    labelled = stored(labelled, "labelled-buckets")
    mixed = stored(
        labelled.groupBy("band").agg(
            F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("n")
        ).where("low < high").select("band", "n"),
        "mixed-bands",
    )
    left = stored(counted_join(labelled, mixed, "band").drop("n"), "open-buckets")
    known = _profiles(texts, left.select("doc_id").distinct())
    left = stored(left.join(known, "doc_id"), "open-profiles")
    # What the two can share at most, class by class, must be enough for a link. That says
    # nothing of an id with several texts: it is never ruled out.
    most = sum((F.least(f"x.{c}", f"y.{c}") for c in _SHARED), F.lit(0))
    enough = (100 + PERCENT) * most >= PERCENT * (F.col("x.n") + F.col("y.n"))
    others = left.alias("x").join(
        left.alias("y"),
        (F.col("x.band") == F.col("y.band")) & (F.col("x.component") < F.col("y.component"))
        & (enough | (F.col("x.texts") > 1) | (F.col("y.texts") > 1)),
    ).select(
        F.least("x.doc_id", "y.doc_id").alias("a"), F.greatest("x.doc_id", "y.doc_id").alias("b")
    ).distinct().join(tried, ["a", "b"], "left_anti")
    links = links.union(_confirmed(others, classes, texts))
    found = stored(components(links), "components")

    named = members.join(found.toDF("class", "component"), "class", "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "class").alias("component_id")
    )
    alone = own.where("doc_id IS NULL OR n_shingles = 0").select(
        "doc_id", "n_shingles", F.col("doc_id").alias("component_id")
    )
    return named.unionByName(alone).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    )


def without_copies(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of each group: the one of the smallest doc_id.

    A row without an id is in no group and stays; of rows that repeat id and text one stays."""
    found = near_duplicates(docs, doc_id=doc_id, text=text)
    gone = stored(found.where("NOT kept").select(F.col("doc_id").alias(doc_id)).distinct(), "near-copies")
    left = checked_join(docs, gone, doc_id, "left_anti")
    again = stored(
        docs.where(F.col(doc_id).isNotNull()).groupBy(doc_id).count().where("count > 1").select(doc_id),
        "repeated-ids",
    )
    if again.isEmpty():
        return left
    once = checked_join(left, again, doc_id, "left_semi").dropDuplicates([doc_id, text])
    return checked_join(left, again, doc_id, "left_anti").unionByName(once)
