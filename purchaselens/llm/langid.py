"""Language identification by nearest centroid.

A text is the TF-IDF vector, of length one, of its hashed letter bi- and trigrams. Document
frequencies are counted over all training documents. Each language has several centroids: spherical
k-means on a bounded sample of its training documents finds its kinds of text. The nearest
centroid by cosine names the language. A text farther from it than texts of its length ever are
is rejected.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from purchaselens.llm.common import map_texts

DIMENSIONS = 4096
#: Distinct training texts per language that the centroids are fitted on, at most; the draw is by
#: a hash of the text. Counts and frequencies use all rows.
SAMPLE = 1500
CENTROIDS = 4
ROUNDS = 12
#: A text is rejected below this share of the similarity that a hundredth of the sample of
#: its length stays below.
SLACK = 0.5
#: Ends of the length classes, in n-grams.
LENGTHS = (20, 50, 100, 200, 500, 1000, 3000)
UNKNOWN = "und"

_LETTER = re.compile(r"[^\W\d_]")
#: Bytes of letters: ASCII letters folded, everything beyond ASCII as it is, the rest a blank.
_FOLD = np.array(
    [c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256)], np.uint32
)
_M2, _M3 = np.uint32(2654435761), np.uint32(2246822519)  # odd multipliers


def grams(text: str) -> np.ndarray:
    """Counts of the hashed bi- and trigrams of a text; runs of blanks are one blank."""
    b = _FOLD[np.frombuffer(b" " + text.lower().encode() + b" ", np.uint8)]
    b = b[np.append(True, (b[1:] != 32) | (b[:-1] != 32))]
    if len(b) < 3:
        return np.zeros(DIMENSIONS, np.int64)
    two = b[:-1] << np.uint32(8) | b[1:]
    shift = np.uint32(32 - DIMENSIONS.bit_length() + 1)
    hashed = np.append(two * _M2 >> shift, (two[:-1] << np.uint32(8) | b[2:]) * _M3 >> shift)
    return np.bincount(hashed, minlength=DIMENSIONS)


def _unit(v: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(v, axis=-1, keepdims=True)
    return np.divide(v, norm, out=np.zeros_like(v), where=norm > 0)


def _vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return _unit(np.sqrt(counts, dtype=np.float32) * idf.astype(np.float32))


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray  # one row each
    owner: np.ndarray  # the language of each
    floors: np.ndarray  # similarity per language and length class below which a text is rejected

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        """(language, similarity, rejected) of each text."""
        out = [(UNKNOWN, 0.0, True)] * len(texts)
        known = [i for i, t in enumerate(texts) if t and _LETTER.search(t)]
        for start in range(0, len(known) if self.languages else 0, 256):
            part = known[start : start + 256]
            counts = np.stack([grams(texts[i]) for i in part])
            close = _vectors(counts, self.idf) @ self.centroids.T
            best = close.argmax(axis=1)
            band = np.searchsorted(LENGTHS, counts.sum(axis=1), side="right")
            for k, i in enumerate(part):
                at, own = best[k], self.owner[best[k]]
                score = min(1.0, max(0.0, float(close[k, at])))
                out[i] = (self.languages[own], score, score < self.floors[own, band[k]])
        return out


def _cluster(vectors: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means, started from texts far from each other."""
    centers = [_unit(vectors.sum(axis=0))]
    for _ in range(min(k, len(vectors)) - 1):
        centers.append(vectors[np.max(vectors @ np.array(centers).T, axis=1).argmin()])
    centers = np.array(centers)
    for _ in range(ROUNDS):
        near = (vectors @ centers.T).argmax(axis=1)
        sums = np.array([vectors[near == c].sum(axis=0) for c in range(len(centers))])
        used = np.array([(near == c).any() for c in range(len(centers))])
        centers = _unit(sums[used])
    return centers


def train(docs: DataFrame, *, text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> Model:
    """Fit on every row with a text and a language; rows lacking either are left out.

    Without any such row the model knows no language and answers ``und``. The driver holds one
    number per dimension and the sample of at most ``sample`` distinct texts per language.
    """
    rows = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(
        F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")
    )

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(DIMENSIONS, np.int64), 0
        for batch in batches:
            for value in batch.column(0):
                total += grams(value.as_py()) > 0
                n += 1
        # One more entry, -1, is the number of documents.
        yield pa.RecordBatch.from_arrays(
            [pa.array([-1, *range(DIMENSIONS)], pa.int32()), pa.array([n, *total.tolist()], pa.int64())],
            ["gram", "n"],
        )

    found = rows.select("text").mapInArrow(frequencies, "gram int, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))
    counted = {r.gram: r.n for r in found.collect()}
    n = counted.pop(-1, 0)
    df = np.array([counted.get(g, 0) for g in range(DIMENSIONS)], float)
    idf = np.log((1 + n) / (1 + df)) + 0.1

    keyed = rows.select("*", F.xxhash64("text", F.lit(3)).alias("draw"), F.xxhash64("text").alias("other"))
    sizes = {r.lang: r.n for r in keyed.groupBy("lang").agg(F.approx_count_distinct("draw").alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], idf, np.zeros((0, DIMENSIONS)), np.zeros(0, int), np.zeros((0, len(LENGTHS) + 1)))
    # Twice the sample and more passes, however the estimate of sizes errs; copies of a text become
    # one row where they stand, and of what is left the smallest draws are the sample.
    share = F.create_map(*[F.lit(x) for k in languages for x in (k, min(1.0, (2 * sample + 100) / max(1, sizes[k])))])
    place = F.pmod("draw", F.lit(1_000_000)) / 1_000_000
    once = keyed.where(place < share[F.col("lang")]).groupBy("lang", "draw", "other").agg(F.first("text").alias("text"))
    smallest = Window.partitionBy("lang").orderBy(place, "draw", "other")
    sampled = once.select("*", F.row_number().over(smallest).alias("at")).where(F.col("at") <= sample).drop("draw", "other")
    # Only the n-grams that occur travel to the driver, packed: 6 bytes each.
    fields = [T.StructField("grams", T.BinaryType()), T.StructField("counts", T.BinaryType())]

    def make():
        def work(texts: list[str | None]) -> list[list]:
            counts = [grams(t) for t in texts]
            at = [np.flatnonzero(c) for c in counts]
            return [
                [a.astype("<u2").tobytes() for a in at],
                [c[a].astype("<u4").tobytes() for a, c in zip(at, counts, strict=True)],
            ]

        return work

    drawn = map_texts(sampled, "text", fields, make, keep_text=False).collect()
    centroids, owner, floors = [], [], []
    for own, name in enumerate(languages):
        mine = sorted((r for r in drawn if r.lang == name), key=lambda r: r["at"])
        counts = np.zeros((max(1, len(mine)), DIMENSIONS), np.float32)
        for row, r in zip(counts, mine, strict=False):
            row[np.frombuffer(r.grams, "<u2")] = np.frombuffer(r.counts, "<u4")
        vectors = _vectors(counts, idf)
        centers = _cluster(vectors, CENTROIDS)
        centroids.append(centers)
        owner += [own] * len(centers)
        close = (vectors @ centers.T).max(axis=1)
        band = np.searchsorted(LENGTHS, counts.sum(axis=1), side="right")
        floor, least = [], 1.0
        for c in range(len(LENGTHS), -1, -1):  # from long to short: a short class is never stricter
            here = close[band == c]
            least = min(least, np.quantile(here, 0.01)) if len(here) >= 20 else least * (0.5 if c < len(LENGTHS) else 1)
            floor.append(SLACK * least)
        floors.append(floor[::-1])
    return Model(languages, idf, np.concatenate(centroids), np.array(owner), np.array(floors))


def identify(docs: DataFrame, model: Model, *, text: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` plus lang_pred, score (0 to 1: cosine to the nearest centroid) and rejected.

    A NULL text, or one without a letter, is ``und`` with score 0 and rejected. Every row is
    judged by its text alone. Columns of the input with the names of the new ones are
    replaced. An empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make() -> Callable:
        own = shared.value
        return lambda texts: [list(c) for c in zip(*own.predict(texts), strict=True)]

    fields = [
        T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
        T.StructField("rejected", T.BooleanType()),
    ]
    return map_texts(docs, text, fields, make, keep_text)


def held_out(doc_id: Column) -> Column:
    """The documents kept from training: crc32 of the id as text, modulo 5, is 0; rows without
    an id too."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(5)) == 0, F.lit(True))


def learned(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    return train(docs.where(~held_out(F.col(doc_id))), text=text, lang=lang)
