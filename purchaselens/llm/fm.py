"""Document quality by a factorisation machine.

A document is a sparse vector: its hashed words, and one-hot classes of structure statistics
and metadata. The score is a logistic function of
    b + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j,
and the pairs cost no more than the single terms, since their sum is half of
    |sum_i v_i x_i|^2 - sum_i |v_i|^2 x_i^2.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from purchaselens.llm.common import map_texts
from purchaselens.llm.minhash import word_hashes

WORD_BITS = 14
FACTORS = 8
#: Labelled rows per label that the machine is fitted on, at most; the draw is by a hash of the id.
SAMPLE = 4000
EPOCHS = 6
RATE, SHRINK = 0.1, 1e-5
#: Classes of each statistic.
CLASSES = 16
#: A statistic's class weighs as much as this, all words together as 1.
STATISTIC_WEIGHT = 0.5

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".,"]] = True
STATISTICS = 9
FEATURES = (1 << WORD_BITS) + STATISTICS * CLASSES


def _class(share: float) -> int:
    """Logarithmic classes of a share: 0 for none, finer near 0."""
    return 0 if share <= 0 else min(CLASSES - 1, max(1, CLASSES - 1 + int(np.floor(2 * np.log2(share)))))


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(indices, values) of a text; an empty one has its statistics only."""
    raw = np.frombuffer((text or "").encode(), np.uint8)
    words = word_hashes(raw.tobytes())
    distinct, counts = np.unique(words >> np.uint64(64 - WORD_BITS), return_counts=True)
    value = np.log1p(counts)
    if len(value):
        value = value / np.linalg.norm(value)
    n, n_words = max(1, len(raw)), max(1, len(words))
    lines = int((raw == 10).sum()) + 1
    shares = [
        _UPPER[raw].sum() / n, _DIGIT[raw].sum() / n, _SPACE[raw].sum() / n,
        (~(_LETTER | _DIGIT | _SPACE | _STOP)[raw]).sum() / n, _STOP[raw].sum() / n,
        (words[1:] == words[:-1]).sum() / n_words,  # a word after itself
        len(np.unique(words)) / n_words,
        min(1.0, lines / n_words),
        min(1.0, len(raw) / 2**20),  # metadata: the size
    ]
    at = [(1 << WORD_BITS) + k * CLASSES + _class(float(s)) for k, s in enumerate(shares)]
    return (
        np.append(distinct.astype(np.int64), at),
        np.append(value, np.full(STATISTICS, STATISTIC_WEIGHT)),
    )


@dataclass
class Machine:
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def raw(self, at: np.ndarray, x: np.ndarray) -> float:
        v = self.factors[at] * x[:, None]
        total = v.sum(axis=0)
        return self.bias + float(self.weights[at] @ x) + 0.5 * float(total @ total - np.square(v).sum())

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.raw(*features(text)), -30, 30))))


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], sizes: dict[int, int] | None = None) -> Machine:
    """Adaptive gradient descent on the logistic loss. Where ``sizes`` tells how many rows of
    each label the sample stands for, rows weigh accordingly: scores follow the true shares.

    Without rows, or with one label only, every score is that label's share (or 0.5)."""
    rng = np.random.default_rng(7)
    machine = Machine(0.0, np.zeros(FEATURES), rng.normal(0, 0.05, (FEATURES, FACTORS)))
    labels = np.array([y for _, _, y in rows], int)
    if len(set(labels.tolist())) < 2:
        machine.bias = 0.0 if not len(labels) else (30.0 if labels[0] else -30.0)
        machine.factors[:] = 0
        return machine
    drawn = np.bincount(labels, minlength=2)
    weight = np.array([(sizes or {}).get(y, drawn[y]) / drawn[y] for y in (0, 1)])
    weight *= len(labels) / (weight * drawn).sum()
    g0, gw, gv = 1e-6, np.full(FEATURES, 1e-6), np.full((FEATURES, FACTORS), 1e-6)
    for _ in range(EPOCHS):
        for k in rng.permutation(len(rows)):
            at, x, y = rows[k]
            own = machine.factors[at]
            v = own * x[:, None]
            total = v.sum(axis=0)
            z = machine.bias + machine.weights[at] @ x + 0.5 * (total @ total - np.square(v).sum())
            d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * weight[y]
            step = d * x + SHRINK * machine.weights[at]
            gw[at] += step * step
            machine.weights[at] -= RATE * step / np.sqrt(gw[at])
            push = d * x[:, None] * (total - v) + SHRINK * own
            gv[at] += push * push
            machine.factors[at] -= RATE * 0.5 * push / np.sqrt(gv[at])
            g0 += d * d
            machine.bias -= RATE * d / np.sqrt(g0)
    return machine


def train(
    docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text",
    label: str = "quality", sample: int = SAMPLE,
) -> Machine:
    """Fit on labelled documents. Labels of one doc_id that disagree are left out, as are NULLs
    and labels without a document. The driver sees the sample: at most ``sample`` rows a label, the smallest
    draws among distinct (doc_id, text), so an id on many rows counts once for each of its texts and
    nothing depends on the order of rows."""
    given = (
        labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("y"))
        .where("doc_id IS NOT NULL AND y IN (0, 1)").groupBy("doc_id")
        .agg(F.min("y").alias("y"), F.max("y").alias("most")).where("y = most").drop("most")
    )
    sizes = {r.y: r["count"] for r in given.groupBy("y").count().collect()}
    # Twice the sample of ids, since some may have no document; exactly bounded, so they are broadcast.
    place = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1_000_000)) / 1_000_000
    share = [min(1.0, (4 * sample + 100) / max(1, sizes.get(y, 0))) for y in (0, 1)]
    drawn = given.where(place < F.when(F.col("y") == 1, share[1]).otherwise(share[0]))
    ids = drawn.withColumn(
        "at", F.row_number().over(Window.partitionBy("y").orderBy(place, "doc_id"))
    ).where(F.col("at") <= 2 * sample).select("doc_id", "y")
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), body.alias("text")).join(F.broadcast(ids), "doc_id")
    once = rows.groupBy(
        "y", "doc_id", F.xxhash64("text").alias("text_1"), F.xxhash64(F.lit(1), "text").alias("text_2")
    ).agg(F.first("text").alias("text"))
    order = Window.partitionBy("y").orderBy(place, "doc_id", "text_1", "text_2")
    picked = once.withColumn("at", F.row_number().over(order)).where(F.col("at") <= sample).select("y", "at", "text")
    # Packed, 6 bytes a feature, on their way to the driver.
    fields = [T.StructField("features", T.BinaryType()), T.StructField("x", T.BinaryType())]

    def make():
        def work(texts: list[str | None]) -> list[list]:
            made = [features(t) for t in texts]
            return [[a.astype("<u2").tobytes() for a, _ in made], [x.astype("<f4").tobytes() for _, x in made]]

        return work

    found = map_texts(picked, "text", fields, make, keep_text=False).collect()
    packed = [
        (np.frombuffer(r.features, "<u2"), np.frombuffer(r.x, "<f4"), r.y)
        for r in sorted(found, key=lambda r: (r["at"], r.y))
    ]
    return fit(packed, sizes)


def score(docs: DataFrame, machine: Machine, *, text: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` plus score (0 to 1: higher, label 1 likelier).

    NULL counts as the empty text, which has a score like any other. A text is scored whole and
    by itself; equal texts score alike. A ``score`` of the input is replaced. An empty table
    gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def make():
        own = shared.value
        return lambda texts: [[own.score(t) for t in texts]]

    return map_texts(docs, text, [T.StructField("score", T.DoubleType())], make, keep_text)


def held_out(doc_id: Column) -> Column:
    """The documents kept from training: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == 2, F.lit(False))


def learned(docs: DataFrame, labels: DataFrame) -> Machine:
    return train(docs, labels.where(~held_out(F.col("doc_id"))))
