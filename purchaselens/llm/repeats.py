"""Substring dedup: words covered by windows that a document of smaller doc_id has too.

Every window of a fixed number of words is hashed (Rabin-Karp: a polynomial in the words' codes,
rolled by prefix sums). Documents are dealt to batches by a hash; a batch passes on each of its
distinct windows once, with the smallest doc_id that has it there, so a passage that a third of all
documents share is one entry a batch. Entries meet by bucket of a second hash, where the smallest
doc_id over all batches is found; what goes back to the batches is one bit per entry. Each batch then marks the
windows, merges marked ones into maximal intervals and cuts those out.

Entries travel packed, 10 bytes a window; the texts are shuffled once, for both visits to a batch.
Batches and buckets grow with the input up to a limit, so that packed rows stay long. Two windows are
taken as equal if 80 hash bits and the bucket agree: at 100 TB (1.4e13 windows) one wrong pair is expected
in 10,000 runs.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from purchaselens.llm.common import without

WINDOW = 13
#: Bytes of text in a batch: least, most.
BATCH = (8 << 20, 64 << 20)

_B, _I = "__batch", "__bucket"
_BASES = (0x9E3779B97F4A7C13, 0xC2B2AE3D27D4EB4B)  # odd, so that their powers have inverses
ENTRIES = f"{_I} int, {_B} int, hashes binary, more binary, ids binary, counts binary"
LOWER = f"{_B} int, {_I} int, n int, bits binary"
INTERVAL = T.StructType([T.StructField(n, T.LongType(), False) for n in ("start", "length")])
FIELDS = [
    T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()),
    T.StructField("removed", T.ArrayType(INTERVAL, False)), T.StructField("kept", T.StringType()),
]


def rolled(codes: np.ndarray, base: int, window: int) -> np.ndarray:
    """Sum of code times base to the power of its place in the window, for every window; modulo 2**64."""
    inverse = np.uint64(pow(base, -1, 2**64))
    up = np.cumprod(np.full(len(codes), base, np.uint64)) * inverse
    down = np.cumprod(np.full(len(codes), inverse, np.uint64)) * np.uint64(base)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * up)])
    return (sums[window:] - sums[:-window]) * down[: len(codes) - window + 1]


def alike(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order in which equal pairs stand together, earlier ones first, and where a group begins."""
    order = np.argsort(first, kind="stable")
    a, b = first[order], second[order]
    new = np.ones(len(order), bool)
    new[1:] = a[1:] != a[:-1]
    if (b[1:] != b[:-1])[~new[1:]].any():  # one hash equal, the other not
        order = np.lexsort((second, first))
        a, b = first[order], second[order]
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return order, new


class Batch:
    """The windows of some documents, and their distinct ones as entries by bucket."""

    def __init__(self, ids: list[int | None], texts: list[bytes], window: int, n_buckets: int):
        import xxhash

        self.window = window
        rank = sorted(range(len(texts)), key=lambda i: (ids[i] is not None, ids[i] or 0, texts[i]))
        words_of = [texts[i].split() for i in rank]  # on bytes: blank and \t to \r, nothing else
        self.words: list[list[bytes]] = [[]] * len(texts)
        for i, words in zip(rank, words_of, strict=True):
            self.words[i] = words
        sizes = np.array([len(w) for w in words_of], np.int64)
        self.at = np.zeros(len(texts), np.int64)
        self.at[rank] = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if rank else 0
        document = np.repeat(np.arange(len(rank)), sizes)
        self.n_words = len(document)
        known = np.array([ids[i] or 0 for i in rank], np.int64)
        if self.n_words < window:
            self.starts = np.zeros(0, np.int64)
            first = second = np.zeros(0, np.uint64)
        else:
            coded = pa.array([w for words in words_of for w in words], pa.large_binary()).dictionary_encode()
            codes = np.frombuffer(
                b"".join([xxhash.xxh3_128_digest(w) for w in coded.dictionary.to_pylist()]), "<u8"
            ).reshape(-1, 2)
            places = coded.indices.to_numpy()
            has_id = np.array([ids[i] is not None for i in rank])
            inside = (document[window - 1 :] == document[: self.n_words - window + 1]) & has_id[
                document[: self.n_words - window + 1]
            ]
            self.starts = np.flatnonzero(inside)
            first, second = (rolled(codes[:, k][places], _BASES[k], window)[inside] for k in (0, 1))
        self.id_of = known[document[self.starts]] if len(self.starts) else np.zeros(0, np.int64)
        order, new = alike(first, second)
        self.group = np.empty(len(order), np.int64)
        self.group[order] = np.cumsum(new) - 1
        # Documents stand by doc_id, so the first window of a group has its smallest.
        self.least = self.id_of[order[new]]
        leaders = np.sort(order[new])
        bucket = ((second[leaders] >> np.uint64(32)) % np.uint64(n_buckets)).astype(np.int32)
        by_bucket = np.argsort(bucket, kind="stable")
        self.leaders, self.bucket = leaders[by_bucket], bucket[by_bucket]
        self.first, self.second = first, second

    def parts(self) -> list[tuple[int, int, int]]:
        """(bucket, start, end) of its entries."""
        cuts = np.flatnonzero(np.diff(self.bucket)) + 1
        edges = [0, *cuts.tolist(), len(self.bucket)] if len(self.bucket) else [0]
        return [(int(self.bucket[a]), a, b) for a, b in zip(edges, edges[1:], strict=False)]

    def packed(self, start: int, end: int) -> list[bytes]:
        """Hashes, further hash bits, doc_ids and how many entries each has."""
        of = self.leaders[start:end]
        ids = self.id_of[of]
        begins = np.concatenate([[0], np.flatnonzero(np.diff(ids)) + 1])
        counts = np.diff(np.append(begins, len(ids)))
        more = (self.second[of] >> np.uint64(8)).astype("<u2")
        return [x.tobytes() for x in (self.first[of].astype("<u8"), more, ids[begins].astype("<i8"), counts.astype("<i4"))]

    def covered(self, lower: dict[int, np.ndarray]) -> np.ndarray:
        """Whether each word is in a removed window; ``lower`` tells by bucket of which entries a smaller
        doc_id is known elsewhere."""
        beaten = np.zeros(len(self.least), bool)
        for bucket, start, end in self.parts():
            if bucket in lower:
                if len(lower[bucket]) != end - start:
                    raise RuntimeError("a batch of documents changed between its two visits")
                beaten[self.group[self.leaders[start:end]]] = lower[bucket]
        gone = self.starts[beaten[self.group] | (self.id_of > self.least[self.group])]
        depth = np.zeros(self.n_words + 1, np.int64)
        np.add.at(depth, gone, 1)
        np.subtract.at(depth, gone + self.window, 1)
        return np.cumsum(depth[:-1]) > 0


def beaten_entries(table: pa.Table) -> pa.Table:
    """For the entries of one bucket, one bit each: another batch has the window under a smaller doc_id."""
    columns = {n: table.column(n).to_pylist() for n in ("hashes", "more", "ids", "counts")}
    joined = {n: b"".join(v) for n, v in columns.items()}
    first, more = np.frombuffer(joined["hashes"], "<u8"), np.frombuffer(joined["more"], "<u2")
    ids = np.repeat(np.frombuffer(joined["ids"], "<i8"), np.frombuffer(joined["counts"], "<i4"))
    order, new = alike(first, more)
    by_group = ids[order]
    least = np.minimum.reduceat(by_group, np.flatnonzero(new)) if len(order) else by_group
    beaten = np.zeros(len(order), bool)
    beaten[order] = by_group > least[np.cumsum(new) - 1]
    ends = np.cumsum([len(h) // 8 for h in columns["hashes"]])
    parts = np.split(beaten, ends[:-1])
    keep = np.array([p.any() for p in parts], bool)
    bits = [np.packbits(p).tobytes() for p, k in zip(parts, keep, strict=True) if k]
    sizes = [len(p) for p, k in zip(parts, keep, strict=True) if k]
    kept = table.select([_B, _I]).filter(pa.array(keep))
    return pa.table(
        [kept.column(_B), kept.column(_I), pa.array(sizes, pa.int32()), pa.array(bits, pa.binary())], [_B, _I, "n", "bits"]
    )


def _batch_of(window: int, n_buckets: int, doc_id: str, text: str) -> Callable[[pa.Table], Batch]:
    def made(table: pa.Table) -> Batch:
        texts = table.column(text).cast(pa.large_string()).cast(pa.large_binary()).to_pylist()
        ids = table.column(doc_id).cast(pa.int64()).to_pylist()
        return Batch(ids, [t or b"" for t in texts], window, n_buckets)

    return made


def remove(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW,
    batch_bytes: tuple[int, int] = BATCH,
) -> DataFrame:
    """``docs`` plus n_words, n_removed, removed (array of start and length in words, maximal intervals)
    and kept: the words left, joined by one blank.

    A word goes if a window over it also starts in a document with a smaller doc_id (a whole number),
    as the input has them. Windows repeated inside one document, or in rows of one doc_id only, stay.
    A NULL doc_id is neither smaller nor larger: its row stays whole and removes nothing. NULL and
    empty texts, and texts of fewer words than a window, have no windows. Rows equal in doc_id and text
    come out alike (and share a batch). Columns of ``docs`` named like the new ones are replaced;
    an empty table gives an empty one.
    """
    base = without(docs, [*[f.name for f in FIELDS], _B])
    total = base.agg(F.sum(F.octet_length(F.col(text)).cast("bigint")).alias("n")).first()["n"] or 0
    size = min(batch_bytes[1], max(batch_bytes[0], total >> 12))
    n_batches, n_buckets = 1 + total // size, 1 + total // (2 * size)
    key = F.pmod(F.xxhash64(F.col(doc_id).cast("bigint"), F.col(text)), F.lit(n_batches)).cast("int")
    dealt = base.withColumn(_B, key)
    made = _batch_of(window, n_buckets, doc_id, text)
    given = base.schema.fields
    schema = T.StructType([*given, *FIELDS])

    def entries(table: pa.Table) -> pa.Table:
        batch, number = made(table), table.column(_B)[0].as_py()
        rows = [(bucket, number, *batch.packed(a, b)) for bucket, a, b in batch.parts()]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
        kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 4]
        names = [_I, _B, "hashes", "more", "ids", "counts"]
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    def cut(table: pa.Table, masks: pa.Table) -> pa.Table:
        from pyspark.sql.pandas.types import to_arrow_type

        batch = made(table)
        lower = {
            r[_I]: np.unpackbits(np.frombuffer(r["bits"], np.uint8), count=r["n"]).astype(bool)
            for r in masks.to_pylist()
        }
        covered = batch.covered(lower)
        sizes, removed, intervals, kept = [], [], [], []
        for words, at in zip(batch.words, batch.at.tolist(), strict=True):
            gone = covered[at : at + len(words)]
            edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
            sizes.append(len(words))
            removed.append(int(gone.sum()))
            intervals.append([{"start": a, "length": b - a} for a, b in edges.reshape(-1, 2).tolist()])
            left = words if not removed[-1] else [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
            kept.append(b" ".join(left))
        kinds = [to_arrow_type(f.dataType) for f in FIELDS]
        made_of = (sizes, removed, intervals, [k.decode() for k in kept])
        new = [pa.array(v, k) for v, k in zip(made_of, kinds, strict=True)]
        return pa.table([*[table.column(f.name) for f in given], *new], [f.name for f in schema])

    packed = dealt.groupBy(_B).applyInArrow(entries, ENTRIES)
    lower = packed.groupBy(_I).applyInArrow(beaten_entries, LOWER)
    return dealt.groupBy(_B).cogroup(lower.groupBy(_B)).applyInArrow(cut, schema)
