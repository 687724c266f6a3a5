"""Token ids as binary files of bit planes.

The ids of all documents, in ascending doc_id order with an end id after each, are one sequence.
It is cut into blocks of a fixed number of ids. A block is transposed: plane k holds bit k of all
its ids, one after the other, so a plane is long runs where ids are small or alike. Each plane is
compressed with zstandard; a plane of zeros takes no bytes. A chunk row holds the compressed
planes of one block, and the index of it: where each plane ends, and which
documents reach into it, from which place on.

Chunks are rows of a Parquet table in the shared folder, written by the tasks that made them:
file number, block number in it, ids before the block in that file, planes. Files follow each
other by ranges of doc_id.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from purchaselens.llm import bpe
from purchaselens.llm.common import MOST_BLOCKS, chunks, stored
from purchaselens.llm.pretokens import Specials, is_plain, word_level, word_level_pieces
from purchaselens.llm.wordids import REMEMBERED, WordIds

BLOCK = 65_536
BITS = 32
#: Documents per range of doc_id that a task sorts, encodes and writes.
FILE_ROWS = 10_000
#: Bytes of text that such a range holds on average, at most.
FILE_BYTES = 64 << 20

CHUNKS = (
    "file int, block int, first bigint, n_ids int, plane_ends array<int>, planes binary, "
    "docs array<struct<doc_id: bigint, first: bigint, n_tokens: bigint>>"
)


def pack_block(ids: np.ndarray, compressor) -> tuple[list[int], bytes]:
    """Planes of up to BLOCK ids: (end of each plane, compressed planes)."""
    columns = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    used = int(np.bitwise_or.reduce(ids)) if len(ids) else 0
    ends, out, size = [], [], 0
    for k in range(BITS):
        if used >> k & 1:
            plane = np.packbits(columns[:, k // 8] & (1 << k % 8), bitorder="little")
            out.append(compressor.compress(plane.tobytes()))
            size += len(out[-1])
        ends.append(size)
    return ends, b"".join(out)


def unpack_block(
    n_ids: int, ends: list[int], planes: bytes, decompressor, first: int = 0, last: int | None = None
) -> np.ndarray:
    """Ids of a block, or those of places ``first`` up to ``last`` only."""
    last = n_ids if last is None else last
    skipped, bytes_ = first % 8, slice(first // 8, -(-last // 8))
    columns = np.zeros((last - first, 4), np.uint8)
    start = 0
    for byte in range(4):
        column = np.zeros(last - first, np.uint8)
        for k in range(8):
            end = ends[8 * byte + k]
            if end > start:
                raw = np.frombuffer(decompressor.decompress(planes[start:end]), np.uint8)[bytes_]
                column |= np.unpackbits(raw, count=skipped + last - first, bitorder="little")[skipped:] << k
            start = end
        columns[:, byte] = column
    return columns.view("<u4").ravel()


class WordEncoder:
    """Ids of a word-level tokenizers file, as the library gives them for a whole text.

    Where lower-casing is all its normaliser does, a text is split at white space, distinct pieces are
    cut to words here, and distinct words merged many at a time; any other text goes to the library whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        arrays, more = bpe.vocabulary(path)
        self.specials, self.merger = Specials(more["added"]), bpe.Merger(arrays, more["size"])
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.whole: set[str] = set()
        self.pieces = WordIds(self._learn, self.specials.ids)
        self.words = WordIds(lambda words: self.merger.ids([w.encode() for w in words]), {}, REMEMBERED // 2)

    def _learn(self, pieces: list[str]) -> list[bytes]:
        """Parts of texts that are not plain are no pieces; they are for the library."""
        words: list[str] = []
        counts = []
        for piece in pieces:
            before = len(words)
            if piece not in self.whole:
                words += word_level(piece)
            counts.append(len(words) - before)
        out = self.words.encode(words, counts)
        for i, piece in enumerate(pieces) if self.whole else ():
            if piece in self.whole:
                ids = self.tokenizer.encode(piece, add_special_tokens=False).ids
                out[i] = np.array(ids, "<u4").tobytes()
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        pieces: list[str] = []
        counts = []
        self.whole.clear()
        for text in texts:
            before = len(pieces)
            for k, part in enumerate(self.specials.parts(text)):
                if k % 2:
                    pieces.append(part)
                elif is_plain(part):
                    pieces += word_level_pieces(part)
                else:
                    self.whole.add(part)
                    pieces.append(part)
            counts.append(len(pieces) - before)
        return self.pieces.encode(pieces, counts)


def write(
    docs: DataFrame, tokenizer: str, *, doc_id: str = "doc_id", text: str = "text", end_id: int = 1,
    block: int = BLOCK, file_rows: int = FILE_ROWS, file_bytes: int = FILE_BYTES,
) -> DataFrame:
    """Encode, order by doc_id and write; the chunk table as read back.

    A NULL text is empty: its only id is the end id. NULL doc_ids come first; rows of one doc_id
    are ordered by a hash of the text, so the files do not depend on how rows arrive. Other columns of ``docs``
    are not read. An empty table gives no chunks. Rows are ranged before they are encoded:
    the sample that sets the ranges then costs a read, not an encoding.
    """
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    count, size = rows.select(
        F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text").cast("bigint")), F.lit(0))
    ).first()
    files = max(1, min(MOST_BLOCKS, max(-(-count // file_rows), -(-size // file_bytes))))
    ranged = rows.repartitionByRange(files, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        encoder, compressor = WordEncoder(tokenizer), zstandard.ZstdCompressor(level=3)
        file, number, first = TaskContext.get().partitionId(), 0, 0
        end = int(end_id).to_bytes(4, "little")
        waiting, held, starts, position = [], 0, [], 0
        names = ["file", "block", "first", "n_ids", "plane_ends", "planes", "docs"]

        def chunk(ids: np.ndarray, starts_: list[dict]) -> pa.RecordBatch:
            ends, planes = pack_block(ids, compressor)
            kinds = [
                pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.binary(),
                pa.list_(pa.struct([(n, pa.int64()) for n in ("doc_id", "first", "n_tokens")])),
            ]
            values = [file, number, first, len(ids), ends, planes, starts_]
            return pa.RecordBatch.from_arrays(
                [pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names
            )

        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in chunks([len(t) for t in texts]):
                for id_, ids in zip(doc_ids[a:b], encoder.encode(texts[a:b]), strict=True):
                    n = len(ids) // 4 + 1
                    starts.append({"doc_id": id_, "first": position, "n_tokens": n})
                    waiting += [ids, end]
                    held, position = held + n, position + n
                if held >= block:
                    flat = np.frombuffer(b"".join(waiting), "<u4")
                    while len(flat) >= block:
                        end_at = first + block
                        own = [s for s in starts if s["first"] < end_at]
                        open_ = [s for s in own[-1:] if s["first"] + s["n_tokens"] > end_at]
                        starts = open_ + starts[len(own) :]
                        yield chunk(flat[:block], own)
                        flat, number, first = flat[block:], number + 1, end_at
                    waiting, held = [flat.tobytes()], len(flat)
        if held:
            yield chunk(np.frombuffer(b"".join(waiting), "<u4"), starts)

    return stored(ranged.mapInArrow(work, CHUNKS), "token-planes")


def documents(chunk_table: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document, from the chunks alone.

    A document inside one block comes straight from it; the parts of one that crosses blocks
    meet by file and place. ``start`` counts the ids of all documents before it: the files'
    totals, one row each, are added up from the index.
    """
    totals = chunk_table.groupBy("file").agg(F.sum("n_ids").alias("n")).orderBy("file").collect()
    bases, before = [], 0
    for r in totals:
        bases.append((r.file, before))
        before += r.n
    base = F.broadcast(
        chunk_table.sparkSession.createDataFrame(bases, "file int, base bigint")
    )

    def work(whole: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        decompressor = zstandard.ZstdDecompressor()
        for batch in batches:
            for r in batch.to_pylist():
                first, last = r["first"], r["first"] + r["n_ids"]
                spans = [(d, max(d["first"], first), min(d["first"] + d["n_tokens"], last)) for d in r["docs"]]
                spans = [(d, a, b) for d, a, b in spans if whole == (b - a == d["n_tokens"])]
                unpack = partial(unpack_block, r["n_ids"], r["plane_ends"], r["planes"], decompressor)
                # Documents cut by the block's ends are a small part of it: only that is unpacked.
                raw = unpack().tobytes() if whole and spans else b""
                rows = []
                for d, a, b in spans:
                    part = raw[(a - first) * 4 : (b - first) * 4] if whole else unpack(a - first, b - first).tobytes()
                    rows.append((d["doc_id"], d["first"], d["n_tokens"], a, part))
                if rows:
                    columns = list(zip(*rows, strict=True))
                    arrays = [pa.array(c, pa.int64()) for c in columns[:4]]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([r["file"]] * len(rows), pa.int32()), *arrays, pa.array(columns[4], pa.binary())],
                        ["file", "doc_id", "doc_first", "n_tokens", "at", "ids"],
                    )

    parts = "file int, doc_id bigint, doc_first bigint, n_tokens bigint, at bigint, ids binary"
    whole = chunk_table.mapInArrow(partial(work, True), parts).drop("at")
    joined = (
        chunk_table.mapInArrow(partial(work, False), parts).groupBy("file", "doc_first")
        .agg(F.first("doc_id").alias("doc_id"), F.first("n_tokens").alias("n_tokens"),
             F.array_sort(F.collect_list(F.struct("at", "ids"))).alias("parts"))
        .withColumn("ids", F.expr("aggregate(parts, X'', (a, p) -> concat(a, p.ids))"))
    )
    found = whole.unionByName(joined.drop("parts"))
    return found.join(base, "file").select(
        "doc_id", (F.col("base") + F.col("doc_first")).alias("start"), "n_tokens", "ids"
    )
