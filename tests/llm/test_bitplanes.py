import zlib

import numpy as np
import public_tokenizers
import pytest
import zstandard
from tokenizers import Tokenizer

from purchaselens.llm import bitplanes
from odd_texts import TEXTS

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def expected(library, rows):
    out, start = {}, 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = library.encode(text or "", add_special_tokens=False).ids + [1]
        out.setdefault(doc_id, []).append((start, len(ids), ids))
        start += len(ids)
    return {k: sorted(v) for k, v in out.items()}


@pytest.mark.parametrize("n", [1, 7, 8, 65_536, 1000])
def test_planes_round_trip(n):
    rng = np.random.default_rng(n)
    for top in (1, 2, 50_000, 2**32):
        ids = rng.integers(0, top, n, dtype=np.uint64).astype("<u4")
        ends, planes = bitplanes.pack_block(ids, zstandard.ZstdCompressor())
        back = bitplanes.unpack_block(n, ends, planes, zstandard.ZstdDecompressor())
        assert (back == ids).all() and len(ends) == 32
        for a, b in ((0, n), (n // 3, n // 2 + 1), (n - 1, n)):
            part = bitplanes.unpack_block(n, ends, planes, zstandard.ZstdDecompressor(), a, b)
            assert (part == ids[a:b]).all()


@pytest.mark.parametrize("block,file_rows", [(64, 50), (100_000, 7)])
def test_equal_to_the_library(spark, library, block, file_rows):
    rows = [(i * 3 % 1001, t) for i, t in enumerate(TEXTS)]
    rows += [(None, "none"), (5, None), (5, "five"), (5, "five"), (-2, "x " * 500)]
    rows += [(2000, "Long words, é and 12 of them. " * 70_000), (2001, "w" * 100_000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'a' AS IDS", "1 AS first")
    files = bitplanes.write(docs, PATH, block=block, file_rows=file_rows)
    sizes = files.selectExpr("max(n_ids) AS n").first().n
    assert sizes <= block
    got = {}
    for r in bitplanes.documents(files).collect():
        got.setdefault(r.doc_id, []).append((r.start, r.n_tokens, np.frombuffer(r.ids, "<u4").tolist()))
    want, mine = expected(library, rows), got.pop(5)
    others = want.pop(5)
    assert {k: sorted(v) for k, v in got.items()} == want
    assert sorted(ids for _, _, ids in mine) == sorted(ids for _, _, ids in others)
    starts = sorted((start, n) for start, n, _ in mine)
    assert starts[0][0] == others[0][0]
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:], strict=False))


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert bitplanes.documents(bitplanes.write(docs, PATH)).count() == 0


def test_query_on_the_smallest_table(spark, library):
    from purchaselens.llm.queries import op9_bit_planes

    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = expected(library, rows)
    got = op9_bit_planes(spark, sf).collect()
    assert len(got) == len(rows)
    for r in got:
        start, n, ids = want[r.doc_id][0]
        assert (r.start, r.n_tokens) == (start, n)
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
