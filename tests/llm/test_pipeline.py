"""The stages on a small table, each against what its operator's brute-force test has shown."""

import hashlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_minhash import brute as brute_groups
from test_winnow import brute as brute_hits
from tokenizers import Tokenizer

import corpus_pipeline

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    # A text without a letter, and one missing, for the first stage to reject.
    odd = spark.createDataFrame([(9000, "12 34", "en", "src0", 5), (9001, None, "en", "src0", 0)], docs.schema)
    outs = [docs.unionByName(odd)]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / "out")
        stage(spark, outs[-1], SF).write.parquet(path)
        outs.append(spark.read.parquet(path))
    return outs


def rows(df):
    return sorted((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())


def test_columns_and_rejections(stages):
    assert all(df.columns == COLUMNS for df in stages[:-1])
    gone = {r.doc_id for r in stages[0].collect()} - {r.doc_id for r in stages[1].collect()}
    assert gone == {9000, 9001}


def test_line_stage_keeps_every_document(stages):
    before, after = rows(stages[1]), rows(stages[2])
    assert [i for i, _ in before] == [i for i, _ in after]
    assert stages[2].where("n_chars <> length(text)").count() == 0
    for (_, a), (_, b) in zip(before, after, strict=True):
        assert set(b.split("\n")) <= set(a.split("\n")) | {""}


def test_one_of_each_group_stays(stages):
    want = sorted(i for i, (_, low) in brute_groups(rows(stages[2])).items() if i == low)
    assert [i for i, _ in rows(stages[3])] == want


def test_contaminated_documents_go(spark, stages):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = sorted(r[0] for r in brute_hits(rows(stages[3]), items) if not r[4])
    assert [i for i, _ in rows(stages[4])] == clean and len(clean) < stages[3].count()


def test_encoding_and_run(spark, stages):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = dict(rows(stages[4]))
    for r in stages[5].collect():
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert np.frombuffer(r.ids, "<u4").tolist() == ids and r.n_tokens == len(ids) and r.round_trip
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    own = corpus_pipeline.run(spark, SF).select("doc_id", "ids_sha256")
    assert sorted(map(tuple, own.collect())) == sorted(map(tuple, stages[5].select("doc_id", "ids_sha256").where(F.col("doc_id") < 9000).collect()))


def chained(docs, spark, folder):
    outs = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(folder / f"stage-{k}")
        stage(spark, outs[-1], SF).write.parquet(path)
        outs.append(spark.read.parquet(path))
    return outs


def test_repeated_rows_nulls_long_texts_and_clashing_columns(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 60")
    some = docs.where("doc_id IN (3, 4)")
    text = some.orderBy("doc_id").first().text
    odd = spark.createDataFrame(
        [(None, text, "en", None, None), (9002, "", "en", "src0", 0), (9003, None, None, None, None),
         (9004, (text + "\n") * (2_000_000 // len(text) + 1), "en", "src1", 0), (9005, text + " " + "w" * 100_000, None, "src1", 1)],
        docs.schema)
    given = docs.unionByName(some).unionByName(some).unionByName(odd).selectExpr(
        "*", "1 AS IDS", "2 AS key", "3 AS __key", "4 AS kept", "5 AS lang_pred", "6 AS n_dropped", "7 AS band")
    outs = chained(given, spark, tmp_path)
    assert all(df.columns == COLUMNS for df in outs[1:-1])
    ids = [[r.doc_id for r in df.select("doc_id").collect()] for df in outs]
    assert ids[0].count(3) == ids[1].count(3) == ids[2].count(3) == 3 and ids[3].count(3) == 1
    assert {9002, 9003}.isdisjoint(ids[1]) and None in ids[-1] and 9005 in ids[2]
    assert all(r.round_trip for r in outs[-1].collect())


def test_empty_table(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    assert [df.count() for df in chained(docs, spark, tmp_path)] == [0] * 6


def test_batches_are_bounded_in_bytes_and_the_session_is_left_as_it_was(spark, monkeypatch):
    def encode(docs, path, decoded):
        def sizes(batches):
            for b in batches:
                size = pa.array([b.nbytes.to_bytes(8, "little")] * len(b))
                yield pa.RecordBatch.from_arrays([*b.columns, size, b.column(1)], ["doc_id", "text", "ids", "decoded"])

        return docs.mapInArrow(sizes, "doc_id long, text string, ids binary, decoded string")

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    monkeypatch.setattr(corpus_pipeline.bpe, "encode", encode)
    docs = spark.range(3000, numPartitions=1).selectExpr("id AS doc_id", "repeat('many words ', 500) AS text")
    got = corpus_pipeline.encoding(spark, docs, SF).collect()
    assert len(got) == 3000 and max(int.from_bytes(r.ids, "little") for r in got) < 2_200_000
    assert spark.conf.get(key) == before
