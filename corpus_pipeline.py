"""The corpus pipeline: five stages over ``documents``, each written and read again.

Every stage takes all rows the one before kept; all but the last return the columns of
``documents``, the last one the ids of every document that is left and the round trip of its text.
The input needs those five columns; further ones, whatever their names, are not carried on.

A NULL in any column stops nothing. A NULL text has no language and goes in the first stage; a NULL
doc_id is in no group of near duplicates; a NULL source is a source of its own. Rows that repeat id and
text are one document from the third stage on. Texts of any length are taken whole. An empty table gives an
empty one in every stage.

Every stage bounds the bytes of an Arrow batch (``BATCH_BYTES``) while it is worked out and then puts the session
back as it was: by rows alone a batch is 10,000 texts of any length, which an executor and its Python worker
hold several times. For that, stages that end in Python store their rows themselves.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from purchaselens.llm import bpe, langid, lines, minhash, winnow
from purchaselens.llm.common import read, stored

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Bytes of rows that go to a Python worker at a time; a longer row is a batch.
BATCH_BYTES = "2m"


def _bounded(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage, with Arrow batches bounded in bytes as long as it runs."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        before = spark.conf.get(key)
        spark.conf.set(key, BATCH_BYTES)
        try:
            return stage(spark, docs, sf_dir)
        finally:
            spark.conf.set(key, before)

    return run_stage


@_bounded
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; those that language ID rejects go, texts that are NULL or
    have no letter among them."""
    model = langid.learned(docs)
    return stored(langid.identify(docs, model).where(~F.col("rejected")).select(*COLUMNS), "language-ID")


@_bounded
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the boilerplate lines of their source; no document goes. A text all of whose lines
    go becomes empty; ``n_chars`` is counted anew."""
    cleaned = lines.drop_boilerplate(docs)
    return cleaned.withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


@_bounded
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one of the smallest doc_id. Empty texts are in no
    group; of rows that repeat id and text one stays."""
    return minhash.without_copies(docs).select(*COLUMNS)


@_bounded
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window; an empty text has none."""
    return winnow.clean(docs, read(spark, sf_dir, "benchmark")).select(*COLUMNS)


@_bounded
def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and whether they decode to its text; an empty text has none and does."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    encoded = bpe.encode(docs.select("doc_id", "text"), path, decoded=True)
    rows = encoded.select(
        "doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), "ids",
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"),
    )
    return stored(rows, "BPE-encoding")


STAGES = [
    ("language ID", language),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("decontamination", decontamination),
    ("BPE encoding", encoding),
]

#: Centroids, MinHash signatures and BPE merges have no SQL form; the stages are tested against
#: brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        if stage is not language:  # it has stored its rows
            docs = stored(docs, name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
