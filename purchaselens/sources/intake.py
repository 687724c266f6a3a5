"""Import of a delivered file: read, judge every row, store, report."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators.validate import judge, transaction_rules
from ..schema import TRANSACTIONS, as_transactions
from .files import import_file, table_name_of


RAW = "raw_line"


def import_transactions(
    spark: SparkSession,
    path: str,
    folder: str,
    root: str | None = None,
    allowed: Iterable[str] | None = None,
) -> DataFrame:
    """Store a file of purchase lines below ``folder`` and say what came in.

    Columns are found by name and read as text, judged once by ``transaction_rules`` and written in
    one pass, split by outcome: ``<table>/outcome=valid`` and ``<table>/outcome=rejected``, the
    latter with its reasons. A line that cannot be read is rejected too, with the reason ``line`` first
    and its raw text. ``allowed`` limits the product types. Counts are observed while writing: the
    import is neither read twice nor read back. A delivery goes to a folder of its own below
    ``<table>``, so that one which fails leaves earlier ones as they are. One row: table, path,
    row_count, valid, rejected.
    """
    text = import_file(spark, path, _text_schema(), root=root, corrupt=RAW)
    rules = {"line": F.col(RAW).isNull()} | transaction_rules(None if allowed is None else tuple(allowed))
    table = table_name_of(path)
    out = f"{folder.rstrip('/')}/{table}/delivery-{uuid.uuid4().hex}"
    outcome = F.when(F.size("reasons") == 0, "valid").otherwise("rejected")
    seen = Observation()
    judged = judge(text, rules).withColumn("outcome", outcome).observe(
        seen,
        F.count(F.lit(1)).alias("row_count"),
        F.count_if(F.col("outcome") == "valid").alias("valid"),
        F.count_if(F.col("outcome") == "rejected").alias("rejected"),
    )
    judged.write.partitionBy("outcome").parquet(out)
    counted = seen.get
    return spark.createDataFrame(
        [(table, out, *(counted.get(n) or 0 for n in ("row_count", "valid", "rejected")))],
        "table string, path string, row_count bigint, valid bigint, rejected bigint",
    )


def _text_schema():
    from pyspark.sql import types as T

    return T.StructType([T.StructField(f.name, T.StringType()) for f in TRANSACTIONS])


def valid_lines(spark: SparkSession, path: str) -> DataFrame:
    """The accepted lines of an import, typed."""
    return as_transactions(spark.read.parquet(path).where("outcome = 'valid'"))


def rejected_lines(spark: SparkSession, path: str) -> DataFrame:
    """The rejected lines as text, with the names of the broken rules, and ``raw_line`` where a line could
    not be read."""
    return spark.read.parquet(path).where("outcome = 'rejected'").drop("outcome")
