"""What tables there are: names, types and sizes, never row data."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

SCHEMA = "table_name string, ordinal int, column_name string, data_type string"


def inspect_schema(spark: SparkSession, tables: dict[str, DataFrame] | None = None) -> DataFrame:
    """Columns of the given tables, or of all tables and views of the current database."""
    if tables is None:
        tables = {t.name: spark.table(t.name) for t in spark.catalog.listTables()}
    rows = [
        (table, i, f.name, f.dataType.simpleString())
        for table, df in sorted(tables.items())
        for i, f in enumerate(df.schema, start=1)
    ]
    return spark.createDataFrame(rows, SCHEMA)


def table_profile(spark: SparkSession, tables: dict[str, DataFrame] | None = None) -> DataFrame:
    """Row count and column list of every table."""
    if tables is None:
        tables = {t.name: spark.table(t.name) for t in spark.catalog.listTables()}
    if not tables:
        return spark.createDataFrame(
            [], "table_name string, row_count bigint, column_count int, columns string"
        )
    return reduce(
        DataFrame.unionByName,
        [
            df.agg(F.count("*").alias("row_count")).select(
                F.lit(name).alias("table_name"),
                "row_count",
                F.lit(len(df.columns)).alias("column_count"),
                F.lit(", ".join(df.columns)).alias("columns"),
            )
            for name, df in sorted(tables.items())
        ],
    )


def save_with_report(df: DataFrame, save: Callable[[DataFrame], object]) -> DataFrame:
    """Store a table with ``save`` and report as :func:`import_report` does: the rows are counted while
    they are written, nothing is read again."""
    seen = Observation()
    save(df.observe(seen, F.count(F.lit(1)).alias("row_count")))
    n = seen.get.get("row_count") or 0
    return _report(df.sparkSession.range(1).select(F.lit(n).cast("bigint").alias("row_count")), df)


def import_report(df: DataFrame) -> DataFrame:
    """(rows, columns, ordinal, column_name, data_type), one row per column."""
    return _report(df.agg(F.count("*").alias("row_count")), df)


def _report(counted: DataFrame, df: DataFrame) -> DataFrame:
    described = [
        F.struct(
            F.lit(i).alias("ordinal"),
            F.lit(f.name).alias("column_name"),
            F.lit(f.dataType.simpleString()).alias("data_type"),
        )
        for i, f in enumerate(df.schema, start=1)
    ]
    return (
        counted.select(
            "row_count",
            F.lit(len(described)).alias("column_count"),
            F.explode(F.array(*described)).alias("c"),
        )
        .select("row_count", "column_count", "c.*")
    )


def adhoc_sql(spark: SparkSession, text: str, args: list | dict | None = None) -> DataFrame:
    """Any query over the registered tables; values are bound, not written into the text."""
    return spark.sql(text, args=args) if args else spark.sql(text)
