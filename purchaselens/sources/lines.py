"""Purchase lines stored so that a date range reads only its own months."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.guards import check_table_name
from ..operators.reports import in_range
from ..schema import as_transactions

MONTH = "transaction_month"


def save_lines(lines: DataFrame, path: str) -> None:
    """Replace the stored lines, one folder per month.

    Rows are range-partitioned by month, guest and transaction: tasks are of equal size even
    if one month or one guest holds most lines, each task writes to few folders, and the
    lines of a guest lie together.
    """
    (
        as_transactions(lines)
        .withColumn(MONTH, F.trunc("transaction_date", "month"))
        .repartitionByRange(MONTH, "guest_id", "transaction_id")
        .write.mode("overwrite")
        .partitionBy(MONTH)
        .parquet(path)
    )


def load_lines(
    spark: SparkSession, path: str, start: date | str | None = None, end: date | str | None = None
) -> DataFrame:
    """Stored lines, all of them or those of a range of dates (both ends included).

    The reports that look at one range only give the same answer on the narrowed lines; for
    those with purchases "at any time" load everything.
    """
    lines = spark.read.parquet(path)
    if start is not None:
        lines = lines.filter(F.col(MONTH) >= F.trunc(F.lit(start).cast("date"), "month"))
    if end is not None:
        lines = lines.filter(F.col(MONTH) <= F.lit(end).cast("date"))
    if start is not None or end is not None:
        lines = lines.filter(in_range(start or "0001-01-01", end or "9999-12-31"))
    return lines.drop(MONTH)


def save_guest_lines(lines: DataFrame, name: str, location: str, buckets: int = 200) -> DataFrame:
    """Store the lines as a table bucketed by guest and return it: questions per guest, such as
    cross-selling, then need no shuffle of the lines, however often they are asked.

    A bucket is read by one task, so a guest with a large share of all lines makes one task as large;
    for such data use :func:`save_lines`. The table must not exist.
    """
    (
        as_transactions(lines).repartition(buckets, "guest_id")
        .write.bucketBy(buckets, "guest_id").sortBy("guest_id").format("parquet")
        .option("path", location).saveAsTable(check_table_name(name))
    )
    return lines.sparkSession.table(name)
