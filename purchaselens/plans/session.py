"""A session with the settings these jobs are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    # Runtime re-planning: small join sides become broadcasts once their real size is
    # known, tiny partitions are merged, partitions of a hot key are split.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A collect_set per guest is small: keep it hashed instead of sorting every input row.
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "20000",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def spark_session(
    app: str = "purchaselens", master: str | None = None, **settings: str
) -> SparkSession:
    """``spark_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8"})``"""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
