"""Export of segments, catalogs and neighbour lists."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.guards import InvalidInput, valid_guest_id
from ..schema import PRODUCTS, conform


def segment_slug(name: str) -> str:
    # Fixed value: what a file name keeps of a segment's name.
    return re.sub(r"[^A-Za-z0-9_-]+", "_", name).strip("_") or "segment"


def export_segment(guests: DataFrame, name: str, folder: str) -> DataFrame:
    """Write the guest ids as CSV below ``folder``: (exported, path).

    A single invalid id refuses the whole export before anything is written. Duplicates are
    kept.
    """
    bad = guests.filter(~valid_guest_id(F.col("guest_id"))).select("guest_id").take(1)
    if bad:
        raise InvalidInput(f"invalid guest_id: {bad[0]['guest_id']!r}")
    path = f"{folder.rstrip('/')}/{segment_slug(name)}.csv"
    guests.select("guest_id").write.mode("overwrite").option("header", True).csv(path)
    written = guests.sparkSession.read.option("header", True).csv(path)
    return written.agg(F.count("*").alias("exported")).withColumn("path", F.lit(path))


def load_catalog(products: DataFrame, path: str) -> DataFrame:
    """Replace the stored catalog: (row_count, path)."""
    conform(products, PRODUCTS).write.mode("overwrite").parquet(path)
    stored = products.sparkSession.read.parquet(path)
    return stored.agg(F.count("*").alias("row_count")).withColumn("path", F.lit(path))


def export_catalog_json(products: DataFrame, path: str) -> None:
    products.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def export_neighbours(lists: DataFrame, path: str) -> None:
    """Write neighbour lists, one JSON object per item."""
    lists.write.mode("overwrite").json(path)
