"""Where jobs put files that outlive a stage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_path(spark: SparkSession, label: str, root: str | None = None) -> str:
    """A fresh path below ``root``, or else below the shared folder in ``spark.checkpoint.dir``.

    Where neither is given, a local temporary folder serves a local master (tests, a laptop);
    on a cluster its files would be on one machine only, so there this is an error.
    """
    root = root or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.conf.get("spark.master", "")
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="purchaselens-")
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def kept(df: DataFrame, label: str) -> DataFrame:
    """The rows of ``df``, computed once and kept as a table below :func:`scratch_path`."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
