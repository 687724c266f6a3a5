"""Joins against lookup tables whose size is checked before anything is broadcast."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROADCAST_BYTES = 64 * 1024 * 1024
#: The same bound for what belongs to the hot keys of a larger table.
BROADCAST_BYTES_HOT = 64 * 1024 * 1024


def measured_bytes(df: DataFrame) -> int:
    """What the rows of a table take up, from one aggregate over it."""

    def width(field: T.StructField) -> Column:
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            return F.coalesce(F.octet_length(field.name), F.lit(0)) + 24
        if isinstance(field.dataType, T.ArrayType) and isinstance(
            field.dataType.elementType, T.NumericType
        ):
            return F.greatest(F.size(field.name), F.lit(0)) * 8 + 24
        if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
            return F.coalesce(F.octet_length(F.to_json(F.struct(field.name))), F.lit(0)) + 24
        return F.lit(16)

    widths = [width(f).cast("bigint") for f in df.schema]
    row = reduce(lambda total, w: total + w, widths, F.lit(32).cast("bigint"))
    return df.agg(F.coalesce(F.sum(row), F.lit(0)).alias("bytes")).first()["bytes"]


def hot_keys(df: DataFrame, on: list[str], counts: DataFrame | None = None) -> DataFrame | None:
    """Keys that hold more rows than one of the shuffle's partitions should, as a broadcast table, or None.

    A key is hot if it has over twice an even partition's share, so there are fewer hot keys than
    partitions. Counts are combined before they are shuffled; with ``counts``, a table of the keys and
    ``__n``, ``df`` is not read. A NULL in a key counts as a value.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if counts is None:
        counts = df.groupBy(*on).agg(F.count(F.lit(1)).alias("__n"))
        total = df.select(F.count(F.lit(1))).first()[0]
    else:
        total = counts.agg(F.sum("__n")).first()[0] or 0
    rows = counts.where(F.col("__n") > 2 * max(1, total // parts)).select(*on).collect()
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.select(*on).schema)) if rows else None


def _same_key(a: DataFrame, b: DataFrame, on: list[str]) -> Column:
    return reduce(lambda all_, c: all_ & a[c].eqNullSafe(b[c]), on, F.lit(True))


def shuffled_join(
    big: DataFrame, small: DataFrame, on: list[str], how: str = "inner", counts: DataFrame | None = None
) -> DataFrame:
    """Join by a shuffle of both sides in which no key of ``big`` goes to one task alone.

    The rows of hot keys stay where they are: the few rows of ``small`` that belong to them are
    broadcast if they measure below ``BROADCAST_BYTES_HOT``. All others are shuffled. Rows of ``big`` with
    a NULL in a key match nothing and are not shuffled if they are many.
    """
    hot = hot_keys(big, on, counts)
    if hot is None:
        return big.join(small.hint("merge"), on, how)
    matches = small.join(hot, _same_key(small, hot, on), "left_semi")
    if measured_bytes(matches) > BROADCAST_BYTES_HOT:
        return big.join(small.hint("merge"), on, how)
    apart = big.join(hot, _same_key(big, hot, on), "left_semi").join(F.broadcast(matches), on, how)
    rest = big.join(hot, _same_key(big, hot, on), "left_anti").join(small.hint("merge"), on, how)
    return apart.unionByName(rest)


def lookup_join(
    big: DataFrame,
    small: DataFrame,
    on: list[str],
    how: str = "inner",
    *,
    size: int | None = None,
    counts: DataFrame | None = None,
) -> DataFrame:
    """Join ``big`` to a lookup table.

    ``size`` is an upper bound on the bytes of ``small``; without it they are measured. ``counts`` may
    give the rows of each key of ``big``, which are counted otherwise.
    Within ``BROADCAST_BYTES`` the table is broadcast and ``big`` is not shuffled. Beyond
    it both sides are shuffled by the key, but for the rows of hot keys: see :func:`shuffled_join`.
    Only join types that keep the rows of ``big`` apart are accepted.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"lookup_join cannot do a {how!r} join")
    if size is None:
        size = measured_bytes(small)
    if size <= BROADCAST_BYTES:
        return big.join(F.broadcast(small), on, how)
    return shuffled_join(big, small, on, how, counts)
