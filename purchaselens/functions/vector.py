"""Vector arithmetic on ``array<double>`` columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def same_length_dot(a: Column, b: Column, name: Column) -> Column:
    """``dot``, but vectors of different lengths stop the job with the item's name."""
    differ = F.raise_error(F.concat(F.lit("item vectors differ in length: "), F.coalesce(name, F.lit("NULL"))))
    return F.when(F.size(a) != F.size(b), differ.cast("double")).otherwise(dot(a, b))


def unit(vector: Column) -> Column:
    """Scale to length one; an all-zero vector is left as it is.

    The squared length is the accumulator of ``aggregate``, so it is computed once per row
    and not again for every component.
    """
    v = vector.cast("array<double>")
    return F.aggregate(
        v,
        F.lit(0.0),
        lambda s, x: s + x * x,
        lambda s: F.when(s > 0, F.transform(v, lambda x: x / F.sqrt(s))).otherwise(v),
    )
