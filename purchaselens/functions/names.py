"""Matching key of an item name as it appears in point-of-sale data."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def name_key(name: Column) -> Column:
    """Lower-cased, without white space around it, the "Plus" size marker and the blanks before it."""
    bare = F.regexp_replace(name, r"(?U)\A\s+|\s+\z", "")
    return F.regexp_replace(F.lower(bare), " {1,2}plus", "")
