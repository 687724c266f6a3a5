"""The item dimension: (name, family, notes, tags), one row per item."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import name_key
from ..plans import joins
from ..plans.joins import lookup_join, measured_bytes
from ..plans.scratch import kept


def _resolved(df: DataFrame, items: DataFrame, col: str, out: str, size: int) -> DataFrame:
    exact = items.select(F.col("name").alias(col), F.col("name").alias("__exact")).distinct()
    by_key = items.groupBy(F.lower("name").alias("__key")).agg(F.min("name").alias("__near"))
    near = lookup_join(df.withColumn("__key", name_key(F.col(col))), by_key, ["__key"], "left", size=size)
    # Where the items are too many to broadcast, the names of ``df`` are distinct: none is hot.
    exact = F.broadcast(exact) if size <= joins.BROADCAST_BYTES else exact.hint("merge")
    return near.join(exact, [col], "left").select(*df.columns, F.coalesce("__exact", "__near").alias(out))


def _per_name(df: DataFrame, items: DataFrame, col: str, out: str, size: int) -> tuple[DataFrame, DataFrame]:
    """``df`` with ``out``, and the table it comes from: each distinct name once, resolved, with ``__n``,
    the number of its rows.

    Rows are read twice, to count the names and to join the answers back; all else works on the
    two tables of names, which are kept. So the hot names are known without another reading.
    """
    names = kept(df.groupBy(col).agg(F.count(F.lit(1)).alias("__n")), "names")
    found = kept(_resolved(names, items, col, out, size), "resolved")
    return lookup_join(df, found.drop("__n"), [col], "left", counts=found.select(col, "__n")), found


def resolve_item(
    df: DataFrame,
    items: DataFrame,
    col: str = "fragrance",
    out: str = "canonical",
) -> DataFrame:
    """Add the canonical name of a name as sold; NULL where the item is unknown.

    An exact match wins; else the trimmed, case-folded name without its "Plus" marker
    decides. Where the items are too many to broadcast, the distinct names (combined before they
    are shuffled) are resolved, and a name that many rows have is joined back without a shuffle.
    """
    size = 2 * measured_bytes(items.select("name"))
    if size <= joins.BROADCAST_BYTES:
        return _resolved(df, items, col, out, size)
    return _per_name(df, items, col, out, size)[0].select(*df.columns, out)


def _described(df: DataFrame, items: DataFrame, col: str, wanted: list[str]) -> DataFrame:
    """Notes and family are shuffled once, by item, however many spellings an item has."""
    # One row per name, so that a repeated item does not multiply the rows of ``df``.
    first = F.min(F.struct("notes", "family"))
    attributes = items.groupBy(F.col("name").alias("__canonical")).agg(first.alias("a")).select(
        "__canonical", *[F.col(f"a.{c}").alias(c) for c in wanted]
    )
    size = measured_bytes(items.select("name", "notes", "family"))
    if size <= joins.BROADCAST_BYTES:
        found, counts = resolve_item(df, items, col, "__canonical"), None
    else:
        names = 2 * measured_bytes(items.select("name"))
        found, by_name = _per_name(df, items, col, "__canonical", names)
        counts = by_name.groupBy("__canonical").agg(F.sum("__n").alias("__n"))
    found = lookup_join(found, attributes, ["__canonical"], "left", size=size, counts=counts)
    unknown = {"family": F.coalesce("family", F.lit("Unknown")).alias("family")}
    return found.select(*df.columns, *[unknown.get(c, F.col(c)) for c in wanted])


def item_attributes(
    df: DataFrame, items: DataFrame, col: str = "fragrance"
) -> DataFrame:
    """Add ``notes`` (NULL if unknown) and ``family`` ("Unknown" if unknown)."""
    return _described(df, items, col, ["notes", "family"])


def item_notes(df: DataFrame, items: DataFrame, col: str = "fragrance") -> DataFrame:
    return _described(df, items, col, ["notes"])


def item_family(df: DataFrame, items: DataFrame, col: str = "fragrance") -> DataFrame:
    return _described(df, items, col, ["family"])


def family_members(items: DataFrame, family: str) -> DataFrame:
    return items.filter(F.col("family") == family).select("name")


def item_list(items: DataFrame) -> DataFrame:
    return items.select("name")
