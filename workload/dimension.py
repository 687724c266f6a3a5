"""Item names, notes and families; the documents stand in for the item dimension."""

from __future__ import annotations

from pyspark.sql import functions as F

from purchaselens.operators import dimension as d

from .tables import ITEMS, items, read, sql


def _sold(spark, sf_dir):
    """Each order line with an item name as a till would print it: changed case, a "Plus"
    marker, a trailing blank, or an item that does not exist."""
    name = F.concat(F.lit("Brand#"), F.col("l_partkey").cast("string"))
    return read(spark, sf_dir, "lineitem").select(
        F.when(F.col("l_linenumber") == 1, F.concat(F.upper(name), F.lit("  PLUS")))
        .when(F.col("l_linenumber") == 2, F.concat(F.lit(" "), F.lower(name), F.lit(" Plus")))
        .when(F.col("l_linenumber") == 3, F.concat(F.lit("No "), name))
        .when(F.col("l_linenumber") == 4, F.concat(name, F.lit(" ")))
        .otherwise(name)
        .alias("fragrance")
    )


SOLD = """sold AS (
  SELECT CASE l_linenumber WHEN 1 THEN upper('Brand#' || l_partkey) || '  PLUS'
              WHEN 2 THEN ' ' || lower('Brand#' || l_partkey) || ' Plus'
              WHEN 3 THEN 'No Brand#' || l_partkey
              WHEN 4 THEN 'Brand#' || l_partkey || ' '
              ELSE 'Brand#' || l_partkey END AS fragrance
  FROM lineitem)"""
RESOLVED = """resolved AS (
  SELECT s.fragrance, COALESCE(x.name, y.name) AS canonical
  FROM sold s LEFT JOIN items x ON x.name = s.fragrance
  LEFT JOIN items y
    ON lower(y.name) = regexp_replace(lower(trim(s.fragrance)), ' {1,2}plus', '', 'g'))"""


def resolve_item(spark, sf_dir):
    return (
        d.resolve_item(_sold(spark, sf_dir), items(spark, sf_dir))
        .groupBy("fragrance", "canonical")
        .agg(F.count("*").alias("lines"))
    )


RESOLVE_ITEM = sql(ITEMS, SOLD, RESOLVED, select="""
SELECT fragrance, canonical, COUNT(*) AS lines FROM resolved GROUP BY 1, 2""")


def item_notes(spark, sf_dir):
    return (
        d.item_notes(_sold(spark, sf_dir), items(spark, sf_dir))
        .groupBy("fragrance")
        .agg(F.count("*").alias("lines"), F.max(F.md5("notes")).alias("notes_md5"))
    )


ITEM_NOTES = sql(ITEMS, SOLD, RESOLVED, select="""
SELECT fragrance, COUNT(*) AS lines, MAX(md5(notes)) AS notes_md5
FROM resolved r LEFT JOIN items i ON i.name = r.canonical GROUP BY 1""")


def item_family(spark, sf_dir):
    return (
        d.item_family(_sold(spark, sf_dir), items(spark, sf_dir))
        .groupBy("family")
        .agg(F.count("*").alias("lines"))
    )


ITEM_FAMILY = sql(ITEMS, SOLD, RESOLVED, select="""
SELECT COALESCE(family, 'Unknown') AS family, COUNT(*) AS lines
FROM resolved r LEFT JOIN items i ON i.name = r.canonical GROUP BY 1""")


def family_members(spark, sf_dir):
    return d.family_members(items(spark, sf_dir), "fr")


def item_list(spark, sf_dir):
    return d.item_list(items(spark, sf_dir))


QUERIES = {
    "resolve_item": (resolve_item, RESOLVE_ITEM),
    "item_notes": (item_notes, ITEM_NOTES),
    "item_family": (item_family, ITEM_FAMILY),
    "family_members": (
        family_members, sql(ITEMS, select="SELECT name FROM items WHERE family = 'fr'")
    ),
    "item_list": (item_list, sql(ITEMS, select="SELECT name FROM items")),
}
