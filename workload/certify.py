"""Fingerprints, freshness, quality checks and readiness of the document dimension."""

from __future__ import annotations

from pyspark.sql import functions as F

from purchaselens.functions.text import SCENT_TERMS, TONE_WORDS
from purchaselens.operators import certify as c
from purchaselens.plans.scratch import scratch_path

from .tables import ITEMS, items, read, sql

COMPONENTS = ("documents", "labels", "pages", "conversations", "benchmark")
COLUMNS = {
    "benchmark": ("item_id", "text"),
    "conversations": ("conv_id", "role", "text", "turn"),
    "documents": ("doc_id", "lang", "n_chars", "source", "text"),
    "labels": ("doc_id", "quality", "toxic"),
    "pages": ("html", "page_id", "url"),
}


def _print_sql(component, table, columns):
    """The fingerprint of a table from its columns in name order."""
    parts = ", ".join(
        f"COALESCE('{k}=' || length(CAST({v} AS VARCHAR)) || ':' || CAST({v} AS VARCHAR), '{k}~')"
        for k, v in columns
    )
    words = [f"substr(h, {1 + 5 * i}, 5)" for i in range(12)] + ["substr(h, 61, 4)"]
    sums = ", ".join(
        f"CAST(COALESCE(SUM(CAST('0x' || {w} AS BIGINT)), 0) AS VARCHAR)" for w in words
    )
    return f"""
SELECT '{component}' AS component, COUNT(*) AS row_count,
       sha256(concat_ws(',', CAST(COUNT(*) AS VARCHAR), {sums})) AS sha256
FROM (SELECT sha256(concat_ws(';', {parts})) AS h FROM {table})"""


def table_fingerprint(spark, sf_dir):
    return c.manifest({t: read(spark, sf_dir, t) for t in COMPONENTS})


EACH = "\nUNION ALL ".join(
    _print_sql(t, t, [(col, col) for col in COLUMNS[t]]) for t in sorted(COMPONENTS)
)
MANIFEST = f"""
WITH each AS ({EACH})
SELECT * FROM each
UNION ALL
SELECT '*', CAST(SUM(row_count) AS BIGINT),
       sha256(string_agg(component || ':' || sha256, chr(10) ORDER BY component)) FROM each"""

ITEM_PRINT = _print_sql(
    "items", "items",
    [("family", "family"), ("name", "name"), ("notes", "notes"),
     ("tags", "('[\"' || tags[1] || '\"]')")],
)


def index_fingerprint(spark, sf_dir):
    return c.table_fingerprint(items(spark, sf_dir), "items")


def _stored_index(spark, sf_dir):
    path = scratch_path(spark, "index")
    c.build_index(items(spark, sf_dir), path)
    return path


def is_stale(spark, sf_dir):
    """An index against its own dimension, against one with changed notes, and an index
    that never had a fingerprint."""
    path = _stored_index(spark, sf_dir)
    own = items(spark, sf_dir)
    changed = own.withColumn("notes", F.concat("notes", F.when(F.col("family") == "fr", "!").otherwise("")))
    stored = c.load_index(spark, path, own)

    def case(name, index, dimension):
        return c.index_freshness(index, dimension).select(
            F.lit(name).alias("case"), "stored", "is_stale"
        )

    return (
        case("own", stored, own)
        .unionByName(case("changed", stored, changed))
        .unionByName(case("unmarked", stored.drop("fingerprint"), own))
    )


IS_STALE = sql(ITEMS, f"print AS ({ITEM_PRINT})", select="""
SELECT v.name AS "case", CASE WHEN v.name <> 'unmarked' THEN sha256 END AS stored,
       v.name <> 'own' AS is_stale
FROM print, (VALUES ('own'), ('changed'), ('unmarked')) v(name)""")


def _checks(spark, sf_dir):
    path = _stored_index(spark, sf_dir)
    dimension = items(spark, sf_dir)
    return c.quality_checks(dimension, 4, spark.read.parquet(path))


def quality_checks(spark, sf_dir):
    return _checks(spark, sf_dir)


_WORDS = ", ".join(f"'{t}'" for t in SCENT_TERMS if " " not in t)
_PHRASES = " + ".join(
    f"(length(low) - length(replace(low, '{t}', ''))) // {len(t)}" for t in SCENT_TERMS if " " in t
)
_TONE = " OR ".join(f"contains(low, '{t}')" for t in TONE_WORDS)
CHECKS = (ITEMS, "words AS (SELECT *, lower(notes) AS low FROM items)", f"""judged AS (
  SELECT *, ({_TONE}) AND (
    len(list_filter(regexp_extract_all(low, '[a-z]+'), lambda w: w IN ({_WORDS}))) + {_PHRASES})
    < 0.25 * GREATEST(len(regexp_extract_all(low, '[a-z]+')), 1)
    OR NOT regexp_matches(notes, '\\S') AS fluff FROM words)""", """measured AS (
  SELECT COUNT(*) AS n, COUNT(name) - COUNT(DISTINCT name) AS repeated, COUNT(DISTINCT family) AS families,
         COUNT(*) FILTER (family IS NULL) AS no_family, COUNT(*) FILTER (notes IS NULL) AS no_text,
         COUNT(*) FILTER (length(notes) <= 10) AS short_text, COUNT(*) FILTER (fluff) AS fluff
  FROM judged)""", f"print AS ({ITEM_PRINT})", """checks AS (
  SELECT 'data_model' AS suite, k AS check_name, CASE WHEN ok THEN 'passed' ELSE 'failed' END
         AS status, CAST(x AS VARCHAR) AS evidence
  FROM (SELECT 'items_present' AS k, n > 0 AS ok, n AS x FROM measured
        UNION ALL SELECT 'unique_names', repeated = 0, repeated FROM measured
        UNION ALL SELECT 'expected_families', families = 4, families FROM measured
        UNION ALL SELECT 'family_present', no_family = 0, no_family FROM measured
        UNION ALL SELECT 'text_present', no_text = 0, no_text FROM measured
        UNION ALL SELECT 'text_long_enough', short_text = 0, short_text FROM measured
        UNION ALL SELECT 'no_fluff', fluff = 0, fluff FROM measured)
  UNION ALL SELECT 'embedding', 'index_fresh', 'passed', sha256 FROM print)""")


def readiness(spark, sf_dir):
    return c.readiness(_checks(spark, sf_dir))


READINESS = sql(*CHECKS, """verdict AS (
  SELECT COALESCE(BOOL_AND(status = 'passed') FILTER (check_name IN
           ('items_present', 'unique_names', 'expected_families', 'family_present')), FALSE) AS model,
         COALESCE(BOOL_AND(status = 'passed') FILTER (check_name IN
           ('text_present', 'text_long_enough', 'no_fluff')), FALSE) AS profiles FROM checks)""",
select="""
SELECT CASE WHEN model AND profiles THEN 'INDEX_CERTIFIED' WHEN model THEN 'DATA_MODEL_VALIDATED'
            ELSE 'BASELINE_CAPTURED' END AS label,
       CASE WHEN model AND profiles THEN 'passed: index_fresh'
            WHEN model THEN 'passed: items_present, unique_names, expected_families, family_present'
            ELSE 'checks were run' END AS reason
FROM verdict""")

QUERIES = {
    "index_fingerprint": (index_fingerprint, sql(ITEMS, select=ITEM_PRINT)),
    "is_stale": (is_stale, IS_STALE),
    "quality_checks": (quality_checks, sql(*CHECKS, select="SELECT * FROM checks")),
    "readiness": (readiness, READINESS),
    "table_fingerprint": (table_fingerprint, MANIFEST),
}
