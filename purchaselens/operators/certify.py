"""Fingerprints, index freshness, quality checks and the readiness they prove."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import fluff_flag
from .similarity import TextEncoder, embed_profiles

class StaleIndex(RuntimeError):
    """The stored index was not built from this dimension; rebuild it."""


def _canonical(col: str, kind: T.DataType) -> Column:
    nested = isinstance(kind, (T.ArrayType, T.StructType, T.MapType))
    text = F.to_json(col) if nested else F.col(col).cast("string")
    filled = F.concat(F.lit(f"{col}="), F.length(text).cast("string"), F.lit(":"), text)
    return F.coalesce(filled, F.lit(f"{col}~"))


def row_hash(df: DataFrame) -> Column:
    """SHA-256 of a row: its columns in name order, each with its length, NULLs marked."""
    parts = [_canonical(f.name, f.dataType) for f in sorted(df.schema, key=lambda f: f.name)]
    return F.sha2(F.concat_ws(";", *parts), 256)


def table_fingerprint(df: DataFrame, component: str = "table") -> DataFrame:
    """(component, row_count, sha256) of a table as a bag of rows.

    Row hashes are added word by word, so the result depends neither on order nor on
    partitioning, duplicates count, and each task sends on one row: nothing is sorted or
    gathered.
    """
    # Four numbers of 60 bits and the last 16 bits; the former give three 20-bit words each.
    # Sums of 20-bit words stay within 64 bits for more than 8e12 rows.
    numbers = [
        F.conv(F.substring("h", 1 + 15 * i, 15), 16, 10).cast("bigint").alias(f"n{i}")
        for i in range(5)
    ]
    words = [
        F.shiftright(f"n{i}", shift).bitwiseAND(F.lit(0xFFFFF))
        for i in range(4)
        for shift in (40, 20, 0)
    ]
    sums = [F.coalesce(F.sum(w), F.lit(0)).cast("string") for w in [*words, F.col("n4")]]
    return (
        df.select(row_hash(df).alias("h"))
        .select(*numbers)
        .agg(
            F.count("*").alias("row_count"),
            F.concat_ws(",", F.count("*").cast("string"), *sums).alias("sums"),
        )
        .select(F.lit(component).alias("component"), "row_count", F.sha2("sums", 256).alias("sha256"))
    )


def manifest(components: dict[str, DataFrame]) -> DataFrame:
    """Fingerprint of each named table and, as component ``*``, of them all."""
    each = reduce(
        DataFrame.unionByName,
        [table_fingerprint(df, name) for name, df in sorted(components.items())],
    )
    lines = F.array_sort(F.collect_list(F.concat("component", F.lit(":"), "sha256")))
    overall = each.agg(
        F.lit("*").alias("component"),
        F.sum("row_count").alias("row_count"),
        F.sha2(F.array_join(lines, "\n"), 256).alias("sha256"),
    )
    return each.unionByName(overall)


# -- the vector index --------------------------------------------------------------------


def build_index(
    items: DataFrame, path: str, encoder: TextEncoder | Callable[[Column], Column] | None = None
) -> None:
    """Embed the notes of a dimension and store the vectors with its fingerprint."""
    print_ = table_fingerprint(items, "items").select("sha256").scalar()
    embed_profiles(items, "notes", encoder).select(
        "name", "family", "vector", print_.alias("fingerprint")
    ).write.mode("overwrite").parquet(path)


def index_freshness(index: DataFrame, items: DataFrame) -> DataFrame:
    """One row (stored, current, is_stale); no fingerprint or a mixed one is stale."""
    current = table_fingerprint(items, "items").select("sha256").scalar()
    stored = F.col("fingerprint") if "fingerprint" in index.columns else F.lit(None).cast("string")
    return (
        index.agg(F.min(stored).alias("stored"), F.max(stored).alias("__max"),
                  F.count("*").alias("__rows"), F.count(stored).alias("__filled"))
        .withColumn("current", current)
        .select(
            "stored",
            "current",
            (
                F.coalesce(F.col("stored") != F.col("current"), F.lit(True))
                | F.coalesce(F.col("__max") != F.col("stored"), F.lit(True))
                | (F.col("__rows") != F.col("__filled"))
            ).alias("is_stale"),
        )
    )


def load_index(spark: SparkSession, path: str, items: DataFrame, strict: bool = True) -> DataFrame:
    """Read a stored index; with ``strict`` refuse one that does not belong to ``items``."""
    index = spark.read.parquet(path)
    if strict and index_freshness(index, items).first()["is_stale"]:
        raise StaleIndex(f"the index at {path} does not match its dimension; rebuild it")
    return index


# -- checks ------------------------------------------------------------------------------

CHECK_SCHEMA = "suite string, check_name string, status string, evidence string"


def _checks(row: DataFrame, suite: str, checks: dict[str, tuple[Column, Column]]) -> DataFrame:
    """One row of measured columns to one row per check; a NULL verdict is a skip."""
    verdicts = [
        F.struct(
            F.lit(suite).alias("suite"),
            F.lit(name).alias("check_name"),
            F.when(ok, "passed").when(~ok, "failed").otherwise("skipped").alias("status"),
            evidence.cast("string").alias("evidence"),
        )
        for name, (ok, evidence) in checks.items()
    ]
    return row.select(F.explode(F.array(*verdicts)).alias("c")).select("c.*")


def quality_checks(
    items: DataFrame,
    families: int = 8,
    index: DataFrame | None = None,
    text_col: str = "notes",
    terms: Iterable[str] | None = None,
) -> DataFrame:
    """(suite, check_name, status, evidence) of a dimension and, if given, of its index.

    One aggregate over the dimension answers all its checks.
    """
    text = F.col(text_col)
    flag = fluff_flag(text) if terms is None else fluff_flag(text, terms=terms)
    measured = items.agg(
        F.count("*").alias("rows"),
        (F.count("name") - F.countDistinct("name")).alias("repeated"),
        F.size(F.collect_set("family")).cast("bigint").alias("families"),
        F.count_if(F.col("family").isNull()).alias("no_family"),
        F.count_if(text.isNull()).alias("no_text"),
        F.count_if(F.length(text) <= 10).alias("short_text"),
        F.count_if(flag).alias("fluff"),
    )
    found = _checks(
        measured,
        "data_model",
        {
            "items_present": (F.col("rows") > 0, F.col("rows")),
            "unique_names": (F.col("repeated") == 0, F.col("repeated")),
            "expected_families": (F.col("families") == families, F.col("families")),
            "family_present": (F.col("no_family") == 0, F.col("no_family")),
            "text_present": (F.col("no_text") == 0, F.col("no_text")),
            "text_long_enough": (F.col("short_text") == 0, F.col("short_text")),
            "no_fluff": (F.col("fluff") == 0, F.col("fluff")),
        },
    )
    if index is None:
        nothing = F.lit(None).cast("boolean")
        fresh = _checks(
            measured.select("rows"), "embedding", {"index_fresh": (nothing, F.lit(None))}
        )
    else:
        fresh = _checks(
            index_freshness(index, items),
            "embedding",
            {"index_fresh": (~F.col("is_stale"), F.col("stored"))},
        )
    return found.unionByName(fresh)


# The labels. Rungs of the default ladder, lowest first: label, checks that prove it, and the label that
# must be proven before it, if any.
LADDER = (
    ("BASELINE_CAPTURED", (), None),
    ("DATA_MODEL_VALIDATED", ("items_present", "unique_names", "expected_families", "family_present"), None),
    ("PROFILES_ACCEPTED", ("text_present", "text_long_enough", "no_fluff"),
     "DATA_MODEL_VALIDATED"),
    ("INDEX_CERTIFIED", ("index_fresh",), "PROFILES_ACCEPTED"),
)


def readiness(
    checks: DataFrame, ladder: Iterable[tuple[str, tuple[str, ...], str | None]] = LADDER
) -> DataFrame:
    """The highest rung that evidence proves: (label, reason).

    A rung is proven when all its checks ran and passed and its prerequisite is proven; a
    skipped or missing check proves nothing, and a check reported twice must pass twice.
    """
    ladder = list(ladder)
    names = sorted({c for _, needed, _ in ladder for c in needed})

    def passed(name: str) -> Column:
        hit = F.col("check_name") == name
        return (F.count_if(hit) > 0) & (
            F.count_if(hit) == F.count_if(hit & (F.col("status") == "passed"))
        )

    verdict = checks.agg(F.count("*").alias("__n"), *[passed(n).alias(n) for n in names])
    proven: dict[str, Column] = {}
    label, reason = F.lit(None).cast("string"), F.lit("no check was run")
    for name, needed, after in ladder:
        ok = reduce(lambda c, n: c & F.col(n), needed, F.col("__n") > 0)
        if after is not None:
            ok = ok & proven[after]
        proven[name] = ok
        why = "passed: " + ", ".join(needed) if needed else "checks were run"
        label, reason = F.when(ok, name).otherwise(label), F.when(ok, why).otherwise(reason)
    return verdict.select(label.alias("label"), reason.alias("reason"))
