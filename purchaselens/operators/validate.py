"""Split a table into valid rows and rejected rows that say why."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import guards
from ..plans.joins import lookup_join


def rejection_reasons(rules: dict[str, Column]) -> Column:
    """Names of the broken rules; a rule that is NULL for a row counts as broken."""
    broken = [
        F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()
    ]
    # Joining skips NULLs and stays in generated code; array functions with lambdas do not.
    return F.array_remove(F.split(F.concat_ws("\n", *broken), "\n"), "")


def judge(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Add ``reasons``, empty where all rules hold: one pass for valid and rejected rows alike.
    To keep both, write the result partitioned by whether reasons are empty."""
    return df.withColumn("reasons", rejection_reasons(rules))


def split_valid(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected + ``reasons``): no row is lost and none is in both."""
    valid = reduce(
        lambda all_, rule: all_ & F.coalesce(rule, F.lit(False)), rules.values(), F.lit(True)
    )
    return df.filter(valid), df.filter(~valid).withColumn("reasons", rejection_reasons(rules))


def mark_known(
    df: DataFrame, allowed: DataFrame, col: str = "product_type", out: str = "known"
) -> DataFrame:
    """Add whether the category is in an allow-list table; NULL is not."""
    names = allowed.select(F.col(allowed.columns[0]).alias(col)).distinct()
    return lookup_join(df, names.withColumn(out, F.lit(True)), [col], "left").withColumn(
        out, F.coalesce(out, F.lit(False))
    )


def known_category(
    df: DataFrame, allowed: DataFrame, col: str = "product_type", keep: bool = True
) -> DataFrame:
    """Rows whose category is (or, with ``keep=False``, is not) in an allow-list table. For both
    at once use :func:`mark_known`."""
    return mark_known(df, allowed, col, "__known").filter(F.col("__known") == keep).drop("__known")


def transaction_rules(allowed: tuple[str, ...] | None = None) -> dict[str, Column]:
    """Rules for imported lines whose columns are still text."""
    return {
        "transaction_date": guards.valid_date(F.col("transaction_date").cast("string")),
        "guest_id": guards.valid_guest_id(F.col("guest_id")),
        "product_type": F.col("product_type").isNotNull()
        if allowed is None
        else guards.valid_category(F.col("product_type"), allowed),
        "fragrance": F.col("fragrance").isNull() | guards.valid_item_name(F.col("fragrance")),
        "price": F.col("price").try_cast("double").isNotNull(),
    }
