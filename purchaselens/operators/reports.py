"""The eight fixed purchase reports."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.money import from_units, money_avg, money_sum, round_to, units_sum
from ..schema import named


def in_range(start: date | str, end: date | str) -> Column:
    """Both ends included. The column is a DATE, so the last day counts in full."""
    return F.col("transaction_date").between(
        F.lit(start).cast("date"), F.lit(end).cast("date")
    )


def _repeat(df: DataFrame, times: str, chunk: int = 1000) -> DataFrame:
    """Each row ``times`` times, without ever building an array of that length."""
    n = F.col(times)
    chunks = df.withColumn("__chunk", F.explode(F.sequence(F.lit(0), F.floor((n - 1) / chunk))))
    left = F.least(F.lit(chunk).cast("bigint"), n - F.col("__chunk") * chunk)
    return chunks.withColumn("__copy", F.explode(F.sequence(F.lit(1), left))).drop(
        "__chunk", "__copy", times
    )


def cross_sell_exact(
    transactions: DataFrame, cat_a: str, cat_b: str, start: date | str, end: date | str
) -> DataFrame:
    """One row per (A line in range, B line at any time) of one guest in one fragrance.

    One scan, no self-join. Result rows carry no line identity, so lines are counted per day
    first; that leaves at most one entry per calendar day for even the busiest guest and
    fragrance. The days are paired, and the multiplicity is written out last.
    """
    is_a = (F.col("product_type") == cat_a) & in_range(start, end)
    is_b = F.col("product_type") == cat_b

    def days(lines: str) -> Column:
        entry = F.struct(F.col("transaction_date").alias("day"), F.col(lines).alias("lines"))
        return F.collect_list(F.when(F.col(lines) > 0, entry))

    paired = (
        transactions.filter(F.col("product_type").isin(cat_a, cat_b))
        .filter((is_a | is_b) & F.col("guest_id").isNotNull() & F.col("fragrance").isNotNull())
        .groupBy("guest_id", "fragrance", "transaction_date")
        .agg(F.count_if(is_a).alias("a_lines"), F.count_if(is_b).alias("b_lines"))
        .groupBy("guest_id", "fragrance")
        .agg(days("a_lines").alias("a_days"), days("b_lines").alias("b_days"))
        .filter((F.size("a_days") > 0) & (F.size("b_days") > 0))
        .withColumn("a", F.explode("a_days"))
        .withColumn("b", F.explode("b_days"))
        .select(
            "guest_id", "fragrance",
            F.col("a.day").alias("first_purchase_date"), F.col("a.lines").alias("a_lines"),
            F.col("b.day").alias("cross_sell_date"), F.col("b.lines").alias("b_lines"),
        )
    )
    return (
        _repeat(_repeat(paired, "a_lines"), "b_lines")
        .select(
            "guest_id",
            F.lit(cat_a).alias("first_purchase_category"),
            F.col("fragrance").alias("first_fragrance"),
            "first_purchase_date",
            F.lit(cat_b).alias("cross_sell_category"),
            F.col("fragrance").alias("cross_sell_fragrance"),
            "cross_sell_date",
        )
        .orderBy("guest_id", "first_purchase_date", "first_fragrance", "cross_sell_date")
    )


def category_affinity(
    transactions: DataFrame, category: str, start: date | str, end: date | str
) -> DataFrame:
    """What else the buyers of a category buy.

    The category is a case-insensitive part of the type name; its date range limits the
    buyers, not their other purchases. One scan: lines are counted per guest and type, and
    the few rows of a guest then tell whether it belongs to the cohort.
    """
    is_category = F.col("product_type").ilike(f"%{category}%")
    guest = Window.partitionBy("guest_id")
    bought = (
        transactions.groupBy("guest_id", "product_type")
        .agg(
            F.count("*").alias("lines"),
            F.coalesce(F.bool_or(is_category & in_range(start, end)), F.lit(False)).alias("target"),
        )
        .withColumn("in_cohort", F.max("target").over(guest))
        .filter("in_cohort")
        # One of the cohort rows of each guest stands for the guest.
        .withColumn("cohort_guest", F.row_number().over(guest.orderBy(F.desc("target"))) == 1)
    )
    by_type = bought.groupBy("product_type").agg(
        F.count("guest_id").alias("unique_guests"),
        F.sum(F.when(F.col("guest_id").isNotNull(), F.col("lines"))).alias("total_purchases"),
        F.count_if("cohort_guest").alias("cohort_guests"),
    )
    size = by_type.agg(F.sum("cohort_guests")).scalar()
    return (
        by_type.withColumn("size", size)
        .filter(~is_category & (F.col("unique_guests") > 0))
        .select(
            "product_type",
            "unique_guests",
            "total_purchases",
            round_to(F.col("unique_guests") * F.lit(100.0) / F.col("size"), 1).alias(
                "pct_of_target"
            ),
        )
        .orderBy(F.desc("unique_guests"), "product_type")
    )


def fragrance_loyalty(
    transactions: DataFrame, start: date | str, end: date | str, n: int = 100
) -> DataFrame:
    """Guests who buy one fragrance in at least two product types; the top ``n``."""
    return (
        transactions.filter(named() & in_range(start, end))
        .groupBy("guest_id", "fragrance")
        .agg(
            F.array_sort(F.collect_set("product_type")).alias("category_list"),
            F.count("*").alias("total_purchases"),
            money_sum("price").alias("total_spend"),
        )
        .withColumn("categories_purchased", F.size("category_list").cast("bigint"))
        .filter(F.col("categories_purchased") >= 2)
        .select(
            "guest_id", "fragrance", "categories_purchased", "category_list",
            "total_purchases", "total_spend",
        )
        .orderBy(
            F.desc("categories_purchased"), F.desc_nulls_last("total_spend"),
            F.asc_nulls_last("guest_id"), "fragrance",
        )
        .limit(n)
    )


def discount_impact(transactions: DataFrame, start: date | str, end: date | str) -> DataFrame:
    """Discounted against full-price purchases by type; a NULL discount is full price."""
    discount = F.col("discount_amount")
    net = F.col("price") - F.coalesce(discount, F.lit(0.0))
    return (
        transactions.filter(in_range(start, end))
        .groupBy(
            F.when(discount > 0, "Discounted").otherwise("Full Price").alias("purchase_type"),
            "product_type",
        )
        .agg(
            F.count("*").alias("transactions"),
            F.countDistinct("guest_id").alias("unique_guests"),
            round_to(money_avg("price"), 2).alias("avg_price"),
            round_to(money_avg(discount), 2).alias("avg_discount"),
            round_to(money_sum(net), 2).alias("net_revenue"),
        )
        .orderBy(F.asc_nulls_last("product_type"), "purchase_type")
    )


def channel_performance(transactions: DataFrame, start: date | str, end: date | str) -> DataFrame:
    """Reach and revenue by channel. "transactions" counts lines, as does the average.

    One scan: lines shrink to one row per channel, guest and type, and those to one per channel and guest and
    one per channel and type by one grouping. No line is repeated for the two distinct counts, and
    nothing per guest is gathered.
    """
    sums = ("lines", "prices", "price", "discount")
    bought = transactions.filter(in_range(start, end)).groupBy("channel", "guest_id", "product_type").agg(
        F.count("*").alias("lines"), F.count("price").alias("prices"),
        units_sum("price").alias("price"), units_sum("discount_amount").alias("discount"),
    )
    both = bought.groupingSets(
        [["channel", "guest_id"], ["channel", "product_type"]], "channel", "guest_id", "product_type"
    ).agg(F.grouping("guest_id").alias("by_type"), *[F.sum(c).alias(c) for c in sums])
    of_guest = F.col("by_type") == 0
    once = {c: F.sum(F.when(of_guest, F.col(c))) for c in sums}
    gross = from_units(once["price"])
    return (
        both.groupBy("channel")
        .agg(
            F.count(F.when(of_guest, F.col("guest_id"))).alias("unique_guests"),
            once["lines"].alias("transactions"),
            round_to(gross, 2).alias("gross_revenue"),
            round_to(gross / once["prices"], 2).alias("avg_order_value"),
            round_to(from_units(once["discount"]), 2).alias("total_discounts"),
            F.count(F.when(~of_guest, F.col("product_type"))).alias("categories_sold"),
        )
        .orderBy(F.desc_nulls_last("gross_revenue"), F.asc_nulls_last("channel"))
    )


def repeat_buyers(
    transactions: DataFrame,
    start: date | str,
    end: date | str,
    min_purchases: int = 1,
    n: int = 100,
) -> DataFrame:
    """Guests with at least ``min_purchases`` lines; the top ``n`` by lifetime value."""
    return (
        transactions.filter(in_range(start, end))
        .groupBy("guest_id")
        .agg(
            F.count("*").alias("purchase_count"),
            F.array_sort(F.collect_set("product_type")).alias("category_mix"),
            F.min("transaction_date").alias("first_purchase"),
            F.max("transaction_date").alias("last_purchase"),
            round_to(money_sum("price"), 2).alias("lifetime_value"),
        )
        .filter(F.col("purchase_count") >= min_purchases)
        .select(
            "guest_id",
            "purchase_count",
            F.size("category_mix").cast("bigint").alias("categories"),
            "first_purchase",
            "last_purchase",
            F.datediff("last_purchase", "first_purchase").cast("bigint").alias("days_span"),
            "lifetime_value",
            "category_mix",
        )
        .orderBy(F.desc_nulls_last("lifetime_value"), F.asc_nulls_last("guest_id"))
        .limit(n)
    )


def fragrance_popularity(
    transactions: DataFrame, start: date | str, end: date | str
) -> DataFrame:
    return (
        transactions.filter(named() & in_range(start, end))
        .groupBy("product_type", "fragrance")
        .agg(
            F.count("*").alias("purchases"),
            F.countDistinct("guest_id").alias("unique_guests"),
            round_to(money_sum("price"), 2).alias("revenue"),
        )
        .orderBy(F.asc_nulls_last("product_type"), F.desc("purchases"), "fragrance")
    )


def market_basket(
    transactions: DataFrame,
    start: date | str,
    end: date | str,
    n: int = 20,
    distinct_orders: bool = False,
) -> DataFrame:
    """Pairs of product types in one transaction; the top ``n``.

    A pair counts once per pair of lines, with the date range applied to the first line
    only; ``distinct_orders=True`` counts each transaction once instead.

    One scan, no self-join. Lines are first counted per transaction and type, which leaves a
    transaction with at most one entry per product type however many lines it has; pair
    counts are then products of line counts. An entry without a type rides along for each
    transaction in the range, so that the pair without types counts the orders.
    """
    entry = F.struct("product_type", "lines", "lines_in_range")
    baskets = (
        transactions.filter(F.col("transaction_id").isNotNull())
        .groupBy("transaction_id", "product_type")
        .agg(
            F.count("*").alias("lines"),
            F.count_if(in_range(start, end)).alias("lines_in_range"),
        )
        .groupBy("transaction_id")
        .agg(
            F.collect_list(F.when(F.col("product_type").isNotNull(), entry)).alias("types"),
            F.max("lines_in_range").alias("any_in_range"),
        )
        .filter(F.col("any_in_range") > 0)
    )
    order = F.struct(
        F.lit(None).cast("string").alias("product_type"),
        F.lit(1).cast("bigint").alias("lines"),
        F.lit(1).cast("bigint").alias("lines_in_range"),
    )
    a, b = F.col("a.product_type"), F.col("b.product_type")
    is_order = F.col("product_a").isNull()
    pairs = (
        baskets.select(F.explode(F.array_append("types", order)).alias("a"), "types")
        .filter(F.col("a.lines_in_range") > 0)
        .select("a", F.explode(F.when(a.isNull(), F.array(order)).otherwise(F.col("types"))).alias("b"))
        .filter(a.isNull() | (a < b))
        .groupBy(a.alias("product_a"), b.alias("product_b"))
        .agg(
            (F.count("*") if distinct_orders else F.sum(F.col("a.lines_in_range") * F.col("b.lines")))
            .alias("co_occurrences")
        )
    )
    ranked = (F.desc("co_occurrences"), "product_a", "product_b")
    # The order count sorts first, so n + 1 rows are enough for it and the top pairs.
    top = pairs.orderBy(F.desc(is_order), *ranked).limit(n + 1)
    orders = F.max(F.when(is_order, F.col("co_occurrences"))).over(Window.partitionBy(F.lit(0)))
    return (
        top.withColumn("orders", orders)
        .filter(~is_order)
        .select(
            "product_a",
            "product_b",
            "co_occurrences",
            round_to(F.col("co_occurrences") * F.lit(100.0) / F.col("orders"), 2).alias(
                "pct_of_orders"
            ),
        )
        .orderBy(*ranked)
    )
