"""Cohorts of buyers and cross-selling by similar fragrance."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.money import from_units, money_avg, money_sum, round_to, units_sum
from ..plans.joins import lookup_join
from ..plans.scratch import scratch_path
from ..schema import named
from .gate import recommendation_gate
from .reports import in_range

# Later than any date, as a day number.
NEVER = 10_000_000


def _cohort_lines(
    transactions: DataFrame, category: str, start: date | str, end: date | str
) -> DataFrame:
    return transactions.filter((F.col("product_type") == category) & in_range(start, end))


def cohort_guests(
    transactions: DataFrame, category: str, start: date | str, end: date | str
) -> DataFrame:
    """The distinct guests of a cohort."""
    return _cohort_lines(transactions, category, start, end).select("guest_id").where(
        "guest_id IS NOT NULL"
    ).distinct()


def cohort_stats(
    transactions: DataFrame, category: str, start: date | str, end: date | str
) -> DataFrame:
    return _cohort_lines(transactions, category, start, end).agg(
        F.countDistinct("guest_id").alias("unique_guests"),
        F.count("*").alias("total_purchases"),
        round_to(money_avg("price"), 2).alias("avg_price"),
        round_to(money_sum("price"), 2).alias("total_revenue"),
    )


def cohort_top_fragrances(
    transactions: DataFrame, category: str, start: date | str, end: date | str, n: int = 5
) -> DataFrame:
    return (
        _cohort_lines(transactions, category, start, end)
        .groupBy("fragrance")
        .agg(F.count("*").alias("cnt"))
        .orderBy(F.desc("cnt"), F.asc_nulls_last("fragrance"))
        .limit(n)
    )


def cohort_channel_mix(
    transactions: DataFrame, category: str, start: date | str, end: date | str
) -> DataFrame:
    return (
        _cohort_lines(transactions, category, start, end)
        .groupBy("channel")
        .agg(F.count("*").alias("cnt"))
        .orderBy(F.desc("cnt"), F.asc_nulls_last("channel"))
    )


def cohort_summary(
    transactions: DataFrame, category: str, start: date | str, end: date | str, n: int = 5
) -> DataFrame:
    """What :func:`cohort_stats`, :func:`cohort_top_fragrances` and :func:`cohort_channel_mix` say, as one
    row: the numbers, ``top_fragrances`` and ``channel_mix`` (arrays of structs, in the same order).

    The lines are read once: counts per guest, per fragrance and per channel come from one grouping
    and are stored, and the three answers are read from that table.
    """
    lines = _cohort_lines(transactions, category, start, end)
    counted = lines.groupBy("guest_id", "fragrance", "channel").agg(
        F.count("*").alias("cnt"), F.count("price").alias("prices"), units_sum("price").alias("price")
    ).groupingSets([["guest_id"], ["fragrance"], ["channel"]], "guest_id", "fragrance", "channel").agg(
        F.when(F.grouping("guest_id") == 0, "guest").when(F.grouping("fragrance") == 0, "fragrance")
        .otherwise("channel").alias("kind"),
        *[F.sum(c).alias(c) for c in ("cnt", "prices", "price")],
    ).withColumn("name", F.coalesce("guest_id", "fragrance", "channel")).select("kind", "name", "cnt", "prices", "price")
    path = scratch_path(transactions.sparkSession, "cohort")
    counted.write.partitionBy("kind").parquet(path)
    kinds = transactions.sparkSession.read.schema(counted.schema).parquet(path)

    def of(kind: str) -> DataFrame:
        return kinds.where(F.col("kind") == kind)

    def listed(kind: str, many: int | None) -> DataFrame:
        rows = of(kind).orderBy(F.desc("cnt"), F.asc_nulls_last("name"))
        entry = F.struct((-F.col("cnt")).alias("less"), F.col("name").isNull().alias("last"), "name", "cnt")
        return (rows if many is None else rows.limit(many)).agg(F.array_sort(F.collect_list(entry)).alias("found")).select(
            F.transform("found", lambda e: F.struct(e["name"].alias(kind), e["cnt"].alias("cnt"))).alias("found")
        )

    price = F.sum("price")
    return of("guest").agg(
        F.count("name").alias("unique_guests"), F.coalesce(F.sum("cnt"), F.lit(0)).alias("total_purchases"),
        round_to(from_units(price) / F.sum("prices"), 2).alias("avg_price"),
        round_to(from_units(price), 2).alias("total_revenue"),
    ).withColumns({
        "top_fragrances": listed("fragrance", n).scalar(), "channel_mix": listed("channel", None).scalar(),
    })


def _asked_items(df: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row per row of ``df`` and item similar to its ``fragrance`` (itself excluded), with
    ``item`` and ``similarity`` added. The pairs stay long: no row holds an item's whole list."""
    similar = pairs.filter(F.col("a") != F.col("b")).select(
        F.col("a").alias("fragrance"), F.col("b").alias("item"), "similarity"
    )
    return lookup_join(df, similar, ["fragrance"])


def cross_sell_similar(
    transactions: DataFrame,
    pairs: DataFrame,
    cat_a: str,
    cat_b: str,
    start: date | str,
    end: date | str,
) -> DataFrame:
    """How many buyers of A in the range ever bought B in the same or a similar fragrance.

    ``pairs`` are the ordered item pairs at or above the wanted threshold, as
    :func:`similarity_pairs` gives them. One row: cohort_size, cross_sell_count,
    conversion_rate in percent.

    One scan and no self-join. Lines shrink to one row per guest and fragrance that says
    whether A and B were bought in it; an A row then asks for each similar fragrance, and a
    guest is a hit where something is both asked for and bought. Every step is an
    aggregation that combines before it shuffles, so a guest or fragrance with a large
    share of all lines is no hot spot. A line without fragrance counts in the cohort and
    never matches.
    """
    is_a = (F.col("product_type") == cat_a) & in_range(start, end)
    is_b = F.col("product_type") == cat_b
    bought = (
        transactions.filter(F.col("product_type").isin(cat_a, cat_b))
        .filter(is_a | is_b)
        .groupBy("guest_id", F.when(named(), F.col("fragrance")).alias("fragrance"))
        .agg(F.bool_or(is_a).alias("a"), F.bool_or(is_b).alias("b"))
    )
    own = bought.select(
        "guest_id", F.col("fragrance").alias("item"), "a",
        (F.col("a") & F.col("fragrance").isNotNull()).alias("asked"),
        (F.col("b") & F.col("fragrance").isNotNull()).alias("b"),
    )
    asked = _asked_items(bought.filter("a AND fragrance IS NOT NULL"), pairs).select(
        "guest_id", "item", F.lit(False).alias("a"), F.lit(True).alias("asked"), F.lit(False).alias("b")
    )
    guests = (
        own.unionByName(asked)
        .groupBy("guest_id", "item")
        .agg(*[F.bool_or(f).alias(f) for f in ("a", "asked", "b")])
        .groupBy("guest_id")
        .agg(
            F.bool_or("a").alias("in_cohort"),
            F.bool_or(F.col("asked") & F.col("b")).alias("hit"),
        )
        .filter("in_cohort")
    )
    return guests.agg(
        F.count("guest_id").alias("cohort_size"),
        F.count_if(F.col("hit") & F.col("guest_id").isNotNull()).alias("cross_sell_count"),
    ).withColumn("conversion_rate", _percent("cross_sell_count", "cohort_size"))


def _percent(part: str, whole: str) -> Column:
    return round_to(F.col(part) * F.lit(100.0) / F.greatest(F.col(whole), F.lit(1)), 1)


def _purchases(lines: DataFrame, is_a: Column, is_b: Column, keys: list[str]) -> DataFrame:
    """One row per guest, fragrance and key: whether it holds an A purchase, and the day of its
    first B purchase, packed into one number.

    A and B side then need the same columns of the aggregate, so Spark computes and shuffles it
    once for both."""
    first_b = F.min(F.when(is_b, F.unix_date("transaction_date")))
    packed = F.coalesce(first_b, F.lit(NEVER)) * 2 + F.coalesce(
        F.bool_or(is_a), F.lit(False)
    ).cast("int")
    return lines.filter(is_a | is_b).groupBy("guest_id", "fragrance", *keys).agg(packed.alias("packed"))


def _matches(purchases: DataFrame, pairs: DataFrame, keys: dict[str, tuple[str, str]]) -> DataFrame:
    """Pair what each guest asked for by an A purchase with its B purchases.

    ``keys`` names the columns beside guest and fragrance that tell purchases apart, with their
    names on the A and the B side. One row per match: guest_id, the A columns, a_fragrance,
    similarity, the B columns, b_fragrance and b_date, the first day it was bought.
    """
    usable = purchases.filter(named() & F.col("guest_id").isNotNull())
    asked = usable.filter(F.pmod("packed", F.lit(2)) == 1)
    own = asked.withColumns({"item": F.col("fragrance"), "similarity": F.lit(1.0)})
    asks = own.unionByName(_asked_items(asked, pairs)).select(
        "guest_id", F.col("item").alias("b_fragrance"),
        *[F.col(k).alias(a) for k, (a, _) in keys.items()],
        F.col("fragrance").alias("a_fragrance"), "similarity",
    )
    day = F.floor(F.col("packed") / 2).cast("int")
    sells = usable.filter(day < NEVER).select(
        "guest_id",
        F.col("fragrance").alias("b_fragrance"),
        *[F.col(k).alias(b) for k, (_, b) in keys.items()],
        F.date_from_unix_date(day).alias("b_date"),
    )
    return asks.join(sells, ["guest_id", "b_fragrance"])


def cross_sell_matches(
    transactions: DataFrame,
    pairs: DataFrame,
    cat_a: str,
    cat_b: str,
    start: date | str,
    end: date | str,
    n: int = 20,
) -> DataFrame:
    """The first ``n`` matches: per guest and A fragrance the earliest B purchase.

    The first B fragrance in name order decides among purchases of one day.
    """
    is_a = (F.col("product_type") == cat_a) & in_range(start, end)
    is_b = F.col("product_type") == cat_b
    lines = transactions.filter(F.col("product_type").isin(cat_a, cat_b))
    best = F.min(F.struct("b_date", "b_fragrance", "similarity"))
    return (
        _matches(_purchases(lines, is_a, is_b, []), pairs, {})
        .groupBy("guest_id", "a_fragrance")
        .agg(best.alias("best"))
        .select(
            "guest_id",
            "a_fragrance",
            F.col("best.b_fragrance").alias("b_fragrance"),
            F.col("best.similarity").alias("similarity"),
        )
        .orderBy("guest_id", "a_fragrance")
        .limit(n)
    )


def cross_sell_recommendations(
    transactions: DataFrame,
    pairs: DataFrame,
    start: date | str,
    end: date | str,
    threshold: float,
    sample: int = 20,
) -> DataFrame:
    """The cross-sell question for every ordered pair of product types, each with its gate.

    One grouped job instead of one query per pair of types, from one aggregate of the lines by
    guest, fragrance and type. Pairs of types without any match are reported too, and refused
    by the gate.
    """
    kinds = ["category_a", "category_b"]
    purchases = _purchases(transactions, in_range(start, end), F.lit(True), ["product_type"])
    best = (
        _matches(purchases, pairs, {"product_type": tuple(kinds)})
        .filter(F.col("category_a") != F.col("category_b"))
        .groupBy(*kinds, "guest_id", "a_fragrance")
        .agg(F.min(F.struct("b_date", "b_fragrance")).alias("best"))
    )
    overlap = best.groupBy(*kinds, "guest_id").agg(F.lit(1).alias("one")).groupBy(*kinds).agg(
        F.count("*").alias("overlap_count")
    )
    # The rank is cut off before the rows are shuffled, so a pair of types with most of the
    # matches sends no more than ``sample`` rows a task.
    place = F.row_number().over(Window.partitionBy(*kinds).orderBy("guest_id", "a_fragrance"))
    shown = (
        best.withColumn("place", place).filter(F.col("place") <= sample)
        .groupBy(*kinds)
        .agg(F.array_sort(F.collect_list(F.struct(
            "place",
            F.concat("category_a", F.lit(" ("), "a_fragrance", F.lit(")")).alias("a"),
            F.concat("category_b", F.lit(" ("), "best.b_fragrance", F.lit(")")).alias("b"),
        ))).alias("shown"))
    )
    # The frame of the report: every ordered pair of type names, from one row per type.
    types = (
        purchases.groupBy("product_type", "guest_id").agg(F.max(F.pmod("packed", F.lit(2))).alias("inside"))
        .groupBy("product_type")
        .agg(F.count(F.when(F.col("inside") == 1, F.col("guest_id"))).alias("cohort_size"))
    )
    names = types.agg(F.collect_set("product_type")).scalar()
    frame = (
        types.withColumn("category_b", F.explode(names))
        .withColumnRenamed("product_type", "category_a")
        .filter((F.col("category_a") != F.col("category_b")) & (F.col("cohort_size") > 0))
    )
    text = [str(start), str(end), f"thr={threshold}"]
    pair = F.transform("shown", lambda e: F.struct(e["a"].alias("a"), e["b"].alias("b")))
    evidence = (
        frame.join(overlap, kinds, "left").join(shown, kinds, "left")
        .select(
            *kinds,
            "cohort_size",
            F.concat_ws("|", *kinds, *[F.lit(t) for t in text]).alias("cohort_id"),
            F.coalesce("overlap_count", F.lit(0)).alias("overlap_count"),
            F.lit(float(threshold)).alias("similarity_threshold"),
            F.coalesce(pair, F.array().cast("array<struct<a:string,b:string>>")).alias("fragrance_pairs"),
        )
        .withColumn("conversion_rate", _percent("overlap_count", "cohort_size"))
    )
    return recommendation_gate(evidence)


def cross_sell_recommendation(
    transactions: DataFrame,
    pairs: DataFrame,
    cat_a: str,
    cat_b: str,
    start: date | str,
    end: date | str,
    threshold: float,
    sample: int = 20,
) -> DataFrame:
    """The same for one ordered pair of types: its counts, its first matches and its gate in
    one row; no row if nobody bought A in the range, or nobody ever bought B."""
    lines = transactions.filter(F.col("product_type").isin(cat_a, cat_b))
    return cross_sell_recommendations(lines, pairs, start, end, threshold, sample).filter(
        (F.col("category_a") == cat_a) & (F.col("category_b") == cat_b)
    )
