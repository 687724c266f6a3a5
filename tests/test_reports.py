"""Reports against DuckDB on lines with NULLs, ties, repeats and a hot guest and order."""

import duckdb
import pytest
from pyspark.sql import functions as F

from purchaselens.operators import reports as r
from tests.compare import bag
from tests.lines import frame, line, random_lines
from workload.reports import affinity_sql, basket_sql, exact_cross_sell_sql

S, E = "2025-01-15", "2025-03-20"
RANGE = f"transaction_date BETWEEN DATE '{S}' AND DATE '{E}'"


def duck(rows):
    con = duckdb.connect()
    con.execute(
        """CREATE TABLE t (transaction_id VARCHAR, guest_id VARCHAR, transaction_date DATE,
        product_type VARCHAR, fragrance VARCHAR, price DOUBLE, discount_amount DOUBLE,
        discount_code VARCHAR, channel VARCHAR)"""
    )
    con.executemany("INSERT INTO t VALUES (?, ?, ?, ?, ?, ?, ?, ?, ?)", rows)
    return con


M = "CAST(SUM(CAST({0} AS DECIMAL(18,4))) AS DOUBLE)"
CASES = {
    "exact": (
        lambda t: r.cross_sell_exact(t, "Body Lotion", "Candle", S, E),
        exact_cross_sell_sql("Body Lotion", "Candle", RANGE, "t"),
    ),
    "exact_same_type": (
        lambda t: r.cross_sell_exact(t, "Candle", "Candle", S, E),
        exact_cross_sell_sql("Candle", "Candle", RANGE, "t"),
    ),
    "affinity": (lambda t: r.category_affinity(t, "body", S, E), affinity_sql("body", RANGE, "t")),
    "loyalty": (
        lambda t: r.fragrance_loyalty(t, S, E),
        f"""SELECT guest_id, fragrance, COUNT(DISTINCT product_type) categories_purchased,
        list_sort(ARRAY_AGG(DISTINCT product_type)) category_list, COUNT(*) total_purchases,
        {M.format('price')} total_spend FROM t WHERE fragrance <> '' AND {RANGE}
        GROUP BY 1, 2 HAVING COUNT(DISTINCT product_type) >= 2""",
    ),
    "discounts": (
        lambda t: r.discount_impact(t, S, E),
        f"""SELECT CASE WHEN discount_amount > 0 THEN 'Discounted' ELSE 'Full Price' END purchase_type,
        product_type, COUNT(*) transactions, COUNT(DISTINCT guest_id) unique_guests,
        ROUND({M.format('price')} / COUNT(price), 2) avg_price,
        ROUND({M.format('discount_amount')} / COUNT(discount_amount), 2) avg_discount,
        ROUND({M.format('price - COALESCE(discount_amount, 0)')}, 2) net_revenue
        FROM t WHERE {RANGE} GROUP BY 1, 2""",
    ),
    "channels": (
        lambda t: r.channel_performance(t, S, E),
        f"""SELECT channel, COUNT(DISTINCT guest_id) unique_guests, COUNT(*) transactions,
        ROUND({M.format('price')}, 2) gross_revenue,
        ROUND({M.format('price')} / COUNT(price), 2) avg_order_value,
        ROUND({M.format('discount_amount')}, 2) total_discounts,
        COUNT(DISTINCT product_type) categories_sold FROM t WHERE {RANGE} GROUP BY 1""",
    ),
    "repeat": (
        lambda t: r.repeat_buyers(t, S, E, 3),
        f"""SELECT guest_id, COUNT(*) purchase_count, COUNT(DISTINCT product_type) categories,
        MIN(transaction_date) first_purchase, MAX(transaction_date) last_purchase,
        CAST(DATEDIFF('day', MIN(transaction_date), MAX(transaction_date)) AS BIGINT) days_span,
        ROUND({M.format('price')}, 2) lifetime_value,
        list_sort(ARRAY_AGG(DISTINCT product_type)) category_mix
        FROM t WHERE {RANGE} GROUP BY 1 HAVING COUNT(*) >= 3""",
    ),
    "popularity": (
        lambda t: r.fragrance_popularity(t, S, E),
        f"""SELECT product_type, fragrance, COUNT(*) purchases,
        COUNT(DISTINCT guest_id) unique_guests, ROUND({M.format('price')}, 2) revenue
        FROM t WHERE fragrance <> '' AND {RANGE} GROUP BY 1, 2""",
    ),
    "basket": (lambda t: r.market_basket(t, S, E), basket_sql(RANGE, "t")),
    "basket_orders": (
        lambda t: r.market_basket(t, S, E, distinct_orders=True), basket_sql(RANGE, "t", per_order=True),
    ),
}


@pytest.mark.parametrize("name", CASES)
@pytest.mark.parametrize("seed", [1, 2])
def test_against_sql(spark, name, seed):
    rows = random_lines(seed=seed)
    report, text = CASES[name]
    cur = duck(rows).execute(text)
    want = bag([d[0] for d in cur.description], cur.fetchall())
    for parts in (1, 5):
        df = report(frame(spark, rows, parts))
        got = bag(df.columns, [tuple(x) for x in df.collect()])
        assert got == want, parts


def test_order_and_limits(spark):
    rows = [line(f"T{i}", f"G{i:03d}", "2025-02-01", k, "Beach", 5.0) for i in range(150) for k in ("A", "B")]
    top = r.fragrance_loyalty(frame(spark, rows, 4), S, E).collect()
    assert [x.guest_id for x in top] == [f"G{i:03d}" for i in range(100)]
    top = r.repeat_buyers(frame(spark, rows, 4), S, E, 1, n=7).collect()
    assert [x.guest_id for x in top] == [f"G{i:03d}" for i in range(7)]


def test_basket_limit_keeps_the_order_count(spark):
    kinds = [chr(65 + i) for i in range(9)]
    rows = [line("T1", "G", "2025-02-01", k, "x") for k in kinds]
    rows += [line("T2", "G", "2025-02-01", k, "x") for k in kinds[:2]]
    out = r.market_basket(frame(spark, rows), S, E, n=3).collect()
    assert [(x.product_a, x.product_b, x.co_occurrences, x.pct_of_orders) for x in out] == [
        ("A", "B", 2, 100.0), ("A", "C", 1, 50.0), ("A", "D", 1, 50.0)]


def test_empty_range(spark):
    t = frame(spark, random_lines(50))
    for report in (r.fragrance_loyalty, r.discount_impact, r.channel_performance,
                   r.fragrance_popularity, r.market_basket):
        assert report(t, "2025-03-20", "2025-01-15").count() == 0
    assert r.category_affinity(t, "body", "2025-03-20", "2025-01-15").count() == 0
    assert r.cross_sell_exact(t, "Candle", "Candle", "2030-01-01", "2030-02-01").count() == 0


def test_repeated_days_are_written_out(spark):
    rows = [line(f"T{i}", "G", "2025-02-01", "A", "x") for i in range(1203)]
    rows += [line("B1", "G", "2024-02-01", "B", "x"), line("B2", "G", "2024-02-01", "B", "x")]
    assert r.cross_sell_exact(frame(spark, rows, 3), "A", "B", S, E).count() == 2406


def test_last_day_counts_in_full(spark):
    t = frame(spark, [line("T", "G", E, "A", "x")])
    assert r.channel_performance(t, S, E).first().transactions == 1


def test_text_dates_are_cast(spark):
    from purchaselens.schema import as_transactions

    t = frame(spark, random_lines(50))
    text = t.withColumn("transaction_date", F.col("transaction_date").cast("string"))
    assert as_transactions(text).schema == t.schema
    assert as_transactions(text).exceptAll(t).count() == 0


def test_channel_types_are_counted_without_gathering_guests(spark):
    kinds = [f"K{i}" for i in range(6)]
    rows = [
        line(f"T{g}", f"G{g}", "2025-02-01", kind, "x", channel=channel)
        for channel, most in (("Online", 6), (None, 4), ("Fair", 0))
        for g in range(64) for i, kind in enumerate([*kinds[:most], None]) if kind is None or g >> i & 1
    ]
    out = r.channel_performance(frame(spark, rows, 5), S, E)
    assert {x.channel: (x.unique_guests, x.categories_sold) for x in out.collect()} == {
        "Online": (64, 6), None: (64, 4), "Fair": (64, 0)}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_set" not in plan and "collect_list" not in plan
