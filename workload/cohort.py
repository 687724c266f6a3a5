"""Cohorts, cross-selling by similarity and its recommendations."""

from __future__ import annotations

from pyspark.sql import functions as F

from purchaselens.operators import cohort as c
from purchaselens.operators.gate import recommendation_gate

from .reports import A, B, QUARTER
from .tables import INDEX, TRANSACTIONS, average, money, offered, pairs_sql, read, sql, stored_pairs
from .tables import transactions

# The vectors of the supplied tables are far apart, so the similar half of the question
# needs a low threshold to be exercised; 0.6 is left with equal fragrances only.
THRESHOLD = 0.15
WHEN = f"transaction_date BETWEEN DATE '{QUARTER[0]}' AND DATE '{QUARTER[1]}'"


def cohort_stats(spark, sf_dir):
    return c.cohort_stats(transactions(spark, sf_dir), A, *QUARTER)


COHORT_STATS = sql(TRANSACTIONS, select=f"""
SELECT COUNT(DISTINCT guest_id) AS unique_guests, COUNT(*) AS total_purchases,
       ROUND({average('price')}, 2) AS avg_price, ROUND({money('price')}, 2) AS total_revenue
FROM transactions WHERE product_type = '{A}' AND {WHEN}""")


def cohort_top_fragrances(spark, sf_dir):
    return c.cohort_top_fragrances(transactions(spark, sf_dir), A, *QUARTER)


COHORT_TOP = sql(TRANSACTIONS, select=f"""
SELECT fragrance, COUNT(*) AS cnt FROM transactions WHERE product_type = '{A}' AND {WHEN}
GROUP BY fragrance ORDER BY cnt DESC, fragrance LIMIT 5""")


def cohort_channel_mix(spark, sf_dir):
    return c.cohort_channel_mix(transactions(spark, sf_dir), A, *QUARTER)


COHORT_CHANNELS = sql(TRANSACTIONS, select=f"""
SELECT channel, COUNT(*) AS cnt FROM transactions WHERE product_type = '{A}' AND {WHEN}
GROUP BY channel""")


def cohort_summary(spark, sf_dir):
    """All three answers about a cohort from one reading of the lines; each list as one text."""
    out = c.cohort_summary(transactions(spark, sf_dir), A, *QUARTER, n=7)

    def shown(name, key):
        return F.array_join(F.transform(name, lambda e: F.concat_ws(":", F.coalesce(e[key], F.lit("-")), e["cnt"])), "|")

    return out.withColumns({
        "top_fragrances": shown("top_fragrances", "fragrance"), "channel_mix": shown("channel_mix", "channel"),
    })


COHORT_SUMMARY = sql(TRANSACTIONS, f"""cohort AS (
  SELECT * FROM transactions WHERE product_type = '{A}' AND {WHEN})""", select=f"""
SELECT COUNT(DISTINCT guest_id) AS unique_guests, COUNT(*) AS total_purchases,
       ROUND({average('price')}, 2) AS avg_price, ROUND({money('price')}, 2) AS total_revenue,
       (SELECT string_agg(f || ':' || n, '|' ORDER BY n DESC, f) FROM (
          SELECT fragrance AS f, COUNT(*) AS n FROM cohort GROUP BY 1 ORDER BY n DESC, f LIMIT 7)) AS top_fragrances,
       (SELECT string_agg(f || ':' || n, '|' ORDER BY n DESC, f) FROM (
          SELECT channel AS f, COUNT(*) AS n FROM cohort GROUP BY 1)) AS channel_mix
FROM cohort""")


def _similar(threshold):
    def run(spark, sf_dir):
        pairs = stored_pairs(spark, sf_dir, threshold, offered(spark, sf_dir))
        return c.cross_sell_similar(transactions(spark, sf_dir), pairs, A, B, *QUARTER)

    return run


def _similar_sql(threshold):
    return sql(TRANSACTIONS, INDEX, pairs_sql(threshold), f"""cohort AS (
  SELECT DISTINCT guest_id, fragrance FROM transactions
  WHERE product_type = '{A}' AND {WHEN})""", f"""hits AS (
  SELECT DISTINCT k.guest_id FROM cohort k
  WHERE EXISTS (SELECT 1 FROM transactions t WHERE t.guest_id = k.guest_id
                AND t.product_type = '{B}' AND t.fragrance = k.fragrance)
     OR EXISTS (SELECT 1 FROM transactions t JOIN pairs p ON p.b = t.fragrance
                WHERE t.guest_id = k.guest_id AND t.product_type = '{B}'
                AND p.a = k.fragrance))""", select="""
SELECT COUNT(DISTINCT k.guest_id) AS cohort_size, COUNT(DISTINCT h.guest_id) AS cross_sell_count,
       ROUND(COUNT(DISTINCT h.guest_id) * 100.0 / GREATEST(COUNT(DISTINCT k.guest_id), 1), 1)
         AS conversion_rate
FROM cohort k LEFT JOIN hits h ON k.guest_id = h.guest_id""")


# Every (guest, A scent) with its best B purchase.
BEST = f"""best AS (
  SELECT * FROM (
    SELECT k.guest_id, k.fragrance AS a_fragrance, t.fragrance AS b_fragrance,
           CASE WHEN t.fragrance = k.fragrance THEN 1.0 ELSE p.similarity END AS similarity,
           ROW_NUMBER() OVER (PARTITION BY k.guest_id, k.fragrance
                              ORDER BY t.transaction_date, t.fragrance) AS rn
    FROM (SELECT DISTINCT guest_id, fragrance FROM transactions
          WHERE product_type = '{A}' AND {WHEN}) k
    JOIN transactions t ON t.guest_id = k.guest_id AND t.product_type = '{B}'
    LEFT JOIN pairs p ON p.a = k.fragrance AND p.b = t.fragrance
    WHERE t.fragrance = k.fragrance OR p.similarity IS NOT NULL) WHERE rn = 1)"""


def cross_sell_matches(spark, sf_dir):
    pairs = stored_pairs(spark, sf_dir, THRESHOLD, offered(spark, sf_dir))
    out = c.cross_sell_matches(transactions(spark, sf_dir), pairs, A, B, *QUARTER)
    return out.withColumn("similarity", F.round("similarity", 6))


CROSS_SELL_MATCHES = sql(TRANSACTIONS, INDEX, pairs_sql(THRESHOLD), BEST, select="""
SELECT guest_id, a_fragrance, b_fragrance, ROUND(similarity, 6) AS similarity
FROM best ORDER BY guest_id, a_fragrance LIMIT 20""")


def cross_sell_recommendations(spark, sf_dir):
    pairs = stored_pairs(spark, sf_dir, THRESHOLD, offered(spark, sf_dir))
    out = c.cross_sell_recommendations(
        transactions(spark, sf_dir), pairs, *QUARTER, threshold=THRESHOLD
    )
    return out.select(
        "cohort_id", "cohort_size", "overlap_count", "conversion_rate", "confidence",
        "allowed_to_recommend",
        F.array_join(
            F.transform("fragrance_pairs", lambda p: F.concat(p.a, F.lit(" > "), p.b)), "; "
        ).alias("fragrance_pairs"),
    )


RECOMMENDATIONS = sql(TRANSACTIONS, INDEX, pairs_sql(THRESHOLD), f"""cohort AS (
  SELECT DISTINCT guest_id, product_type, fragrance FROM transactions WHERE {WHEN})""",
"""bought AS (
  SELECT guest_id, product_type, fragrance, MIN(transaction_date) AS first_day
  FROM transactions GROUP BY 1, 2, 3)""", """matches AS (
  SELECT k.product_type AS category_a, t.product_type AS category_b, k.guest_id,
         k.fragrance AS a_fragrance, t.fragrance AS b_fragrance,
         ROW_NUMBER() OVER (PARTITION BY k.product_type, t.product_type, k.guest_id, k.fragrance
                            ORDER BY t.first_day, t.fragrance) AS rn
  FROM cohort k JOIN bought t ON t.guest_id = k.guest_id AND t.product_type <> k.product_type
  LEFT JOIN pairs p ON p.a = k.fragrance AND p.b = t.fragrance
  WHERE t.fragrance = k.fragrance OR p.similarity IS NOT NULL)""", """ranked AS (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY category_a, category_b
                               ORDER BY guest_id, a_fragrance) AS place
  FROM matches WHERE rn = 1)""", """counts AS (
  SELECT category_a, category_b, COUNT(DISTINCT guest_id) AS overlap_count,
         string_agg(category_a || ' (' || a_fragrance || ') > ' || category_b || ' (' ||
                    b_fragrance || ')', '; ' ORDER BY place) FILTER (place <= 20) AS sample
  FROM ranked GROUP BY 1, 2)""", """frame AS (
  SELECT x.product_type AS category_a, y.product_type AS category_b, x.cohort_size
  FROM (SELECT product_type, COUNT(DISTINCT guest_id) AS cohort_size FROM cohort GROUP BY 1) x
  JOIN (SELECT DISTINCT product_type FROM transactions) y
    ON x.product_type <> y.product_type)""", select=f"""
SELECT f.category_a || '|' || f.category_b || '|{QUARTER[0]}|{QUARTER[1]}|thr={THRESHOLD}'
         AS cohort_id,
       cohort_size, COALESCE(overlap_count, 0) AS overlap_count,
       ROUND(COALESCE(overlap_count, 0) * 100.0 / GREATEST(cohort_size, 1), 1)
         AS conversion_rate,
       CASE WHEN COALESCE(overlap_count, 0) <= 0 THEN 'none' ELSE 'low' END AS confidence,
       COALESCE(overlap_count, 0) > 0 AS allowed_to_recommend,
       COALESCE(sample, '') AS fragrance_pairs
FROM frame f LEFT JOIN counts c USING (category_a, category_b)""")


def gate(spark, sf_dir):
    """Every customer as a row of evidence whose fields come from its balance and segment."""
    balance = F.col("c_acctbal")
    evidence = read(spark, sf_dir, "customer").select(
        F.col("c_name").alias("cohort_id"),
        F.floor(balance / 100).cast("bigint").alias("overlap_count"),
        F.when(F.col("c_nationkey") != 3, F.round(F.col("c_nationkey") / 20.0, 2)).alias(
            "similarity_threshold"
        ),
        F.when(F.col("c_nationkey") > 20, balance / 1000).alias("lift"),
        F.when(F.col("c_nationkey") > 22, F.lit(0.5)).alias("baseline_rate"),
        F.when(F.col("c_mktsegment") == "BUILDING", "This Will Boost sales")
        .when(F.col("c_mktsegment") == "MACHINERY", "guaranteed to sell 100%")
        .otherwise("a hypothesis to test")
        .alias("recommendation"),
    )
    return recommendation_gate(evidence).select(
        "cohort_id", "overlap_count", "confidence", "allowed_to_recommend",
        F.when(F.col("reason").contains("overlap in the cohort"), "overlap")
        .when(F.col("reason").contains("similarity_threshold"), "threshold")
        .when(F.col("reason").contains("baseline_rate"), "baseline")
        .when(F.col("reason").contains("promise"), F.regexp_extract("reason", "'(.*)'", 1))
        .otherwise("accepted")
        .alias("why"),
    )


GATE = """
WITH e AS (
  SELECT c_name AS cohort_id, CAST(FLOOR(c_acctbal / 100) AS BIGINT) AS overlap_count,
         CASE WHEN c_nationkey <> 3 THEN ROUND(c_nationkey / 20.0, 2) END AS threshold,
         CASE WHEN c_nationkey > 20 THEN c_acctbal / 1000 END AS lift,
         CASE WHEN c_nationkey > 22 THEN 0.5 END AS baseline, c_mktsegment AS seg
  FROM customer),
w AS (
  SELECT *, CASE WHEN overlap_count <= 0 THEN 'overlap'
                 WHEN threshold IS NULL THEN 'threshold'
                 WHEN lift IS NOT NULL AND baseline IS NULL THEN 'baseline'
                 WHEN seg = 'BUILDING' THEN 'will boost'
                 WHEN seg = 'MACHINERY' THEN 'guaranteed'
                 ELSE 'accepted' END AS why FROM e)
SELECT cohort_id, overlap_count, why, why = 'accepted' AS allowed_to_recommend,
       CASE WHEN why <> 'accepted' THEN 'none'
            WHEN overlap_count >= 50 AND threshold >= 0.7 THEN 'high'
            WHEN overlap_count >= 20 AND threshold >= 0.6 THEN 'medium'
            ELSE 'low' END AS confidence
FROM w"""

QUERIES = {
    "cross_sell_similar": (_similar(THRESHOLD), _similar_sql(THRESHOLD)),
    "cross_sell_similar_default": (_similar(0.6), _similar_sql(0.6)),
    "cross_sell_matches": (cross_sell_matches, CROSS_SELL_MATCHES),
    "cohort_stats": (cohort_stats, COHORT_STATS),
    "cohort_summary": (cohort_summary, COHORT_SUMMARY),
    "cohort_top_fragrances": (cohort_top_fragrances, COHORT_TOP),
    "cohort_channel_mix": (cohort_channel_mix, COHORT_CHANNELS),
    "cross_sell_recommendations": (cross_sell_recommendations, RECOMMENDATIONS),
    "recommendation_gate": (gate, GATE),
}
