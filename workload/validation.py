"""Row validation on values that the supplied tables make partly invalid."""

from __future__ import annotations

from pyspark.sql import functions as F

from purchaselens.functions import guards as g
from purchaselens.operators import validate as v

from .tables import TRANSACTIONS, read, sql, transactions


def _orders(spark, sf_dir):
    """Every order with text fields, the damage depending on its status and priority."""
    day = F.col("o_orderdate").cast("date").cast("string")
    low = F.col("o_orderpriority")
    return read(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.when(low.startswith("1"), F.replace(day, F.lit("-"), F.lit("/")))
        .when(low.startswith("2"), F.concat(F.substring(day, 1, 5), F.lit("13-01")))
        .when(low.startswith("3"), F.concat(F.substring(day, 1, 8), F.lit("31")))
        .when(low.startswith("4"), F.concat(day, F.lit("' OR '1'='1")))
        .otherwise(day)
        .alias("day"),
        F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("g"), F.col("o_custkey").cast("string"), F.lit("; --")))
        .when(F.col("o_orderstatus") == "O", F.concat(F.lit("G-"), F.col("o_custkey").cast("string")))
        .otherwise(F.concat(F.lit("guest_"), F.repeat(F.lit("x"), 61), F.col("o_custkey").cast("string")))
        .alias("guest"),
        F.when(low.startswith("1"), F.concat(F.lit(" "), F.col("o_custkey").cast("string")))
        .when(low.startswith("2"), F.concat(F.lit("-"), F.col("o_custkey").cast("string")))
        .when(low.startswith("3"), F.concat(F.col("o_custkey").cast("string"), F.lit(".5")))
        .otherwise(F.col("o_custkey").cast("string"))
        .alias("number"),
    )


ORDERS = """damaged AS (
  SELECT o_orderkey,
    CASE o_orderpriority[1] WHEN '1' THEN strftime(o_orderdate, '%Y/%m/%d')
         WHEN '2' THEN strftime(o_orderdate, '%Y-') || '13-01'
         WHEN '3' THEN strftime(o_orderdate, '%Y-%m-') || '31'
         WHEN '4' THEN strftime(o_orderdate, '%Y-%m-%d') || ''' OR ''1''=''1'
         ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day,
    CASE o_orderstatus WHEN 'F' THEN 'g' || o_custkey || '; --'
         WHEN 'O' THEN 'G-' || o_custkey
         ELSE 'guest_' || repeat('x', 61) || o_custkey END AS guest,
    CASE o_orderpriority[1] WHEN '1' THEN ' ' || o_custkey WHEN '2' THEN '-' || o_custkey
         WHEN '3' THEN o_custkey || '.5' ELSE CAST(o_custkey AS VARCHAR) END AS number
  FROM orders)"""
DATE_OK = "regexp_full_match(day, '[0-9]{4}-[0-9]{2}-[0-9]{2}') AND TRY_CAST(day AS DATE) IS NOT NULL"
GUEST_OK = "regexp_full_match(guest, '[A-Za-z0-9_-]{1,64}')"
INT_OK = """regexp_full_match(trim(number), '-?[0-9]+')
  AND COALESCE(TRY_CAST(trim(number) AS BIGINT) BETWEEN 1 AND 1000, FALSE)"""


def _flag(column, rule):
    def run(spark, sf_dir):
        return _orders(spark, sf_dir).select("o_orderkey", rule(F.col(column)).alias("ok"))

    return run


def _flag_sql(condition):
    return sql(ORDERS, select=f"SELECT o_orderkey, {condition} AS ok FROM damaged")


def valid_item_name(spark, sf_dir):
    turns = read(spark, sf_dir, "conversations")
    return turns.select("conv_id", "turn", g.valid_item_name(F.col("text")).alias("ok"))


VALID_ITEM_NAME = r"""
SELECT conv_id, turn, COALESCE(length(text) <= 100 AND NOT (contains(text, '''')
  OR contains(text, '"') OR contains(text, ';') OR contains(text, '--')
  OR contains(text, '/*') OR contains(text, '*/') OR contains(text, '\')), FALSE) AS ok
FROM conversations"""


def valid_category(spark, sf_dir):
    """The allow-list is a table: the types of the cheapest parts."""
    allowed = (
        read(spark, sf_dir, "part").filter(F.col("p_retailprice") < 901).select("p_type").distinct()
    )
    lines = v.mark_known(transactions(spark, sf_dir), allowed)
    return lines.groupBy("product_type", "known").agg(F.count("*").alias("lines"))


VALID_CATEGORY = sql(TRANSACTIONS, select="""
SELECT product_type, COUNT(*) AS lines,
       product_type IN (SELECT p_type FROM part WHERE p_retailprice < 901) AS known
FROM transactions GROUP BY product_type""")


def split_valid(spark, sf_dir):
    rules = {
        "day": g.valid_date(F.col("day")),
        "guest": g.valid_guest_id(F.col("guest")),
        "number": g.valid_int(F.col("number"), 1, 1000),
    }
    return v.judge(_orders(spark, sf_dir), rules).select(
        "o_orderkey", F.array_join("reasons", "|").alias("reasons")
    )


SPLIT_VALID = sql(ORDERS, select=f"""
SELECT o_orderkey, concat_ws('|', CASE WHEN NOT ({DATE_OK}) THEN 'day' END,
  CASE WHEN NOT {GUEST_OK} THEN 'guest' END, CASE WHEN NOT ({INT_OK}) THEN 'number' END)
  AS reasons FROM damaged""")

QUERIES = {
    "valid_date": (_flag("day", g.valid_date), _flag_sql(DATE_OK)),
    "valid_category": (valid_category, VALID_CATEGORY),
    "valid_item_name": (valid_item_name, VALID_ITEM_NAME),
    "valid_guest_id": (_flag("guest", g.valid_guest_id), _flag_sql(GUEST_OK)),
    "valid_int": (_flag("number", lambda c: g.valid_int(c, 1, 1000)), _flag_sql(INT_OK)),
    "split_valid": (split_valid, SPLIT_VALID),
}
