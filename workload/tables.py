"""How the supplied tables stand in for purchase lines, items and vectors.

Each mapping exists twice, as a DataFrame and as the SQL the checks run; see FIXTURES.md.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from purchaselens.functions.money import round_to
from purchaselens.operators.similarity import ItemIndex, similarity_pairs
from purchaselens.plans.scratch import scratch_path

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as purchase lines of the core schema."""
    lines = read(spark, sf_dir, "lineitem")
    orders = read(spark, sf_dir, "orders")
    part = read(spark, sf_dir, "part")
    percent = F.round(F.col("l_discount") * 100).cast("int").cast("string")
    return (
        lines.join(orders, lines.l_orderkey == orders.o_orderkey)
        .join(part, lines.l_partkey == part.p_partkey)
        .select(
            F.concat(F.lit("TX-"), F.col("l_orderkey").cast("string")).alias("transaction_id"),
            F.concat(F.lit("GUEST-"), F.col("o_custkey").cast("string")).alias("guest_id"),
            F.col("o_orderdate").cast("date").alias("transaction_date"),
            F.col("p_type").alias("product_type"),
            F.col("p_brand").alias("fragrance"),
            F.col("l_extendedprice").alias("price"),
            round_to(F.col("l_extendedprice") * F.col("l_discount"), 2).alias("discount_amount"),
            F.when(F.col("l_discount") == 0, "")
            .otherwise(F.concat(F.lit("D"), percent))
            .alias("discount_code"),
            F.col("o_orderpriority").alias("channel"),
        )
    )


TRANSACTIONS = """transactions AS (
  SELECT 'TX-' || l_orderkey AS transaction_id, 'GUEST-' || o_custkey AS guest_id,
         CAST(o_orderdate AS DATE) AS transaction_date, p_type AS product_type,
         p_brand AS fragrance, l_extendedprice AS price,
         round(l_extendedprice * l_discount, 2) AS discount_amount,
         CASE WHEN l_discount = 0 THEN ''
              ELSE 'D' || CAST(round(l_discount * 100) AS INTEGER) END AS discount_code,
         o_orderpriority AS channel
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"""


def money(expr: str) -> str:
    """The order-free total of an amount, in SQL."""
    return f"CAST(SUM(CAST({expr} AS DECIMAL(18,4))) AS DOUBLE)"


def average(expr: str) -> str:
    return f"{money(expr)} / COUNT({expr})"


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("Brand#"), F.col("vec_id").cast("string")).alias("name"),
        F.col("label").cast("string").alias("family"),
        F.col("embedding").alias("vector"),
    )


def index(spark: SparkSession, sf_dir: str) -> ItemIndex:
    return ItemIndex.of(vectors(spark, sf_dir))


INDEX = """idx AS (
  SELECT 'Brand#' || vec_id AS name, CAST(label AS VARCHAR) AS family,
         CAST(embedding AS DOUBLE[]) AS vector FROM embeddings)"""


def pairs_sql(threshold: float) -> str:
    return f"""pairs AS (
  SELECT a, b, similarity FROM (
    SELECT x.name AS a, y.name AS b, list_cosine_similarity(x.vector, y.vector) AS similarity
    FROM idx x JOIN idx y ON x.name <> y.name) WHERE similarity >= {threshold})"""


def offered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items that lines can hold: every ``fragrance`` of :func:`transactions` is one of them."""
    return read(spark, sf_dir, "part").select("p_brand")


def stored_pairs(spark: SparkSession, sf_dir: str, threshold: float, among: DataFrame | None = None) -> DataFrame:
    """The similarity table of the index, computed once and kept as a table, as a deployment would; with
    ``among`` that of the items it names."""
    path = scratch_path(spark, "pairs")
    similarity_pairs(index(spark, sf_dir), threshold, among).write.parquet(path)
    return spark.read.parquet(path)


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as the item dimension: their text is the profile, their language the family."""
    return read(spark, sf_dir, "documents").select(
        F.concat(F.lit("Brand#"), F.col("doc_id").cast("string")).alias("name"),
        F.col("lang").alias("family"),
        F.col("text").alias("notes"),
        F.array("source").alias("tags"),
    )


ITEMS = """items AS (
  SELECT 'Brand#' || doc_id AS name, lang AS family, text AS notes, [source] AS tags
  FROM documents)"""


def sql(*ctes: str, select: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + select
