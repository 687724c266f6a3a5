"""A store catalog derived from the parts, normalised and summarised."""

from __future__ import annotations

from pyspark.sql import functions as F

from purchaselens.operators import catalog as c

from .tables import read, sql

STORE = "shop.example.com"


def raw_products(spark, sf_dir):
    """One JSON product per part. Tags are text for one half of the brands and an array for
    the other; some parts have a scent option, some a scent tag, some neither; fields are
    missing, empty or NULL here and there."""
    part = read(spark, sf_dir, "part")
    size, brand = F.col("p_size"), F.col("p_brand")
    number = F.substring(brand, 7, 4).cast("int")
    text = lambda c_: c_.cast("string")
    options = F.array(
        F.struct(F.lit("Size").alias("name"), F.array(text(size)).alias("values")),
        F.struct(
            F.when(size > 30, "Aroma").when(size > 20, "SCENT").otherwise("Colour").alias("name"),
            F.when(size > 40, F.array(brand, F.col("p_name")))
            .when(size > 35, F.array().cast("array<string>"))
            .otherwise(F.array(brand))
            .alias("values"),
        ),
    )
    price = F.col("p_retailprice")
    variants = F.array(
        F.struct(
            (F.col("p_partkey") * 10).alias("id"), F.lit("Small").alias("title"),
            F.concat(F.lit("S-"), text(F.col("p_partkey"))).alias("sku"), text(price).alias("price"),
            F.when(size % 3 == 0, text(price + 10)).when(size % 3 == 1, "").alias("compare_at_price"),
            F.when(size % 2 == 0, F.lit(False)).alias("available"),
        ),
        F.struct(
            (F.col("p_partkey") * 10 + 1).alias("id"), F.concat(F.lit("Large "), brand).alias("title"),
            F.lit(None).cast("string").alias("sku"), F.when(size != 7, text(price * 2)).alias("price"),
            F.lit(None).cast("string").alias("compare_at_price"), F.lit(True).alias("available"),
        ),
    )
    tag = F.concat(F.lit("Fragrance "), brand)
    common = [
        F.col("p_partkey").alias("id"), F.col("p_name").alias("title"),
        F.when(size == 1, "  ").when(size != 2, F.concat(F.lit(" "), F.col("p_type"))).alias("product_type"),
        brand.alias("vendor"), F.concat(F.lit("part-"), text(F.col("p_partkey"))).alias("handle"),
        F.lit("2024-01-02T03:04:05Z").alias("created_at"), options.alias("options"),
        F.when(size > 10, F.array(F.struct(F.concat(F.lit("https://img/"), text(F.col("p_partkey"))).alias("src"))))
        .alias("images"),
        variants.alias("variants"),
    ]
    as_text = F.to_json(
        F.struct(*common, F.concat(F.lit(" new, ,"), F.when(size > 5, tag).otherwise("plain"), F.lit(" ,x")).alias("tags"))
    )
    as_array = F.to_json(
        F.struct(*common, F.array(F.lit("old"), F.when(size > 15, tag).otherwise("plain")).alias("tags"))
    )
    return part.select(F.when(number % 2 == 0, as_text).otherwise(as_array).alias("product"))


RAW = f"""part2 AS (
  SELECT *, CAST(substr(p_brand, 7) AS INTEGER) % 2 = 0 AS even FROM part)""", """tagged AS (
  SELECT *, CASE WHEN even THEN ['new', CASE WHEN p_size > 5 THEN 'Fragrance ' || p_brand
                                             ELSE 'plain' END, 'x']
                 ELSE ['old', CASE WHEN p_size > 15 THEN 'Fragrance ' || p_brand
                                   ELSE 'plain' END] END AS tags,
         CASE WHEN even THEN p_size > 5 ELSE p_size > 15 END AS has_tag
  FROM part2)""", f"""products AS (
  SELECT '{STORE}' AS store, p_partkey AS product_id, p_name AS product_title,
         CASE WHEN p_size IN (1, 2) THEN 'Uncategorized' ELSE p_type END AS product_type,
         p_brand AS vendor, array_to_string(tags, '|') AS tags,
         p_partkey * 10 + k AS variant_id,
         CASE k WHEN 0 THEN 'Small' ELSE 'Large ' || p_brand END AS variant_title,
         CASE k WHEN 0 THEN 'S-' || p_partkey ELSE '' END AS sku,
         CASE WHEN k = 0 THEN p_retailprice WHEN p_size = 7 THEN 0 ELSE p_retailprice * 2 END
           AS price,
         CASE WHEN k = 0 AND p_size % 3 = 0 THEN p_retailprice + 10 END AS compare_at_price,
         NOT (k = 0 AND p_size % 2 = 0) AS available,
         CASE WHEN p_size > 40 THEN p_brand || ', ' || p_name
              WHEN p_size > 20 AND p_size <= 35 THEN p_brand
              WHEN has_tag THEN 'Fragrance ' || p_brand
              WHEN k = 0 THEN 'Small' ELSE 'Large ' || p_brand END AS fragrance,
         '2024-01-02T03:04:05Z' AS created_at, '' AS updated_at,
         CASE WHEN p_size > 10 THEN 'https://img/' || p_partkey ELSE '' END AS image_url,
         'part-' || p_partkey AS handle,
         'https://{STORE}/products/part-' || p_partkey AS url
  FROM tagged, (VALUES (0), (1)) v(k))"""


def products(spark, sf_dir):
    return c.normalize_catalog(raw_products(spark, sf_dir), STORE)


def normalize_catalog(spark, sf_dir):
    return products(spark, sf_dir).withColumn("tags", F.array_join("tags", "|"))


def normalize_pages(spark, sf_dir):
    """The same through store pages of 250 product numbers each."""
    page = F.concat(
        F.lit('{"products": ['), F.array_join(F.collect_list("product"), ","), F.lit("]}")
    )
    key = F.get_json_object("product", "$.id").cast("bigint")
    pages = (
        raw_products(spark, sf_dir)
        .groupBy(F.floor(key / 250).alias("page_no"))
        .agg(page.alias("page"))
    )
    return c.normalize_catalog(c.products_of_pages(pages), STORE).withColumn(
        "tags", F.array_join("tags", "|")
    )


def split_tags(spark, sf_dir):
    """Part name, brand and type as untidy comma text, one row per tag."""
    tags = F.concat(F.lit(" , "), "p_name", F.lit(" ,,"), "p_brand", F.lit(", "), "p_type")
    return read(spark, sf_dir, "part").select(
        "p_partkey", F.posexplode(c.split_tags(tags)).alias("pos", "tag")
    )


def extract_fragrance(spark, sf_dir):
    return (
        products(spark, sf_dir)
        .groupBy("fragrance")
        .agg(F.count("*").alias("variants"))
    )


def catalog_categories(spark, sf_dir):
    return c.catalog_categories(products(spark, sf_dir))


def catalog_price_range(spark, sf_dir):
    return c.catalog_price_range(products(spark, sf_dir))


def catalog_fragrance_count(spark, sf_dir):
    return c.catalog_fragrance_count(products(spark, sf_dir))


QUERIES = {
    "normalize_catalog": (normalize_catalog, sql(*RAW, select="SELECT * FROM products")),
    "normalize_catalog_pages": (normalize_pages, sql(*RAW, select="SELECT * FROM products")),
    "split_tags": (split_tags, """
SELECT p_partkey, pos, CASE pos WHEN 0 THEN p_name WHEN 1 THEN p_brand ELSE p_type END AS tag
FROM part, (VALUES (0), (1), (2)) v(pos)"""),
    "extract_fragrance": (extract_fragrance, sql(*RAW, select="""
SELECT fragrance, COUNT(*) AS variants FROM products GROUP BY fragrance""")),
    "catalog_categories": (catalog_categories, sql(*RAW, select="""
SELECT product_type, COUNT(*) AS cnt FROM products GROUP BY product_type
ORDER BY cnt DESC, product_type LIMIT 15""")),
    "catalog_price_range": (catalog_price_range, sql(*RAW, select="""
SELECT MIN(price) AS min_price, MAX(price) AS max_price FROM products""")),
    "catalog_fragrance_count": (catalog_fragrance_count, sql(*RAW, select="""
SELECT COUNT(DISTINCT fragrance) AS fragrances FROM products""")),
}
