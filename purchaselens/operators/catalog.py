"""Product catalog: nested store JSON to one typed row per variant, and its summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import PRODUCTS, conform

# Option names that carry the fragrance, and tag parts that hint at one.
FRAGRANCE_OPTIONS = ("scent", "fragrance", "smell", "aroma")
FRAGRANCE_TAGS = ("scent", "fragrance")

# ``tags`` is text or an array in the source; read as text, an array arrives as its JSON.
PRODUCT_JSON = """
    id bigint, title string, product_type string, vendor string, tags string, handle string,
    created_at string, updated_at string,
    options array<struct<name: string, values: array<string>>>,
    images array<struct<src: string>>,
    variants array<struct<id: bigint, title: string, sku: string, price: string,
                          compare_at_price: string, available: boolean>>
"""


def _text(col: str) -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def split_tags(tags: Column) -> Column:
    """Comma text to trimmed non-empty tags; a JSON array is taken as it is."""
    listed = F.when(tags.startswith("["), F.from_json(tags, "array<string>"))
    parts = F.transform(F.split(F.coalesce(tags, F.lit("")), ","), lambda t: F.trim(t))
    return F.coalesce(listed, F.filter(parts, lambda t: t != ""))


def extract_fragrance(options: Column, tags: Column, title: Column) -> Column:
    """First fragrance option, else first fragrance tag, else the variant title."""
    option = F.get(F.filter(options, lambda o: F.lower(o["name"]).isin(*FRAGRANCE_OPTIONS)), 0)

    def hints(tag: Column) -> Column:
        lower = F.lower(tag)
        found = F.contains(lower, F.lit(FRAGRANCE_TAGS[0]))
        for part in FRAGRANCE_TAGS[1:]:
            found = found | F.contains(lower, F.lit(part))
        return found

    return F.coalesce(
        F.nullif(F.array_join(option["values"], ", "), F.lit("")),
        F.get(F.filter(tags, hints), 0),
        title,
    )


def products_of_pages(pages: DataFrame, json_col: str = "page") -> DataFrame:
    """One row ``product`` (JSON text) per product of ``{"products": [...]}`` pages."""
    page = F.from_json(F.col(json_col), "products array<string>", {"mode": "FAILFAST"})
    return pages.select(F.explode(page["products"]).alias("product"))


def normalize_catalog(
    products: DataFrame, store: str = "", json_col: str = "product", mode: str = "FAILFAST"
) -> DataFrame:
    """One row of 18 columns per variant.

    Broken JSON stops the job; ``mode="PERMISSIVE"`` skips it instead. A missing price is
    0, an unreadable one NULL.
    """
    parsed = products.select(
        F.from_json(F.col(json_col), PRODUCT_JSON, {"mode": mode}).alias("p")
    ).select("p.*")
    # An inner explode would make the optimizer test the array before it is exploded, that is
    # parse the JSON once more; the outer one with a filter behind it parses once.
    rows = (
        parsed.withColumn("tags", split_tags(F.col("tags")))
        .withColumn("v", F.explode_outer("variants"))
        .filter(F.col("v").isNotNull())
    )
    price = F.trim(F.col("v.price"))
    before = F.trim(F.col("v.compare_at_price"))
    kind = F.trim(_text("product_type"))
    variant_title = _text("v.title")
    return conform(
        rows.select(
            F.lit(store).alias("store"),
            F.col("id").alias("product_id"),
            _text("title").alias("product_title"),
            F.when(kind == "", "Uncategorized").otherwise(kind).alias("product_type"),
            _text("vendor").alias("vendor"),
            "tags",
            F.col("v.id").alias("variant_id"),
            variant_title.alias("variant_title"),
            _text("v.sku").alias("sku"),
            F.when(price.isNull(), F.lit(0.0)).otherwise(price.try_cast("double")).alias("price"),
            F.nullif(before, F.lit("")).try_cast("double").alias("compare_at_price"),
            F.coalesce("v.available", F.lit(True)).alias("available"),
            extract_fragrance(F.col("options"), F.col("tags"), variant_title).alias("fragrance"),
            _text("created_at").alias("created_at"),
            _text("updated_at").alias("updated_at"),
            F.coalesce(F.get("images", 0)["src"], F.lit("")).alias("image_url"),
            _text("handle").alias("handle"),
            F.concat(F.lit(f"https://{store}/products/"), _text("handle")).alias("url"),
        ),
        PRODUCTS,
    )


def catalog_categories(products: DataFrame, n: int = 15) -> DataFrame:
    return (
        products.groupBy("product_type")
        .agg(F.count("*").alias("cnt"))
        .orderBy(F.desc("cnt"), F.asc_nulls_last("product_type"))
        .limit(n)
    )


def catalog_price_range(products: DataFrame) -> DataFrame:
    return products.agg(F.min("price").alias("min_price"), F.max("price").alias("max_price"))


def catalog_fragrance_count(products: DataFrame) -> DataFrame:
    return products.agg(F.countDistinct("fragrance").alias("fragrances"))
