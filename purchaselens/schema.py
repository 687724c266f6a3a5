"""The core table and how foreign inputs are brought into its shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TRANSACTIONS = T.StructType(
    [
        T.StructField("transaction_id", T.StringType()),
        T.StructField("guest_id", T.StringType()),
        T.StructField("transaction_date", T.DateType()),
        T.StructField("product_type", T.StringType()),
        T.StructField("fragrance", T.StringType()),
        T.StructField("price", T.DoubleType()),
        T.StructField("discount_amount", T.DoubleType()),
        T.StructField("discount_code", T.StringType()),
        T.StructField("channel", T.StringType()),
    ]
)

PRODUCTS = T.StructType(
    [
        T.StructField("store", T.StringType()),
        T.StructField("product_id", T.LongType()),
        T.StructField("product_title", T.StringType()),
        T.StructField("product_type", T.StringType()),
        T.StructField("vendor", T.StringType()),
        T.StructField("tags", T.ArrayType(T.StringType())),
        T.StructField("variant_id", T.LongType()),
        T.StructField("variant_title", T.StringType()),
        T.StructField("sku", T.StringType()),
        T.StructField("price", T.DoubleType()),
        T.StructField("compare_at_price", T.DoubleType()),
        T.StructField("available", T.BooleanType()),
        T.StructField("fragrance", T.StringType()),
        T.StructField("created_at", T.StringType()),
        T.StructField("updated_at", T.StringType()),
        T.StructField("image_url", T.StringType()),
        T.StructField("handle", T.StringType()),
        T.StructField("url", T.StringType()),
    ]
)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Select and cast the columns of ``schema``; text dates become dates here, once."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])


def as_transactions(df: DataFrame) -> DataFrame:
    return conform(df, TRANSACTIONS)


def named(fragrance: Column | str = "fragrance") -> Column:
    """True where a line carries a usable fragrance (neither NULL nor empty)."""
    col = F.col(fragrance) if isinstance(fragrance, str) else fragrance
    return col.isNotNull() & (col != "")
