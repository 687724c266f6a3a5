"""Round trips through files and tables, metadata and the generator.

A sink is written to the scratch folder and read back; the result is what was read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from purchaselens.operators import meta, similarity
from purchaselens.operators import reports as operators
from purchaselens.plans.scratch import scratch_path
from purchaselens.schema import TRANSACTIONS as SCHEMA
from purchaselens.functions.money import money_sum, round_to
from purchaselens.sources import files, intake, lines, sinks, synth

from . import catalog, reports
from .reports import END, RANGE, START
from .tables import INDEX, TABLES, TRANSACTIONS, index, money, read, sql, transactions
from .similarity import NEAREST


def _shown(df):
    return df.withColumn("transaction_date", F.col("transaction_date").cast("string"))


ALL = """
SELECT * REPLACE (CAST(transaction_date AS VARCHAR) AS transaction_date) FROM transactions"""


# In a delimited file an empty field is NULL.
def _code():
    return F.coalesce("discount_code", F.lit(""))


def _path(spark, label, suffix):
    return f"{scratch_path(spark, label)}{suffix}"


def import_csv(spark, sf_dir):
    path = _path(spark, "lines", ".csv")
    transactions(spark, sf_dir).write.option("header", True).csv(path)
    return _shown(files.import_file(spark, path, SCHEMA)).withColumn("discount_code", _code())


def import_csv_reordered(spark, sf_dir):
    """Columns in another order than the schema's, with one more."""
    path = _path(spark, "lines", ".csv")
    df = transactions(spark, sf_dir)
    df.select(*reversed(df.columns), F.lit(1).alias("extra")).write.option("header", True).csv(path)
    return _shown(files.import_file(spark, path, SCHEMA)).withColumn("discount_code", _code())


# Faults planted by order number: a date, a guest, a scent and a price that no rule admits.
FAULTS = {
    "transaction_date": ("01/02/1996", 7), "guest_id": ("a b", 11), "fragrance": ("x''; --", 13), "price": ("much", 17),
}


def import_validated(spark, sf_dir):
    """A delivery with planted faults: imported, judged, stored, and read back with its reasons."""
    order = F.substring("transaction_id", 4, 20).cast("bigint")
    bad = transactions(spark, sf_dir).select(*[
        F.when(order % FAULTS[c][1] == 0, FAULTS[c][0]).otherwise(F.col(c).cast("string")).alias(c)
        if c in FAULTS else F.col(c).cast("string")
        for c in SCHEMA.names
    ])
    path = _path(spark, "delivery", ".csv")
    bad.write.option("header", True).csv(path)
    report = intake.import_transactions(spark, path, scratch_path(spark, "intake")).first()
    valid = intake.valid_lines(spark, report.path).groupBy().agg(
        F.lit("").alias("reasons"), F.count("*").alias("lines"), round_to(money_sum("price"), 2).alias("revenue")
    )
    rejected = intake.rejected_lines(spark, report.path).groupBy(
        F.array_join("reasons", "|").alias("reasons")
    ).agg(F.count("*").alias("lines"), F.lit(None).cast("double").alias("revenue"))
    return valid.unionByName(rejected).withColumn("delivered", F.lit(report.row_count))


_BAD = [
    f"CASE WHEN CAST(substr(transaction_id, 4) AS BIGINT) % {n} = 0 THEN '{c}' END" for c, (_, n) in FAULTS.items()
]
IMPORT_VALIDATED = sql(TRANSACTIONS, f"""judged AS (
  SELECT *, concat_ws('|', {', '.join(_BAD)}) AS reasons FROM transactions)""", select=f"""
SELECT reasons, COUNT(*) AS lines,
       CASE WHEN reasons = '' THEN ROUND({money('price')}, 2) END AS revenue,
       (SELECT COUNT(*) FROM judged) AS delivered
FROM judged GROUP BY reasons""")


def import_bad_lines(spark, sf_dir):
    """JSON lines of which some are cut off: what can be read, and the raw text of the rest."""
    order = F.substring("transaction_id", 4, 20).cast("bigint")
    whole = F.to_json(F.struct("transaction_id", "guest_id", "product_type"))
    text = F.when(order % 19 == 0, F.substring(whole, F.lit(1), F.length(whole) - 3)).otherwise(whole)
    path = _path(spark, "lines", ".json")
    transactions(spark, sf_dir).select(text.alias("value")).write.text(path)
    read_ = files.import_file(spark, path, PARTS, corrupt="raw")
    return read_.groupBy("guest_id", F.coalesce("product_type", F.concat(F.lit("raw "), F.length("raw").cast("string")))
                         .alias("type")).agg(F.count("*").alias("lines"))


PARTS = T.StructType([T.StructField(n, T.StringType()) for n in ("transaction_id", "guest_id", "product_type")])
IMPORT_BAD_LINES = sql(TRANSACTIONS, """written AS (
  SELECT *, CAST(substr(transaction_id, 4) AS BIGINT) % 19 = 0 AS bad,
         length('{"transaction_id":"","guest_id":"","product_type":""}') + length(transaction_id) + length(guest_id)
           + length(product_type) - 3 AS n FROM transactions)""", select="""
SELECT CASE WHEN NOT bad THEN guest_id END AS guest_id,
       CASE WHEN bad THEN 'raw ' || n ELSE product_type END AS type, COUNT(*) AS lines
FROM written GROUP BY 1, 2""")


def import_counted(spark, sf_dir):
    """The report of an import, counted while it is stored."""
    table = files.import_parquet(spark, f"{sf_dir}/lineitem.parquet")
    path = scratch_path(spark, "lineitem")
    return meta.save_with_report(table, lambda df: df.write.parquet(path)).select(
        "row_count", "column_count", "ordinal", "column_name"
    )


def replace_table(spark, sf_dir):
    """A table replaced twice, the second time by a job that fails: it keeps what the first put there."""
    name, place = f"replaced_{uuid.uuid4().hex}", scratch_path(spark, "replaced")
    df = transactions(spark, sf_dir)
    files.save_table(df.limit(1), name, place)
    files.save_table(df, name, place)
    lost = F.when(F.col("price") > 0, F.raise_error(F.lit("stopped on purpose"))).otherwise("")
    try:
        files.save_table(df.withColumn("channel", lost), name, place)
    except Exception as stopped:
        if "stopped on purpose" not in str(stopped):
            raise
    return _shown(spark.table(name))


def cross_sell_stored(spark, sf_dir):
    """The exact cross-sell over lines that are stored by guest."""
    name = f"guest_lines_{uuid.uuid4().hex}"
    stored = lines.save_guest_lines(transactions(spark, sf_dir), name, scratch_path(spark, "guests"), 16)
    found = operators.cross_sell_exact(stored, reports.A, reports.B, *reports.QUARTER)
    return reports.texts(found, "first_purchase_date", "cross_sell_date")


def import_tsv(spark, sf_dir):
    """Without a schema: names and types come from the file."""
    path = _path(spark, "lines", ".tsv")
    transactions(spark, sf_dir).write.option("header", True).option("sep", "\t").csv(path)
    return _shown(files.import_file(spark, path)).withColumn("discount_code", _code())


def import_json(spark, sf_dir):
    path = _path(spark, "lines", ".json")
    # Every line repeats the names of its nine fields: packed, the file takes a fraction of the disk.
    transactions(spark, sf_dir).write.option("compression", "gzip").json(path)
    return _shown(files.import_file(spark, path, SCHEMA))


def import_parquet(spark, sf_dir):
    path = _path(spark, "lines", ".parquet")
    transactions(spark, sf_dir).write.parquet(path)
    return _shown(files.import_file(spark, path, SCHEMA))


def save_table(spark, sf_dir):
    name = files.table_name_of("/inbox/Purchase Lines-2024.csv")
    return _shown(
        files.save_table(transactions(spark, sf_dir), name, scratch_path(spark, "table"))
    )


def save_lines(spark, sf_dir):
    """Stored by month, then one range of dates read back."""
    path = scratch_path(spark, "lines-by-month")
    lines.save_lines(transactions(spark, sf_dir), path)
    return _shown(lines.load_lines(spark, path, START, END))


SAVE_LINES = sql(TRANSACTIONS, select=f"{ALL} WHERE {RANGE}")


def import_report(spark, sf_dir):
    return meta.import_report(files.import_parquet(spark, f"{sf_dir}/lineitem.parquet")).select(
        "row_count", "column_count", "ordinal", "column_name"
    )


IMPORT_REPORT = """
SELECT (SELECT COUNT(*) FROM lineitem) AS row_count, 11 AS column_count,
       CAST(ordinal_position AS INTEGER) AS ordinal, column_name
FROM information_schema.columns WHERE table_name = 'lineitem'"""


def export_segment(spark, sf_dir):
    """The guests of every large discount, duplicates included, as written to the file."""
    guests = transactions(spark, sf_dir).filter("discount_amount > 5000").select("guest_id")
    report = sinks.export_segment(guests, " VIP / spring ", scratch_path(spark, "segments"))
    path = report.first()["path"]
    return spark.read.option("header", True).csv(path)


EXPORT_SEGMENT = sql(
    TRANSACTIONS, select="SELECT guest_id FROM transactions WHERE discount_amount > 5000"
)


def load_catalog(spark, sf_dir):
    """What was stored, and the reported number of rows on each."""
    report = sinks.load_catalog(catalog.products(spark, sf_dir), scratch_path(spark, "catalog")).first()
    back = spark.read.parquet(report.path).withColumn("tags", F.array_join("tags", "|"))
    return back.withColumn("row_count", F.lit(report.row_count))


def export_catalog_json(spark, sf_dir):
    path = _path(spark, "catalog", ".json")
    sinks.export_catalog_json(catalog.products(spark, sf_dir), path)
    back = files.import_json(spark, path)
    return back.withColumn("tags", F.array_join("tags", "|"))


def export_neighbours(spark, sf_dir):
    path = _path(spark, "neighbours", ".json")
    sinks.export_neighbours(similarity.neighbour_lists(index(spark, sf_dir)), path)
    back = files.import_json(spark, path)
    return back.select(
        "name", "family",
        F.array_join(
            F.transform("neighbours", lambda e: F.concat_ws(
                ":", e["name"], e["family"], F.round(e["similarity"] * 10_000).cast("bigint").cast("string"))), "|"
        ).alias("neighbours"),
    )


EXPORT_NEIGHBOURS = sql(INDEX, NEAREST, select="""
SELECT i.name, i.family,
       string_agg(n.b || ':' || n.family || ':' || CAST(round(n.similarity * 10000) AS BIGINT), '|'
                  ORDER BY n.rank) AS neighbours
FROM idx i JOIN nearest n ON n.a = i.name GROUP BY i.name, i.family""")


def synthetic_transactions(spark, sf_dir):
    """One synthetic line per order line, among as many guests as there are customers."""
    ids = read(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id")
    )
    guests = read(spark, sf_dir, "customer").agg(F.count("*")).scalar()
    return _shown(synth.synthetic_lines(ids, guests, "id", seed=7, lines_per_order=8))


def _sql_list(values):
    return "[" + ", ".join(f"'{v}'" if isinstance(v, str) else f"CAST({v} AS DOUBLE)" for v in values) + "]"


def _n(hash_col, at):
    return f"CAST('0x' || substr({hash_col}, {1 + 15 * at}, 15) AS BIGINT)"


def _d(number, slot):
    return f"(({number} >> {40 - 20 * slot}) & 1048575)"


SYNTHETIC = sql(
    """ids AS (SELECT l_orderkey * 8 + l_linenumber AS id FROM lineitem)""",
    """hashed AS (
  SELECT id // 8 AS order_no, sha256('7|order|' || (id // 8)) AS o, sha256('7|line|' || id) AS l
  FROM ids)""",
    f"""drawn AS (
  SELECT order_no, {_n('o', 0)} AS o0, {_n('o', 1)} AS o1, {_n('l', 0)} AS l0,
         {_n('l', 1)} AS l1, {_n('l', 2)} AS l2 FROM hashed)""",
    """guests AS (
  SELECT *, (o0 >> 20) % (SELECT COUNT(*) FROM customer) + 1 AS guest_no FROM drawn)""",
    f"""habits AS (
  SELECT *, {_d('l0', 0)} % 10 AS kind,
         DATE '2022-01-01' + CAST({_d('o0', 2)} %
           (DATE '2026-05-01' - DATE '2022-01-01' + 1) AS INTEGER) AS day,
         {_n("sha256('7|guest|' || guest_no)", 0)} AS g0,
         {_n("sha256('7|guest|' || guest_no)", 1)} AS g1 FROM guests)""",
    f"""picked AS (
  SELECT *, {_d('g0', 1)} % 16 AS f1, ({_d('g0', 1)} % 16 + 1 + {_d('g0', 2)} % 7) % 16 AS f2,
         ({_d('g0', 1)} % 16 + 8 + {_d('g1', 0)} % 8) % 16 AS f3,
         {_d('l0', 2)} % ({_d('g0', 0)} % 3 + 1) AS which,
         FLOOR(({_sql_list([p[0] for p in synth.PRICES.values()])}[kind + 1]
           + {_sql_list([p[1] - p[0] for p in synth.PRICES.values()])}[kind + 1]
             * {_d('l1', 1)} / CAST(1048576 AS DOUBLE)) * 100 + 0.5) / CAST(100 AS DOUBLE) AS price,
         {_d('l1', 2)} < 209715 AS discounted FROM habits)""",
    select=f"""
SELECT 'TX-' || strftime(day, '%Y%m%d') || '-' || CASE WHEN length(CAST(order_no AS VARCHAR)) < 6
         THEN lpad(CAST(order_no AS VARCHAR), 6, '0') ELSE CAST(order_no AS VARCHAR) END
         AS transaction_id,
       'GUEST-' || CASE WHEN length(CAST(guest_no AS VARCHAR)) < 5
         THEN lpad(CAST(guest_no AS VARCHAR), 5, '0') ELSE CAST(guest_no AS VARCHAR) END
         AS guest_id,
       CAST(day AS VARCHAR) AS transaction_date,
       {_sql_list(synth.PRICES)}[kind + 1] AS product_type,
       {_sql_list(synth.FRAGRANCES)}[CASE WHEN {_d('l0', 1)} < 734003 THEN [f1, f2, f3][which + 1]
                                          ELSE {_d('l1', 0)} % 16 END + 1] AS fragrance,
       price,
       CASE WHEN discounted THEN FLOOR(price * {_sql_list(synth.DISCOUNT_RATES)}[{_d('l2', 0)} % 4 + 1]
         * 100 + 0.5) / CAST(100 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS discount_amount,
       CASE WHEN discounted THEN {_sql_list(synth.DISCOUNT_CODES)}[{_d('l2', 1)} % 5 + 1]
            ELSE '' END AS discount_code,
       {_sql_list(synth.CHANNELS)}[CASE WHEN {_d('o1', 0)} < 838860 THEN {_d('g1', 1)} % 4
                                        ELSE {_d('o1', 1)} % 4 END + 1] AS channel
FROM picked""",
)


def inspect_schema(spark, sf_dir):
    return meta.inspect_schema(spark, {t: read(spark, sf_dir, t) for t in TABLES}).select(
        "table_name", "ordinal", "column_name"
    )


NAMES = ", ".join(f"'{t}'" for t in TABLES)
INSPECT_SCHEMA = f"""
SELECT table_name, CAST(ordinal_position AS INTEGER) AS ordinal, column_name
FROM information_schema.columns WHERE table_name IN ({NAMES})"""


def table_profile(spark, sf_dir):
    return meta.table_profile(spark, {t: read(spark, sf_dir, t) for t in TABLES})


TABLE_PROFILE = "\nUNION ALL ".join(
    f"""
SELECT '{t}' AS table_name, (SELECT COUNT(*) FROM {t}) AS row_count,
       CAST(COUNT(*) AS INTEGER) AS column_count,
       string_agg(column_name, ', ' ORDER BY ordinal_position) AS columns
FROM information_schema.columns WHERE table_name = '{t}'"""
    for t in TABLES
)

QUERIES = {
    "import_csv": (import_csv, sql(TRANSACTIONS, select=ALL)),
    "import_csv_reordered": (import_csv_reordered, sql(TRANSACTIONS, select=ALL)),
    "import_validated": (import_validated, IMPORT_VALIDATED),
    "import_bad_lines": (import_bad_lines, IMPORT_BAD_LINES),
    "import_counted": (import_counted, IMPORT_REPORT),
    "replace_table": (replace_table, sql(TRANSACTIONS, select=ALL)),
    "cross_sell_stored": (cross_sell_stored, reports.CROSS_SELL_EXACT),
    "import_tsv": (import_tsv, sql(TRANSACTIONS, select=ALL)),
    "import_json": (import_json, sql(TRANSACTIONS, select=ALL)),
    "import_parquet": (import_parquet, sql(TRANSACTIONS, select=ALL)),
    "save_table": (save_table, sql(TRANSACTIONS, select=ALL)),
    "save_table_by_month": (save_lines, SAVE_LINES),
    "import_report": (import_report, IMPORT_REPORT),
    "export_segment": (export_segment, EXPORT_SEGMENT),
    "load_catalog": (load_catalog, sql(*catalog.RAW, select="SELECT *, COUNT(*) OVER () AS row_count FROM products")),
    "export_catalog_json": (export_catalog_json, sql(*catalog.RAW, select="SELECT * FROM products")),
    "export_neighbours": (export_neighbours, EXPORT_NEIGHBOURS),
    "synthetic_transactions": (synthetic_transactions, SYNTHETIC),
    "inspect_schema": (inspect_schema, INSPECT_SCHEMA),
    "table_profile": (table_profile, TABLE_PROFILE),
}
