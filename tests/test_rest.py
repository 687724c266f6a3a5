"""Dimension, catalog, certification, files, metadata, generator and templates."""

import json

import pytest
from pyspark.sql import functions as F

from purchaselens.functions.guards import InvalidInput
from purchaselens.operators import catalog, certify, dimension, meta
from purchaselens.operators.similarity import ItemIndex
from purchaselens.plans import joins
from purchaselens.plans.scratch import scratch_path
from purchaselens.plans.templates import TEMPLATES, run_template
from purchaselens.schema import PRODUCTS, TRANSACTIONS
from purchaselens.sources import files, sinks, synth
from tests.lines import frame, line, random_lines

ITEMS = [("Lavender", "Floral", "lavender fields and herbs", ["calm"]),
         ("Happy", "Fresh", "green garden in spring", []),
         ("HAPPY", "Sweet", "sugar and vanilla cream", ["loud"])]


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(ITEMS, "name string, family string, notes string, tags array<string>")


# -- dimension


@pytest.mark.parametrize("bound", [joins.BROADCAST_BYTES, 0])
def test_names(spark, items, monkeypatch, bound):
    monkeypatch.setattr(joins, "BROADCAST_BYTES", bound)
    names = ["Lavender", "lavender", " LAVENDER  Plus", "Lavender plus", "Happy", "HAPPY", "happy",
             "Fresh Linen", None]
    df = spark.createDataFrame([(n,) for n in names * 3], "fragrance string").repartition(3)
    got = {(x.fragrance, x.canonical) for x in dimension.resolve_item(df, items).collect()}
    assert got == {("Lavender", "Lavender"), ("lavender", "Lavender"),
                   (" LAVENDER  Plus", "Lavender"), ("Lavender plus", "Lavender"),
                   ("Happy", "Happy"), ("HAPPY", "HAPPY"), ("happy", "HAPPY"),
                   ("Fresh Linen", None), (None, None)}
    rows = dimension.item_attributes(df, items).collect()
    assert len(rows) == 27
    by_name = {x.fragrance: (x.notes, x.family) for x in rows}
    assert by_name["lavender"] == (ITEMS[0][2], "Floral")
    assert by_name["Fresh Linen"] == by_name[None] == (None, "Unknown")


def test_members(items):
    assert [x.name for x in dimension.family_members(items, "Fresh").collect()] == ["Happy"]
    assert dimension.item_list(items).count() == 3


# -- catalog

PRODUCT = {
    "id": 1, "title": "Bar", "product_type": " Soap ", "vendor": "V", "tags": "a, b ,,Rose Scent",
    "handle": "bar", "created_at": "c", "updated_at": "u",
    "options": [{"name": "Size", "values": ["S"]}, {"name": "SCENT", "values": ["Rose", "Lily"]}],
    "images": [{"src": "http://img/1"}, {"src": "http://img/2"}],
    "variants": [{"id": 11, "title": "Small", "sku": "s", "price": "4.50",
                  "compare_at_price": "5.00", "available": False},
                 {"id": 12, "title": "Big", "price": 7}],
}


def normalized(spark, *products, **kwargs):
    df = spark.createDataFrame([(json.dumps(p),) for p in products], "product string")
    return catalog.normalize_catalog(df, "shop.example.com", **kwargs)


def test_normalize(spark):
    out = normalized(spark, PRODUCT)
    assert [(f.name, f.dataType) for f in out.schema] == [(f.name, f.dataType) for f in PRODUCTS]
    a, b = out.orderBy("variant_id").collect()
    assert a.asDict() == {
        "store": "shop.example.com", "product_id": 1, "product_title": "Bar",
        "product_type": "Soap", "vendor": "V", "tags": ["a", "b", "Rose Scent"], "variant_id": 11,
        "variant_title": "Small", "sku": "s", "price": 4.5, "compare_at_price": 5.0,
        "available": False, "fragrance": "Rose, Lily", "created_at": "c", "updated_at": "u",
        "image_url": "http://img/1", "handle": "bar",
        "url": "https://shop.example.com/products/bar"}
    assert (b.sku, b.price, b.compare_at_price, b.available) == ("", 7.0, None, True)


@pytest.mark.parametrize("change,field,value", [
    ({"options": []}, "fragrance", "Rose Scent"),
    ({"options": [{"name": "aroma", "values": []}]}, "fragrance", "Rose Scent"),
    ({"options": [], "tags": ["x", "My FRAGRANCE"]}, "fragrance", "My FRAGRANCE"),
    ({"options": [], "tags": ""}, "fragrance", "Small"),
    ({"tags": ["p", "q"]}, "tags", ["p", "q"]),
    ({"tags": None}, "tags", []),
    ({"product_type": "  "}, "product_type", "Uncategorized"),
    ({"product_type": None}, "product_type", "Uncategorized"),
    ({"images": []}, "image_url", ""),
    ({"handle": None}, "url", "https://shop.example.com/products/"),
])
def test_normalize_variants(spark, change, field, value):
    product = {**PRODUCT, **change}
    assert normalized(spark, product).orderBy("variant_id").first()[field] == value


def test_prices(spark):
    variants = [{"id": i, "price": p, "compare_at_price": c} for i, (p, c) in enumerate(
        [(None, None), ("abc", ""), (" 3.5 ", "0.00")])]
    got = normalized(spark, {**PRODUCT, "variants": variants}).orderBy("variant_id").collect()
    assert [(x.price, x.compare_at_price) for x in got] == [(0.0, None), (None, None), (3.5, 0.0)]


def test_broken_json(spark):
    df = spark.createDataFrame([('{"id": ',), (json.dumps(PRODUCT),)], "product string")
    with pytest.raises(Exception):
        catalog.normalize_catalog(df).collect()
    assert catalog.normalize_catalog(df, mode="PERMISSIVE").count() == 2
    assert normalized(spark, {**PRODUCT, "variants": []}).count() == 0


def test_pages_and_summaries(spark):
    page = spark.createDataFrame([(json.dumps({"products": [PRODUCT, PRODUCT]}),)], "page string")
    out = catalog.normalize_catalog(catalog.products_of_pages(page))
    assert out.count() == 4
    assert catalog.catalog_categories(out).first().asDict() == {"product_type": "Soap", "cnt": 4}
    assert tuple(catalog.catalog_price_range(out).first()) == (4.5, 7.0)
    assert catalog.catalog_fragrance_count(out).first().fragrances == 1


# -- certification


def test_fingerprint(spark, items):
    one = certify.table_fingerprint(items).first().sha256
    assert len(one) == 64
    assert certify.table_fingerprint(items.repartition(3)).first().sha256 == one
    assert certify.table_fingerprint(items.select(*reversed(items.columns))).first().sha256 == one
    for other in (items.limit(2), items.union(items.limit(1)),
                  items.withColumn("notes", F.lit(None).cast("string")),
                  items.withColumn("notes", F.lit("")),
                  items.withColumnRenamed("notes", "text")):
        assert certify.table_fingerprint(other).first().sha256 != one
    assert certify.table_fingerprint(items.limit(0)).first().row_count == 0
    # The border between neighbouring values is part of the hash.
    a = spark.createDataFrame([("x;b=1:y", "z")], "a string, b string")
    b = spark.createDataFrame([("x", "y;b=1:z")], "a string, b string")
    assert certify.table_fingerprint(a).first() != certify.table_fingerprint(b).first()


def test_manifest(items):
    out = {x.component: x for x in certify.manifest({"p": items, "q": items.limit(1)}).collect()}
    assert set(out) == {"p", "q", "*"} and out["*"].row_count == 4
    changed = {x.component: x for x in certify.manifest({"p": items, "q": items.limit(2)}).collect()}
    assert changed["p"] == out["p"] and changed["*"].sha256 != out["*"].sha256


def test_stale_index(spark, items):
    path = scratch_path(spark, "index")
    certify.build_index(items, path)
    index = certify.load_index(spark, path, items)
    assert ItemIndex.of(index).rows == 3
    more = items.union(spark.createDataFrame([("New", "Fresh", "new new new new", [])], items.schema))
    with pytest.raises(certify.StaleIndex, match="rebuild"):
        certify.load_index(spark, path, more)
    assert certify.load_index(spark, path, more, strict=False).count() == 3
    assert certify.index_freshness(index.drop("fingerprint"), items).first().is_stale
    mixed = index.unionByName(index.withColumn("fingerprint", F.lit("zz")))
    assert certify.index_freshness(mixed, items).first().is_stale
    partly = index.unionByName(index.withColumn("fingerprint", F.lit(None).cast("string")))
    assert certify.index_freshness(partly, items).first().is_stale


def test_checks_and_readiness(spark, items):
    path = scratch_path(spark, "index")
    certify.build_index(items, path)
    index = spark.read.parquet(path)
    good = certify.quality_checks(items, 3, index)
    assert {x.status for x in good.collect()} == {"passed"}
    assert certify.readiness(good).first().label == "INDEX_CERTIFIED"
    skipped = certify.quality_checks(items, 3)
    assert {x.check_name: x.status for x in skipped.collect()}["index_fresh"] == "skipped"
    assert certify.readiness(skipped).first().label == "PROFILES_ACCEPTED"
    fluffy = items.union(spark.createDataFrame([("Ad", "Fresh", "viral luxury", None)], items.schema))
    checks = certify.quality_checks(fluffy, 3, index)
    status = {x.check_name: x.status for x in checks.collect()}
    assert status["no_fluff"] == status["index_fresh"] == "failed"
    assert certify.readiness(checks).first().label == "DATA_MODEL_VALIDATED"
    assert certify.readiness(certify.quality_checks(items, 8)).first().label == "BASELINE_CAPTURED"
    assert certify.readiness(good.limit(0)).first().label is None
    own = (("LOW", (), None), ("HIGH", ("absent",), None))
    assert certify.readiness(good, own).first().label == "LOW"


# -- files and metadata


def test_round_trips(spark):
    rows = [r for r in random_lines(60) if r[4] != "" and r[7] != ""]
    rows.append(line("T,1", 'G"q"', "2025-01-01", "Can\tdle", "a,b"))
    df = frame(spark, rows, 2)
    root = scratch_path(spark, "files")
    df.write.option("header", True).option("escape", '"').csv(f"{root}/x.csv")
    df.write.option("header", True).option("escape", '"').option("sep", "\t").csv(f"{root}/x.tsv")
    df.write.json(f"{root}/x.json")
    df.write.parquet(f"{root}/x.parquet")
    for suffix in ("csv", "tsv", "json", "parquet"):
        back = files.import_file(spark, f"{root}/x.{suffix}", TRANSACTIONS, root)
        assert back.schema == TRANSACTIONS
        assert back.exceptAll(df).count() == 0 and back.count() == len(rows), suffix
    free = files.import_file(spark, f"{root}/x.csv")
    assert dict(free.dtypes)["transaction_id"] == "string"
    assert dict(free.dtypes)["transaction_date"] == "date"
    assert dict(free.dtypes)["price"] == "double"


def test_json_array_and_wrong_value(spark, tmp_path):
    (tmp_path / "a.json").write_text('[\n{"a": 1},\n{"a": 2}\n]')
    assert files.import_file(spark, str(tmp_path / "a.json"), multiline=True).count() == 2
    (tmp_path / "b.csv").write_text("a,b\n1,x\n")
    schema = "a int, b int"
    from pyspark.sql.types import _parse_datatype_string

    with pytest.raises(Exception):
        files.import_csv(spark, str(tmp_path / "b.csv"), _parse_datatype_string(schema)).collect()


@pytest.mark.parametrize("path", ["/data/../etc/x.csv", "/etc/x.csv", "/data/x.sql", "/data/x",
                                  "s3://other/data/x.csv", "/database/x.csv", 5])
def test_paths_refused(path):
    with pytest.raises(InvalidInput):
        files.check_path(path, "/data")


def test_names_of_tables(spark):
    assert files.table_name_of("/in/My Sales-2024.csv") == "my_sales_2024"
    for bad in ("1x", "a;b", "", "a" * 64, "x\n", None):
        with pytest.raises(InvalidInput):
            files.check_table_name(bad)
    df = frame(spark, random_lines(20))
    for n in (20, 5):
        saved = files.save_table(df.limit(n), "t_saved", scratch_path(spark, "table"))
        assert saved.count() == n
    spark.sql("DROP TABLE t_saved")


def test_lines_by_month(spark):
    from purchaselens.operators import reports
    from purchaselens.sources import lines

    df = frame(spark, random_lines(200), 3)
    path = scratch_path(spark, "lines")
    lines.save_lines(df, path)
    back = lines.load_lines(spark, path)
    assert back.columns == df.columns
    assert back.exceptAll(df).count() == 0 and back.count() == 200
    span = ("2025-02-10", "2025-03-01")
    part = lines.load_lines(spark, path, *span)
    assert part.exceptAll(df.filter(reports.in_range(*span))).count() == 0
    assert part.count() == df.filter(reports.in_range(*span)).count()
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(transaction_month" in plan
    assert reports.channel_performance(part, *span).collect() == reports.channel_performance(
        df, *span).collect()
    assert lines.load_lines(spark, path, end="2025-01-31").count() == df.filter(
        "transaction_date <= '2025-01-31'").count()


def test_metadata(spark):
    df = frame(spark, random_lines(20))
    report = meta.import_report(df).orderBy("ordinal").collect()
    assert [x.column_name for x in report] == df.columns
    assert {(x.row_count, x.column_count) for x in report} == {(20, 9)}
    df.createOrReplaceTempView("lines_view")
    names = {x.table_name for x in meta.inspect_schema(spark).collect()}
    assert "lines_view" in names
    profile = {x.table_name: x for x in meta.table_profile(spark).collect()}
    assert profile["lines_view"].row_count == 20
    assert meta.adhoc_sql(spark, "SELECT count(*) AS n FROM lines_view WHERE guest_id = ?",
                          ["HOT' OR '1'='1"]).first().n == 0
    spark.catalog.dropTempView("lines_view")
    assert meta.table_profile(spark, {}).count() == 0


def test_segment(spark):
    guests = spark.createDataFrame([("g1",), ("g1",), ("G-2_x",)], "guest_id string")
    folder = scratch_path(spark, "segments")
    out = sinks.export_segment(guests, "VIP / Spring!", folder).first()
    assert out.exported == 3 and out.path.endswith("/VIP_Spring.csv")
    bad = guests.union(spark.createDataFrame([("x; DROP",)], "guest_id string"))
    with pytest.raises(InvalidInput):
        sinks.export_segment(bad, "bad", folder)
    with pytest.raises(Exception):
        spark.read.csv(f"{folder}/bad.csv").count()
    assert sinks.segment_slug("???") == "segment"


# -- generator and templates


def test_synthetic(spark):
    df = synth.synthetic_transactions(spark, 20_000, 500, 4, seed=3)
    assert df.dtypes == spark.createDataFrame([], TRANSACTIONS).dtypes
    assert df.repartition(3).exceptAll(synth.synthetic_transactions(spark, 20_000, 500, 4, 3)).count() == 0
    out = df.agg(
        F.countDistinct("guest_id").alias("guests"), F.countDistinct("fragrance").alias("scents"),
        F.countDistinct("product_type").alias("types"), F.countDistinct("channel").alias("channels"),
        F.countDistinct("transaction_id").alias("orders"), F.avg((F.col("discount_amount") > 0).cast("int")).alias("cut"),
        F.min("transaction_date").alias("lo"), F.max("transaction_date").alias("hi"),
        F.countDistinct(F.when(F.col("discount_code") != "", F.col("discount_code"))).alias("codes"),
    ).first()
    assert (out.guests, out.scents, out.types, out.channels, out.orders, out.codes) == (500, 16, 10, 4, 5000, 5)
    assert abs(out.cut - 0.2) < 0.02
    assert str(out.lo) >= "2022-01-01" and str(out.hi) <= "2026-05-01"
    per_order = df.groupBy("transaction_id").agg(F.countDistinct("guest_id", "transaction_date", "channel").alias("n"))
    assert per_order.filter("n > 1").count() == 0
    for kind, (low, high) in synth.PRICES.items():
        got = df.filter(F.col("product_type") == kind).agg(F.min("price"), F.max("price")).first()
        assert low <= got[0] and got[1] <= high
    # A guest's favourites make up some 70 % of the lines and more.
    top = df.groupBy("guest_id", "fragrance").count().groupBy("guest_id").agg(
        F.array_sort(F.collect_list("count")).alias("c"))
    share = top.select((F.aggregate(F.slice(F.reverse("c"), 1, 3), F.lit(0).cast("bigint"), lambda s, x: s + x)
                        / F.aggregate("c", F.lit(0).cast("bigint"), lambda s, x: s + x)).alias("s")).agg(F.avg("s")).first()[0]
    assert share > 0.7
    many = synth.synthetic_lines(spark.range(3000), 10**9).agg(F.max("guest_id")).first()[0]
    assert len(many) > len("GUEST-00000")


@pytest.mark.parametrize("name,params,word", [
    ("nope", {}, "unknown template"),
    ("repeat_buyers", {"start_date": "2025-01-01", "end_date": "2025-02-01"}, "min_purchases"),
    ("discount_impact", {"start_date": "2025-01-01", "end_date": "2025-02-01", "x": "1"}, "unexpected"),
    ("discount_impact", {"start_date": "2025-13-01", "end_date": "2025-02-01"}, "start_date"),
    ("repeat_buyers", {"start_date": "2025-01-01", "end_date": "2025-02-01", "min_purchases": "1; DROP"}, "integer"),
    ("repeat_buyers", {"start_date": "2025-01-01", "end_date": "2025-02-01", "min_purchases": "-3"}, "below"),
    ("category_affinity", {"category": "x' OR '1'='1", "start_date": "2025-01-01", "end_date": "2025-02-01"}, "category"),
])
def test_templates_refuse(name, params, word):
    with pytest.raises(InvalidInput, match=word):
        run_template(None, name, params)


def test_templates_run(spark):
    t = frame(spark, random_lines(80))
    values = {"start_date": "2025-01-01", "end_date": "2025-12-31", "cat_a": "Candle",
              "cat_b": "Body Wash", "category": "Candle", "min_purchases": "2"}
    assert len(TEMPLATES) == 8
    for name, template in TEMPLATES.items():
        out = run_template(t, name, {k: values[k] for k in template.params})
        assert out.count() > 0, name


# -- lookup joins


def test_measured_bytes(spark, items):
    assert joins.measured_bytes(items.limit(0)) == 0
    assert joins.measured_bytes(items) > sum(len(n) + len(t) for n, _, t, _ in ITEMS)
    wide = spark.createDataFrame([("a", [1.0] * 1000)], "n string, v array<double>")
    assert joins.measured_bytes(wide) > 8000
    empty = spark.createDataFrame([(None, None)], "n string, v array<double>")
    assert 0 < joins.measured_bytes(empty) < 200


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_shuffled_join_equals_broadcast(spark, how, monkeypatch):
    big = spark.range(300).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 40).alias("k"), "id")
    small = spark.range(20).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    plain = sorted(map(tuple, joins.lookup_join(big, small, ["k"], how).collect()))
    monkeypatch.setattr(joins, "BROADCAST_BYTES", 0)
    assert sorted(map(tuple, joins.lookup_join(big, small, ["k"], how).collect())) == plain
    with pytest.raises(ValueError):
        joins.lookup_join(big, small, ["k"], "full")


@pytest.mark.parametrize("bound", [joins.BROADCAST_BYTES, 0])
def test_lookup_join_takes_any_column_and_a_hot_key(spark, monkeypatch, bound):
    monkeypatch.setattr(joins, "BROADCAST_BYTES", bound)
    big = spark.range(10_000).select(F.lit("hot").alias("k"), F.create_map(F.lit("a"), F.lit(1)).alias("m"))
    small = spark.createDataFrame([("hot", 1), ("cold", 2)], "k string, v int")
    assert joins.lookup_join(big, small, ["k"]).agg(F.sum("v")).first()[0] == 10_000


@pytest.mark.parametrize("bound", [joins.BROADCAST_BYTES, 0])
def test_names_resolve_alike_on_both_paths(spark, items, monkeypatch, bound):
    from purchaselens.operators import dimension

    monkeypatch.setattr(joins, "BROADCAST_BYTES", bound)
    name = ITEMS[0][0]
    sold = spark.createDataFrame([(name,), (f" {name.upper()}\t",), (f"\u00a0{name}\n",), ("?",), (None,)], "fragrance string")
    assert [x.canonical for x in dimension.resolve_item(sold, items).collect()].count(name) == 3
    twice = dimension.item_family(sold, items.unionByName(items))
    assert twice.count() == 5


def test_scratch_needs_a_shared_folder_on_a_cluster(spark, tmp_path):
    from purchaselens.plans.scratch import scratch_path

    class Conf(dict):
        def get(self, key, default=None):
            return dict.get(self, key, default)

    class Session:
        conf = Conf({"spark.master": "spark://host:7077"})

    with pytest.raises(RuntimeError):
        scratch_path(Session, "x")
    assert scratch_path(Session, "x", str(tmp_path)).startswith(str(tmp_path))
    Session.conf["spark.checkpoint.dir"] = "hdfs://shared"
    assert scratch_path(Session, "x").startswith("hdfs://shared/x-")


def test_csv_columns_go_by_name(spark, tmp_path):
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("tx", T.StringType()), T.StructField("guest", T.StringType()),
                           T.StructField("day", T.DateType()), T.StructField("n", T.IntegerType())])
    (tmp_path / "a.csv").write_text("n,day,guest,extra,tx\n7,2025-01-02,G,x,T\n")
    got = files.import_csv(spark, str(tmp_path / "a.csv"), schema)
    assert got.schema == schema and tuple(got.first())[:2] == ("T", "G") and got.first().n == 7
    (tmp_path / "b.csv").write_text("n,day,tx\n7,2025-01-02,T\n")
    with pytest.raises(Exception, match="guest"):
        files.import_csv(spark, str(tmp_path / "b.csv"), schema).collect()
