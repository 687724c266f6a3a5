"""Deliveries with lines that cannot be read, tables replaced in one step, joins on hot keys."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from purchaselens.functions.guards import InvalidInput
from purchaselens.operators import dimension, meta, validate
from purchaselens.plans import joins
from purchaselens.schema import TRANSACTIONS
from purchaselens.sources import files, intake
from tests.lines import frame, random_lines

TEXTS = T.StructType([T.StructField(n, T.StringType()) for n in ("b", "a")])


@pytest.mark.parametrize("suffix,sep", [(".csv", ","), (".tsv", "\t")])
def test_bad_lines_are_kept_as_text(spark, tmp_path, suffix, sep):
    lines = ["a,b,c", "1,2,3", "1,2", "1,2,3,4", '"x,y",2,', ",,"]
    path = tmp_path / f"x{suffix}"
    path.write_text("\n".join(x.replace(",", sep) for x in lines) + "\n")
    got = files.import_file(spark, str(path), TEXTS, corrupt="raw")
    rows = {(r.a, r.b, r.raw) for r in got.collect()}
    few, many = (x.replace(",", sep) for x in ("1,2", "1,2,3,4"))
    blank = {(None, None, None)} if sep == "," else set()  # a line of tabs alone is a blank line
    assert rows == {("1", "2", None), ("1", "2", few), ("1", "2", many), (f"x{sep}y", "2", None)} | blank
    # The same lines are corrupt whatever columns are asked for.
    assert len(got.where("raw IS NOT NULL").select("a", "raw").collect()) == 2
    untyped = files.import_file(spark, str(path), corrupt="raw")
    assert untyped.columns == ["a", "b", "c", "raw"] and sum(r.raw is None for r in untyped.collect()) == 2 + len(blank)
    with pytest.raises(Exception):  # noqa: B017
        files.import_file(spark, str(path)).collect()
    with pytest.raises(InvalidInput):
        files.import_file(spark, str(path), corrupt="a")


def test_bad_json_is_kept_as_text(spark, tmp_path):
    path = tmp_path / "x.json"
    path.write_text('{"a": "1", "b": "2"}\n{"a": "1", \nno json\n{"b": "3"}\n')
    got = {(r.a, r.b, r.raw) for r in files.import_file(spark, str(path), TEXTS, corrupt="raw").collect()}
    assert got == {("1", "2", None), (None, None, '{"a": "1", '), (None, None, "no json"), (None, "3", None)}
    loose = files.import_file(spark, str(path), corrupt="raw")
    assert sum(r.raw is not None for r in loose.collect()) == 2
    path.write_text('{"a": "1"}\n')
    assert files.import_file(spark, str(path), corrupt="raw").first().raw is None
    with pytest.raises(Exception):  # noqa: B017
        path.write_text("no json\n")
        files.import_file(spark, str(path), TEXTS).collect()


def test_parquet_has_no_bad_lines(spark, tmp_path):
    path = str(tmp_path / "x.parquet")
    spark.createDataFrame([("1", "2")], "a string, b string").write.parquet(path)
    assert tuple(files.import_file(spark, path, TEXTS, corrupt="raw").first()) == ("2", "1", None)


def test_a_delivery_survives_bad_lines(spark, tmp_path):
    header = ",".join(TRANSACTIONS.names)
    (tmp_path / "in.csv").write_text(
        f"{header}\nT1,G1,2025-01-02,Candle,Beach,5.0,0,,Online\nT2,G2\nT3,G3,2025-01-02,Candle,Beach,1,0,,Store,more\n"
    )
    ask = lambda: intake.import_transactions(spark, str(tmp_path / "in.csv"), str(tmp_path / "out")).first()
    report = ask()
    assert (report.row_count, report.valid, report.rejected) == (3, 1, 2)
    bad = {r.raw_line: r.reasons for r in intake.rejected_lines(spark, report.path).collect()}
    assert bad["T2,G2"][0] == "line" and bad["T3,G3,2025-01-02,Candle,Beach,1,0,,Store,more"] == ["line"]
    assert intake.valid_lines(spark, report.path).first().transaction_id == "T1"
    again = ask()
    assert again.path != report.path and intake.valid_lines(spark, report.path).count() == 1
    (tmp_path / "in.csv").write_text(header + "\n")
    assert tuple(ask())[2:] == (0, 0, 0)


def test_a_failing_write_leaves_the_old_rows(spark, tmp_path):
    place = str(tmp_path / "t")
    df = frame(spark, random_lines(30))
    assert files.save_table(df, "t_replaced", place).count() == 30
    broken = df.withColumn("channel", F.when(F.col("price") >= 0, F.raise_error(F.lit("lost"))).otherwise("x"))
    with pytest.raises(Exception, match="lost"):
        files.save_table(broken, "t_replaced", place)
    assert spark.table("t_replaced").count() == 30
    # Replacing a table by what was read from it.
    assert files.save_table(spark.table("t_replaced").limit(7), "t_replaced", place).count() == 7
    assert spark.table("t_replaced").count() == 7
    assert len(files.drop_old_rows(spark, "t_replaced")) >= 2 and spark.table("t_replaced").count() == 7
    assert files.drop_old_rows(spark, "t_replaced") == []
    other = files.save_table(df.select("price"), "t_replaced", place)
    assert other.columns == ["price"] and other.count() == 30
    spark.sql("DROP TABLE t_replaced")


def test_rows_are_counted_while_they_are_written(spark, tmp_path):
    df = frame(spark, random_lines(40))
    read = spark.sparkContext.accumulator(0)
    counted = df.mapInArrow(lambda batches: ((read.add(b.num_rows), b)[1] for b in batches), df.schema)
    got = meta.save_with_report(counted, lambda x: x.write.parquet(str(tmp_path / "x"))).orderBy("ordinal").collect()
    assert got == meta.import_report(df).orderBy("ordinal").collect() and read.value == 40
    empty = meta.save_with_report(df.limit(0), lambda x: x.write.parquet(str(tmp_path / "y"))).first()
    assert (empty.row_count, empty.column_count) == (0, 9)


# -- hot keys


def _plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("hot", ["k3", None, "unknown"])
def test_rows_of_a_hot_key_are_not_shuffled(spark, monkeypatch, how, hot):
    rows = [(f"k{i % 200}" if i % 2 else hot, i) for i in range(4000)]
    big = spark.createDataFrame(rows, "k string, i int")
    small = spark.createDataFrame([(f"k{i}", i * 10) for i in range(300)], "k string, v int")
    want = sorted(map(str, joins.lookup_join(big, small, ["k"], how).collect()))
    monkeypatch.setattr(joins, "BROADCAST_BYTES", 0)
    keys = joins.hot_keys(big, ["k"]).collect()
    assert [r.k for r in keys] == [hot] and joins.hot_keys(small, ["k"]) is None
    joined = joins.lookup_join(big, small, ["k"], how)
    assert sorted(map(str, joined.collect())) == want
    plan = _plan(joined)
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" in plan
    # What reaches the shuffled join of the big side is without the hot rows.
    found = joins.hot_keys(big, ["k"])
    rest = big.join(found, joins._same_key(big, found, ["k"]), "left_anti")
    assert rest.count() == 2000 - (20 if hot == "k3" else 0)


@pytest.mark.parametrize("ask", ["canonical", "notes", "family"])
def test_a_name_that_half_of_the_rows_have(spark, monkeypatch, ask):
    run = {"canonical": dimension.resolve_item, "notes": dimension.item_notes, "family": dimension.item_family}[ask]
    items = spark.createDataFrame(
        [(f"Scent {i}", f"notes {i}", f"f{i % 3}", ["t"]) for i in range(100)] * 2,
        "name string, notes string, family string, tags array<string>")
    sold = [(" scent 7 PLUS" if i % 2 else f"Scent {i % 150}", i) for i in range(3000)] + [(None, -1)] * 900
    df = spark.createDataFrame(sold, "fragrance string, i int")
    want = sorted(map(str, run(df, items).collect()))
    monkeypatch.setattr(joins, "BROADCAST_BYTES", 0)
    got = run(df, items)
    assert sorted(map(str, got.collect())) == want and len(want) == 3900
    assert "BroadcastHashJoin" in _plan(got)


def test_a_category_that_half_of_the_rows_have(spark, monkeypatch):
    df = spark.createDataFrame([("hot" if i % 2 else f"c{i % 90}", i) for i in range(2000)], "product_type string, i int")
    allowed = spark.createDataFrame([("hot",), ("c2",), ("c2",), (None,)], "p string")
    want = sorted(map(str, validate.mark_known(df, allowed).collect()))
    monkeypatch.setattr(joins, "BROADCAST_BYTES", 0)
    got = validate.mark_known(df, allowed)
    assert sorted(map(str, got.collect())) == want and "BroadcastHashJoin" in _plan(got)


@pytest.mark.parametrize("ask", ["resolve_item", "item_notes", "item_family"])
def test_lines_are_read_twice_where_items_are_many(spark, monkeypatch, ask):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    items = spark.createDataFrame(
        [(f"Scent {i}", f"notes {i}", f"f{i % 3}", ["t"]) for i in range(100)],
        "name string, notes string, family string, tags array<string>")
    df = spark.createDataFrame([(f"scent {i % 100} Plus", i) for i in range(3000)], "fragrance string, i int")
    monkeypatch.setattr(joins, "BROADCAST_BYTES", 0)
    got = getattr(dimension, ask)(df.mapInArrow(counted, df.schema), items)
    assert len(got.collect()) == 3000 and read.value <= 2 * 3000


def test_json_lines_are_written_packed(spark):
    from workload import sources

    assert all(f.endswith(".json.gz") for f in sources.import_json(spark, "/root/testdata/sf0.001").inputFiles())
