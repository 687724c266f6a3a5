"""The checked ways in: deliveries and tools."""

import pytest
from pyspark.sql import functions as F

from purchaselens.functions.guards import InvalidInput
from purchaselens.operators import cohort, similarity, validate
from purchaselens.plans.tools import TOOLS, Data, run_tool
from purchaselens.sources import intake
from tests.lines import frame, line, random_lines

DAYS = {"start": "2025-01-01", "end": "2025-12-31"}


def test_import_judges_stores_and_reports(spark, tmp_path):
    (tmp_path / "My Lines-1.csv").write_text(
        "guest_id,transaction_id,transaction_date,product_type,fragrance,price,discount_amount,discount_code,channel,more\n"
        "G1,T1,2025-01-02,Candle,Beach,5.0,,,Online,x\n"
        "G 2,T2,2025-02-30,Candle,a;b,much,,,Online,x\n"
        "G3,T3,2025-01-03,,,1,,,Store,x\n"
    )
    report = intake.import_transactions(spark, str(tmp_path / "My Lines-1.csv"), str(tmp_path / "out"), root=str(tmp_path)).first()
    assert (report.table, report.row_count, report.valid, report.rejected) == ("my_lines_1", 3, 1, 2)
    good = intake.valid_lines(spark, report.path).first()
    assert (good.transaction_id, good.guest_id, good.price) == ("T1", "G1", 5.0)
    bad = {r.transaction_id: r.reasons for r in intake.rejected_lines(spark, report.path).collect()}
    assert bad == {"T2": ["transaction_date", "guest_id", "fragrance", "price"], "T3": ["product_type"]}
    with pytest.raises(InvalidInput):
        intake.import_transactions(spark, str(tmp_path / ".." / "x.csv"), str(tmp_path), root=str(tmp_path))


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    vectors = spark.createDataFrame(
        [("Beach", "f", [1.0, 0.0]), ("Honey", "f", [0.8, 0.6])], "name string, family string, vector array<double>")
    index = similarity.ItemIndex.of(vectors)
    return Data(frame(spark, random_lines(300, 40, 5)), similarity.similarity_pairs(index, 0.5), index,
                str(tmp_path_factory.mktemp("export")))


def arguments(name):
    values = {**DAYS, "category": "Candle", "cat_a": "Candle", "cat_b": "Body Lotion", "n": "3", "top_n": 2,
              "threshold": "0.5", "item": "Beach", "name": "spring"}
    return {k: values[k] for k in TOOLS[name].params}


@pytest.mark.parametrize("name", TOOLS)
def test_tools_answer_and_refuse(data, name):
    good = arguments(name)
    assert run_tool(data, name, good).count() >= 1
    for kind, bad in (("category", "Candle' OR '1'='1"), ("date", "2025-02-30"), ("item", "a; DROP"),
                      ("count", "1; DROP"), ("share", "2")):
        for field in (f for f, k in TOOLS[name].params.items() if k == kind):
            with pytest.raises(InvalidInput, match=field):
                run_tool(data, name, {**good, field: bad})
    with pytest.raises(InvalidInput):
        run_tool(data, name, {**good, "extra": 1})
    with pytest.raises(InvalidInput):
        run_tool(Data(None), name, good)


def test_unknown_tool(data):
    with pytest.raises(InvalidInput):
        run_tool(data, "nope", {})


def test_one_pass_forms_equal_the_two_sided_ones(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, product_type string")
    allowed = spark.createDataFrame([("a",), ("a",)], "t string")
    marked = {r.id: r.known for r in validate.mark_known(df, allowed).collect()}
    assert marked == {1: True, 2: False, 3: False}
    assert [r.id for r in validate.known_category(df, allowed).collect()] == [1]
    assert sorted(r.id for r in validate.known_category(df, allowed, keep=False).collect()) == [2, 3]
    rules = {"type": F.col("product_type") == "a"}
    judged = {r.id: r.reasons for r in validate.judge(df, rules).collect()}
    assert judged == {1: [], 2: ["type"], 3: ["type"]}


def test_nobody_in_the_cohort(spark):
    lines = frame(spark, [line("T", "G", "2025-01-02", "Candle", "Beach")])
    pairs = spark.createDataFrame([], "a string, b string, similarity double")
    out = cohort.cross_sell_recommendation(lines, pairs, "Body Wash", "Candle", "2025-01-01", "2025-12-31", 0.6)
    assert out.count() == 0
