"""Encoders, the cohort summary, lines stored by guest, names on several rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from purchaselens.operators import cohort, reports
from purchaselens.operators import similarity as s
from purchaselens.plans.scratch import scratch_path
from purchaselens.sources import lines
from tests.lines import frame, line, random_lines

S, E = "2025-01-01", "2025-12-31"


def test_a_model_encodes_batches(spark):
    def loads():
        def predict(texts):
            return np.array([[len(t), 1.0, t.count("a")] for t in texts])

        return predict

    df = spark.createDataFrame([(1, "banana"), (2, None), (3, ""), (4, "a")], "id int, t string").repartition(2)
    got = {r.id: r.vector for r in s.embed_profiles(df, "t", s.batch_encoder(loads, 2)).collect()}
    for i, v in {1: [6, 1, 3], 2: [0, 1, 0], 3: [0, 1, 0], 4: [1, 1, 1]}.items():
        assert got[i] == pytest.approx(np.array(v) / np.linalg.norm(v))


def test_a_fitted_vocabulary(spark):
    df = spark.createDataFrame([("the cat",), ("The dog the",), ("cat, CAT!",), (None,), ("rare",)], "t string")
    encoder = s.VocabularyEncoder.fit(df, "t", 2)
    assert encoder.terms == ("cat", "the")  # both in two texts, ties by term
    new = spark.createDataFrame([("cat cat the rare",), ("none",), (None,)], "t string")
    got = [[tuple(w) for w in r.weights] for r in encoder.weights(new, "t").collect()]
    assert got[1:] == [[], []] and [t for t, _ in got[0]] == ["cat", "the"]
    assert [w for _, w in got[0]] == pytest.approx([2 / 5**0.5, 1 / 5**0.5])
    dense = s.embed_custom(new, "t", encoder).collect()
    assert dense[0].vector == pytest.approx([2 / 5**0.5, 1 / 5**0.5]) and dense[1].vector == [0.0, 0.0]
    with pytest.raises(ValueError):
        s.VocabularyEncoder.fit(df.limit(0), "t")


def test_pairs_stay_single_rows_where_a_name_repeats(spark):
    rows = [("a", "f", [1.0, 0.0]), ("b", "f", [0.6, 0.8]), ("b", "f", [0.0, 1.0])]
    index = s.ItemIndex.of(spark.createDataFrame(rows, "name string, family string, vector array<double>"))
    pairs = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "b")], "a string, b string")
    got = [(r.a, r.b, round(r.similarity, 9)) for r in s.pair_similarity(pairs, index).collect()]
    assert sorted(got) == [("a", "b", 0.0), ("b", "a", 0.0), ("b", "b", 1.0)]


@pytest.mark.parametrize("rows", [random_lines(150), [line("T", None, "2025-02-01", "Candle", None, channel=None)] * 3, []])
def test_summary_equals_the_three_answers(spark, rows):
    df = frame(spark, rows) if rows else frame(spark, random_lines(5)).limit(0)
    one = cohort.cohort_summary(df, "Candle", S, E, 3).first()
    stats = cohort.cohort_stats(df, "Candle", S, E).first()
    assert tuple(one)[:4] == tuple(stats)
    assert [tuple(x) for x in one.top_fragrances] == [tuple(x) for x in cohort.cohort_top_fragrances(df, "Candle", S, E, 3).collect()]
    assert [tuple(x) for x in one.channel_mix] == [tuple(x) for x in cohort.cohort_channel_mix(df, "Candle", S, E).collect()]


def test_the_summary_reads_its_lines_once(spark):
    read = spark.sparkContext.accumulator(0)
    df = frame(spark, random_lines(60))
    counted = df.mapInArrow(lambda batches: ((read.add(b.num_rows), b)[1] for b in batches), df.schema)
    cohort.cohort_summary(counted, "Candle", S, E).collect()
    assert read.value == 60


def test_channels_in_one_pass(spark):
    read = spark.sparkContext.accumulator(0)
    df = frame(spark, random_lines(80))
    counted = df.mapInArrow(lambda batches: ((read.add(b.num_rows), b)[1] for b in batches), df.schema)
    got = reports.channel_performance(counted, S, E).agg(F.sum("transactions")).first()[0]
    assert read.value == 80 and got == df.filter(reports.in_range(S, E)).count()


def test_questions_over_lines_stored_by_guest_need_no_shuffle(spark):
    df = frame(spark, random_lines(200))
    table = lines.save_guest_lines(df, "t_guest_lines", scratch_path(spark, "guests"), 4)
    ask = lambda t: reports.cross_sell_exact(t, "Candle", "Body Wash", S, E)
    joined = ask(table)
    want = sorted(map(str, ask(df).collect()))
    assert sorted(map(str, joined.collect())) == want
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan.split("Initial Plan")[0] and "Bucketed: true" in plan
    spark.sql("DROP TABLE t_guest_lines")
