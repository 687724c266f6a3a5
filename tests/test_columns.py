"""Guards, text scores and the gate, value by value."""

import datetime
import random
import re

import pytest
from pyspark.sql import functions as F

from purchaselens.functions import guards as g
from purchaselens.functions import text as tx
from purchaselens.functions.money import money_avg, money_sum, round_to
from purchaselens.operators import quality, validate
from purchaselens.operators.gate import recommendation_gate


def flags(spark, values, rule):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [x.ok for x in df.select("i", rule(F.col("v")).alias("ok")).orderBy("i").collect()]


def is_date(v):
    try:
        return bool(re.fullmatch(r"[0-9]{4}-[0-9]{2}-[0-9]{2}", v)) and bool(
            datetime.date.fromisoformat(v)
        )
    except ValueError:
        return False


def test_valid_date(spark):
    values = ["2024-01-01'; DROP TABLE transactions; --", "2024/01/01", "2024-13-99", "", None,
              "123", "2026-05-19", "2024-02-29", "2023-02-29", "1900-02-29", "2000-02-29",
              "2024-04-31", "2024-00-10", "2024-01-00", "0000-01-01", "0001-01-01", "9999-12-31",
              "2024-01-01\n", " 2024-01-01", "2024-1-1", "٢٠٢٤-٠١-٠١"]
    rng = random.Random(0)
    values += [f"{rng.randrange(1, 9999):04d}-{rng.randrange(15):02d}-{rng.randrange(34):02d}"
               for _ in range(500)]
    got = flags(spark, values, g.valid_date)
    assert got == [v is not None and is_date(v) for v in values]
    for v, ok in zip(values, got):
        if ok:
            assert g.check_date(v) == datetime.date.fromisoformat(v)
        else:
            with pytest.raises(g.InvalidInput):
                g.check_date(v)


def test_valid_names_and_ids(spark):
    names = ["Lavender", "Lemongrass + Eucalyptus", "Lavender' OR '1'='1", 'Lavender"', "a;b",
             "a--b", "a/*b", "a*/b", "a\\b", "x" * 100, "x" * 101, None, ""]
    want = [True, True] + [False] * 7 + [True, False, False, True]
    assert flags(spark, names, g.valid_item_name) == want
    ids = ["g001", "G-002_xyz", "g456' OR '1'='1", "; DROP", "", "x" * 64, "x" * 65, None, "g1\n"]
    assert flags(spark, ids, g.valid_guest_id) == [True, True, False, False, False, True, False,
                                                  False, False]


def test_valid_int_and_category(spark):
    values = ["1", " 7 ", "-3", "1.5", "", None, "1; DROP", "10", "11", "9" * 30, "+1"]
    assert flags(spark, values, g.valid_int) == [True, True, True, False, False, False, False,
                                                True, True, True, False]
    assert flags(spark, values, lambda c: g.valid_int(c, 1, 10)) == [
        True, True, False, False, False, False, False, True, False, False, False]
    assert flags(spark, ["Candle", "candle", "Candle'", None], g.valid_category) == [
        True, False, False, False]
    for bad in (True, "x", 0, None, 1.5):
        with pytest.raises(g.InvalidInput):
            g.check_int(bad, low=1)
    assert g.check_int(" 12 ") == 12


def test_split_valid(spark):
    df = spark.createDataFrame([(1, "2024-01-01", "ok"), (2, "x", "a'b"), (3, None, "ok")],
                               "id int, d string, n string")
    rules = {"date": g.valid_date(F.col("d")), "name": g.valid_item_name(F.col("n"))}
    valid, rejected = validate.split_valid(df, rules)
    assert [x.id for x in valid.collect()] == [1]
    assert {x.id: x.reasons for x in rejected.collect()} == {2: ["date", "name"], 3: ["date"]}
    assert {x.id: x.r for x in df.select("id", validate.rejection_reasons(rules).alias("r")).collect()
            }[1] == []


def by_hand(text):
    if text is None or not text.strip():
        return 0.0
    low = text.lower()
    tokens = re.findall("[a-z]+", low)
    if not tokens:
        return 0.0
    hits = sum(t in set(tx.SCENT_TERMS) for t in tokens)
    hits += sum(low.count(t) for t in tx.SCENT_TERMS if " " in t)
    return min(1.0, hits / len(tokens))


TEXTS = [
    "viral luxury bestseller confidence energy unforgettable",
    "amazing incredible luxurious premium signature scent",
    "elite TikTok trending must-have obsession",
    "french lavender fields, calming purple floral, herbal relaxation, soothing",
    "creamy coconut milk, tropical coconut flesh, sweet island, warm",
    "eucalyptus, peppermint, menthol, clear airways, cooling medicinal",
    "Unscented", "", "   ", None, "123 !!", "Cherry Blossom cherry blossom, cherry  blossom",
    "lavender, jasmine, rose, floral, herbal, sweet, vanilla", "viral luxury confidence energy",
    "luxury rose",
]
FLUFF = [True, True, True, False, False, False, False, True, True, True, False, False, False, True,
         False]


def test_text(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, notes string")
    out = quality.score_profiles(df).orderBy("i").collect()
    assert [x.vocabulary_score for x in out] == pytest.approx([by_hand(t) for t in TEXTS])
    assert [x.is_fluff for x in out] == FLUFF
    assert out[12].vocabulary_score > 0.4 and out[13].vocabulary_score < 0.1
    accepted, review = quality.quarantine_profiles(df)
    assert accepted.count() == FLUFF.count(False) and review.count() == FLUFF.count(True)


def test_vocabulary_parameter(spark):
    df = spark.createDataFrame([("one two two three",)], "t string")
    score = df.select(tx.vocabulary_score(F.col("t"), ["two two"]).alias("s")).first().s
    assert score == 0.25
    assert len(set(tx.SCENT_TERMS)) == len(tx.SCENT_TERMS) == 158


GATE = [
    # cohort, overlap, threshold, baseline, lift, text -> allowed, confidence, word in reason
    (("zero", 0, 0.7, None, None, None), False, "none", "overlap"),
    (("null", None, 0.7, None, None, None), False, "none", "overlap"),
    (("unlogged", 100, None, None, None, None), False, "none", "threshold"),
    (("lift", 100, 0.7, None, 2.5, None), False, "none", "baseline"),
    (("promise", 100, 0.7, None, None, "Run it: WILL INCREASE sales by 20%"), False, "none",
     "will increase"),
    (("first", 100, 0.7, None, None, "guaranteed, it will drive sales"), False, "none",
     "'will drive'"),
    (("high", 50, 0.7, 0.1, 2.5, "a hypothesis"), True, "high", "50"),
    (("medium", 50, 0.69, None, None, None), True, "medium", "0.69"),
    (("medium2", 20, 0.6, None, None, None), True, "medium", "medium"),
    (("low", 19, 0.9, None, None, ""), True, "low", "low"),
]


def test_gate(spark):
    df = spark.createDataFrame(
        [row for row, *_ in GATE],
        "cohort_id string, overlap_count int, similarity_threshold double, baseline_rate double, "
        "lift double, recommendation string",
    )
    out = {x.cohort_id: x for x in recommendation_gate(df).collect()}
    for row, allowed, confidence, word in GATE:
        got = out[row[0]]
        assert (got.allowed_to_recommend, got.confidence) == (allowed, confidence), row
        assert word in got.reason, got.reason


def test_gate_without_optional_evidence(spark):
    df = spark.createDataFrame([("c", 60)], "cohort_id string, overlap_count int")
    got = recommendation_gate(df).first()
    assert not got.allowed_to_recommend and "threshold" in got.reason


def test_money(spark):
    rows = [(0.1,)] * 10 + [(None,), (1.005,)]
    df = spark.createDataFrame(rows, "x double")
    out = [df.repartition(n).agg(money_sum("x").alias("s"), money_avg("x").alias("a")).first()
           for n in (1, 5)]
    assert out[0] == out[1]
    assert (out[0].s, out[0].a) == (2.005, 2.005 / 11)
    got = spark.createDataFrame([(1.005,), (2.675,), (0.125,)], "x double").select(
        round_to("x", 2).alias("r")).collect()
    assert [x.r for x in got] == [1.0, 2.68, 0.13]


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_large_sums_are_exact(spark, ansi):
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        df = spark.range(1000).select(F.lit(1e12).alias("x"))
        assert df.agg(money_sum("x").alias("s")).first().s == 1e15
        with pytest.raises(Exception, match="above"):
            spark.range(1).select(F.lit(1e16).alias("x")).agg(money_sum("x")).collect()
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


def test_one_rule_for_parameters_and_columns(spark):
    for value in ("Lavender", "a'b", "x" * 101, ""):
        for rule, check in ((g.valid_item_name, g.check_item_name), (g.valid_guest_id, g.check_guest_id),
                            (g.valid_category, g.check_category)):
            ok = flags(spark, [value], rule)[0]
            if ok:
                assert check(value) == value
            else:
                with pytest.raises(g.InvalidInput):
                    check(value)
