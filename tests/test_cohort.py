import itertools

import pytest

from purchaselens.operators import cohort as c
from purchaselens.plans import joins
from tests.lines import D, PAIRS, frame, line, pair_frame, random_lines

YEAR = ("2025-01-01", "2025-12-31")
A, B = "Body Lotion", "Laundry Soap"
NO_PAIRS = [("none", "nothing", 0.9)]

ZERO = [line(f"T{i}", f"G00{i}", f"2025-03-0{i}", A, s) for i, s in
        enumerate(["Lavender", "Lemon Drop", "Lavender", "Coconut", "Lavender"], 1)]
ZERO += [line(f"T1{i}", f"G10{i}", f"2025-03-0{i}", B, s) for i, s in
         enumerate(["Fresh Cotton", "Lavender", "Eucalyptus", "Lemon Drop", "Fresh Cotton"], 1)]
ROOT_A = [line("TA1", "G201", "2025-03-01", A, "Lavender"),
          line("TA2", "G201", "2025-03-15", B, "Lavender"),
          line("TA3", "G202", "2025-03-05", A, "Coconut")]
ROOT_B = [line(f"TB{i}{k}", f"G30{i}", f"2025-03-0{i}", k, s)
          for i, s in enumerate(["Lavender", "Coconut", "Lavender"], 1) for k in (A, B)]


@pytest.mark.parametrize("rows,size,hits", [(ZERO, 5, 0), (ROOT_A, 2, 1), (ROOT_B, 3, 3)])
def test_fixtures(spark, rows, size, hits):
    out = c.cross_sell_similar(frame(spark, rows), pair_frame(spark, NO_PAIRS), A, B, *YEAR).first()
    assert (out.cohort_size, out.cross_sell_count) == (size, hits)
    assert out.conversion_rate == pytest.approx(round(hits * 100 / size, 1))


def test_two_roots_do_not_mix(spark):
    pairs = pair_frame(spark, NO_PAIRS)
    got = [c.cross_sell_similar(frame(spark, r), pairs, A, B, *YEAR).first().cross_sell_count
           for r in (ROOT_A, ROOT_B, ROOT_A)]
    assert got == [1, 3, 1]


def test_zero_overlap_is_refused(spark):
    out = c.cross_sell_recommendations(
        frame(spark, ZERO), pair_frame(spark, NO_PAIRS), *YEAR, threshold=0.6).collect()
    assert {(x.category_a, x.category_b) for x in out} == {(A, B), (B, A)}
    for x in out:
        assert not x.allowed_to_recommend and x.overlap_count == 0
        assert "overlap" in x.reason and x.fragrance_pairs == []
    assert out[0].cohort_id.endswith("|2025-01-01|2025-12-31|thr=0.6")


def by_hand(rows, a, b, start, end, pairs=PAIRS):
    """(cohort guests, hit guests, best match per (guest, A scent))."""
    similar = {(x, y): s for x, y, s in pairs}
    cohort = {(r[1], r[4]) for r in rows if r[3] == a and start <= r[2] <= end}
    best = {}
    for guest, scent in cohort:
        if not scent or guest is None:
            continue
        found = [
            (r[2], r[4], 1.0 if r[4] == scent else similar[scent, r[4]])
            for r in rows
            if r[1] == guest and r[3] == b and r[4]
            and (r[4] == scent or (scent, r[4]) in similar)
        ]
        if found:
            best[guest, scent] = min(found)
    return {g for g, _ in cohort if g is not None}, {g for g, _ in best}, best


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("kinds", [(A, B), ("Candle", "Candle")])
def test_against_brute_force(spark, seed, kinds):
    rows = random_lines(300, 40, seed)
    start, end = D(2025, 1, 10), D(2025, 2, 10)
    guests, hits, best = by_hand(rows, *kinds, start, end)
    for parts in (1, 6):
        t, p = frame(spark, rows, parts), pair_frame(spark)
        out = c.cross_sell_similar(t, p, *kinds, start, end).first()
        assert (out.cohort_size, out.cross_sell_count) == (len(guests), len(hits))
        got = c.cross_sell_matches(t, p, *kinds, start, end, 10_000).collect()
        assert {(x.guest_id, x.a_fragrance): (x.b_fragrance, x.similarity) for x in got} == {
            k: v[1:] for k, v in best.items()}
        assert [(x.guest_id, x.a_fragrance) for x in got] == sorted(best)


def test_recommendations_against_single_questions(spark):
    rows = random_lines(300, 40, 5)
    start, end = D(2025, 1, 10), D(2025, 3, 10)
    t, p = frame(spark, rows, 4), pair_frame(spark)
    out = c.cross_sell_recommendations(t, p, start, end, 0.6, sample=5).collect()
    kinds = sorted({r[3] for r in rows})
    assert {(x.category_a, x.category_b) for x in out} == set(itertools.permutations(kinds, 2))
    for x in out:
        guests, hits, best = by_hand(rows, x.category_a, x.category_b, start, end)
        assert (x.cohort_size, x.overlap_count) == (len(guests), len(hits))
        want = [(f"{x.category_a} ({s})", f"{x.category_b} ({best[g, s][1]})") for g, s in sorted(best)[:5]]
        assert [(m.a, m.b) for m in x.fragrance_pairs] == want
    one = c.cross_sell_recommendation(t, p, A, B, start, end, 0.6, sample=5).collect()
    assert one == [x for x in out if (x.category_a, x.category_b) == (A, B)]


def test_recommendations_read_the_lines_once(spark, tmp_path):
    frame(spark, random_lines(300, 40, 5), 4).write.parquet(str(tmp_path / "lines"))
    pair_frame(spark).write.parquet(str(tmp_path / "pairs"))
    t, p = (spark.read.parquet(str(tmp_path / n)) for n in ("lines", "pairs"))
    out = c.cross_sell_recommendations(t, p, D(2025, 1, 10), D(2025, 3, 10), 0.6)
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    assert "WindowGroupLimit" in plan


def test_beyond_the_broadcast_bound(spark, monkeypatch):
    """The shuffled join gives the same answer as the broadcast one."""
    rows = random_lines(300, 40, 7)
    args = (frame(spark, rows, 4), pair_frame(spark), A, B, *YEAR)
    small = c.cross_sell_similar(*args).collect()
    monkeypatch.setattr(joins, "BROADCAST_BYTES", 0)
    assert c.cross_sell_similar(*args).collect() == small


def test_names_of_any_length(spark):
    long_a, long_b = "a" * 5000, "b" * 5000
    rows = [line("1", "G", "2025-03-01", A, long_a), line("2", "G", "2025-03-02", B, long_b)]
    pairs = spark.createDataFrame([(long_a, long_b, 0.7)], "a string, b string, similarity double")
    out = c.cross_sell_similar(frame(spark, rows), pairs, A, B, *YEAR).first()
    assert (out.cohort_size, out.cross_sell_count) == (1, 1)


def test_cohort_stats(spark):
    rows = ROOT_A + [line("X", None, "2025-03-01", A, None, 1.0)]
    out = c.cohort_stats(frame(spark, rows), A, *YEAR).first()
    assert (out.unique_guests, out.total_purchases, out.avg_price, out.total_revenue) == (2, 3, 9.67, 29.0)
    top = c.cohort_top_fragrances(frame(spark, rows), A, *YEAR).collect()
    assert [(x.fragrance, x.cnt) for x in top] == [("Coconut", 1), ("Lavender", 1), (None, 1)]
    empty = c.cohort_stats(frame(spark, rows), "Candle", *YEAR).first()
    assert (empty.unique_guests, empty.total_revenue) == (0, None)


def test_empty_cohort(spark):
    out = c.cross_sell_similar(frame(spark, ROOT_A), pair_frame(spark), "Candle", B, *YEAR).first()
    assert (out.cohort_size, out.cross_sell_count, out.conversion_rate) == (0, 0, 0.0)
