import hashlib
import random
import re

import pytest
from odd_texts import TEXTS
from pyspark.sql import functions as F

from purchaselens.llm import iblt


def paragraphs(text):
    return {p for p in re.split(r"\n+|(?<=[.!?])[ \t\n\x0b\x0c\r]+", text or "") if p}


def near(a, b):
    a, b = paragraphs(a), paragraphs(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def check(rows, got):
    """``rows`` (doc_id, text) without repeated rows, in any order."""
    order = sorted({(i, t or "") for i, t in rows}, key=lambda r: (r[0] is None, -(r[0] or 0)))
    prints = {}
    by_hash = {}
    for k, (doc_id, text) in enumerate(order):
        follower = order[(k + 1) % len(order)][1]
        n = len(text)
        edited = text[: n - n // 3] + follower[: n // 3]
        by_hash[doc_id] = (n, hashlib.sha256(edited.encode()).hexdigest(), near(text, edited), near(text, follower), text, edited)
    for r in got:
        n, sha, ne, nn, text, edited = by_hash[r.doc_id]
        assert (r.n_chars, r.edited_sha256) == (n, sha)
        assert r.near_edited == pytest.approx(ne) and r.near_next == pytest.approx(nn)
        for t, f in ((text, r.fingerprint), (edited, r.edited_fingerprint)):
            assert prints.setdefault(frozenset(paragraphs(t)), f) == f
    assert len(set(prints.values())) == len(prints)


def test_equal_to_brute_force_on_odd_texts(spark):
    rng = random.Random(4)
    sentence = lambda: " ".join(rng.choices(["aa", "bb", "cc", "é", "日"], k=4)) + rng.choice([". ", "!\n", "\n", "? "])
    rows = [(i * 7 % 1009, t) for i, t in enumerate(TEXTS)] + [(None, "no id. Yes"), (-5, None), (2000, "")]
    rows += [(3000 + i, "".join(sentence() for _ in range(rng.randrange(1, 300)))) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS KEY", "2 AS n_chars", "3 AS part")
    got = iblt.edited_pairs(docs).collect()
    assert len(got) == len(rows)
    check(rows, got)


def test_small_blocks_give_the_same_order(spark, monkeypatch):
    monkeypatch.setattr(iblt, "BLOCK_ROWS", 3)
    rows = [(i, f"text {i}. and more {i % 3}.") for i in range(40)]
    check(rows, iblt.edited_pairs(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())


def test_repeated_rows_and_one_document(spark):
    rows = [(1, "a. b. c."), (1, "a. b. c."), (2, "a. x.")]
    got = iblt.edited_pairs(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert len(got) == 3
    check(rows, got)
    one = [(1, "a. b. c. d.")]
    check(one, iblt.edited_pairs(spark.createDataFrame(one, "doc_id bigint, text string")).collect())
    assert iblt.edited_pairs(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_recovered_digests_are_the_difference(spark):
    rng = random.Random(6)
    rows = []
    for i, n in enumerate([0, 1, 2, 10, 100, 3000]):
        left = [rng.getrandbits(64) - 2**63 for _ in range(n)]
        right = rng.sample(left, n // 2) + [rng.getrandbits(64) - 2**63 for _ in range(n // 3 + 1)]
        rows.append((i, left, right))
    pairs = spark.createDataFrame(rows, "i int, left array<bigint>, right array<bigint>")
    got = {r.i: r.difference for r in iblt.differences(pairs, "left", "right").collect()}
    for i, left, right in rows:
        assert set(got[i].left_only) == set(left) - set(right) and len(set(got[i].left_only)) == len(got[i].left_only)
        assert set(got[i].right_only) == set(right) - set(left)


def test_failing_tables_are_retried_larger(spark):
    """Digests that share all their cells of the smallest table, then of all tables."""
    low = [(7 << 50) | (k << 6) | 9 for k in range(3)]  # equal low 6 bits
    same = [(7 << 50) | (k << 43) for k in range(2)]  # equal low 42 bits
    pairs = spark.createDataFrame([(1, low, []), (2, same, [5 << 50])], "i int, left array<bigint>, right array<bigint>")
    got = {r.i: r.difference for r in iblt.differences(pairs, "left", "right").collect()}
    assert sorted(got[1].left_only) == low and 1 < got[1].tries <= len(iblt.SIZES)
    assert sorted(got[2].left_only) == same and got[2].right_only == [5 << 50]
    assert got[2].tries == len(iblt.SIZES) + 1


def test_plan_is_built_in(spark):
    docs = spark.createDataFrame([(1, "a. b.")], "doc_id bigint, text string")
    plan = iblt.edited_pairs(docs)._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("PythonUDF", "ArrowEval", "MapInPandas", "MapInArrow"))
    assert docs.select(iblt.fingerprint(F.array().cast("array<bigint>")).alias("f")).first().f == ",".join(["0:0:0"] * 12)
