import random
import re

import pytest
from odd_texts import TEXTS

from purchaselens.llm import winnow

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(FOLD))


def brute(docs, items):
    windows = {}
    for item, text in items:
        w = words(text)
        size = min(10, len(w))
        for k in range(len(w) - size + 1 if w else 0):
            windows.setdefault((size, tuple(w[k : k + size])), set()).add(item)
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for size in {z for z, _ in windows}:
            for k in range(len(w) - size + 1):
                got = windows.get((size, tuple(w[k : k + size])))
                if got is not None:
                    hit.update(range(k, k + size))
                    found |= got
        out.append((doc_id, len(w), len(hit), sorted(str(x) for x in found if x is not None), bool(hit)))
    return sorted(out, key=str)


def make(seed):
    """Few words, so that grams repeat and tie."""
    rng = random.Random(seed)
    text = lambda n: " ".join(rng.choices(["a", "b", "The", "été", "x1"], k=n))
    items = [(i, text(rng.choice([0, 1, 3, 5, 8, 9, 10, 11, 15, 40]))) for i in range(14)]
    items += [(100, items[-1][1]), (None, text(12)), (101, None), (102, "!!"), (100, "b The b The b The b The b The b The")]
    docs = [(i, text(rng.randrange(0, 60))) for i in range(60)]
    docs += [(200 + i, f"{text(4)}, {(t or '').upper()}! {text(3)}") for i, (_, t) in enumerate(items)]
    docs += [(None, items[9][1]), (None, None), (7, items[9][1]), (7, items[9][1])] + [(300 + i, t) for i, t in enumerate(TEXTS[:40])]
    return docs, items


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("short", [True, False])
def test_equal_to_brute_force(spark, seed, short):
    docs, items = make(seed)
    if not short:
        items = [x for x in items if len(words(x[1])) >= 10]
    d = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "1 AS KEY", "2 AS mark", "3 AS words")
    b = spark.createDataFrame(items, "item_id bigint, text string").selectExpr("*", "1 AS size")
    got = [(r.doc_id, r.n_words, r.n_hit, list(r.items), r.contaminated) for r in winnow.decontaminate(d, b).collect()]
    assert sorted(got, key=str) == brute(docs, items)
    kept = sorted(((r.doc_id, r.text) for r in winnow.clean(d, b).collect()), key=str)
    flags = dict(zip(docs, (brute([x], items)[0][4] for x in docs), strict=True))
    assert kept == sorted((x for x in docs if not flags[x]), key=str)


def test_empty_sides(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")
    b = spark.createDataFrame([(1, "a b")], "item_id bigint, text string")
    assert winnow.decontaminate(d.limit(0), b).count() == 0
    out = winnow.decontaminate(d, b.limit(0)).first()
    assert (out.n_words, out.n_hit, out.contaminated) == (2, 0, False)


def test_plan_is_built_in(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")
    b = spark.createDataFrame([(1, "a b")], "item_id bigint, text string")
    plan = winnow.decontaminate(d, b)._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("PythonUDF", "ArrowEval", "MapInPandas", "MapInArrow"))


def test_long_texts_that_hold_a_whole_benchmark(spark):
    rng = random.Random(9)
    items = [(i, " ".join(f"w{rng.randrange(5000)}" for _ in range(300))) for i in range(40)]
    filler = " ".join(f"v{k}" for k in range(150_000))
    docs = [(1, " ".join(t for _, t in items) + " " + filler), (2, filler), (3, "w" * 100_000 + " " + items[3][1]), (4, "é, " * 700_000)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    b = spark.createDataFrame(items, "item_id bigint, text string")
    got = {r.doc_id: r for r in winnow.decontaminate(d, b).collect()}
    assert (got[1].n_hit, len(got[1]["items"])) == (12_000, 40)
    assert (got[3].n_hit, got[3]["items"]) == (300, ["3"])
    assert [got[i].n_hit for i in (2, 4)] == [0, 0] and got[4].n_words == 700_000
