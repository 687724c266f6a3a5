import random
import re

import numpy as np
import pytest
from odd_texts import TEXTS
from pyspark.sql import functions as F

from purchaselens.llm import periods, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(words, least=6, times=4):
    """Every period over every stretch, the smallest period of each stretch kept."""
    n, stretches = len(words), {}
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, times * q):
                stretches.setdefault((i, j + q), q)
            i = j + 1
    runs = sorted((a, b - a, q) for (a, b), q in stretches.items())
    gone = {k for a, size, q in runs for k in range(a + q, a + size)}
    return runs, [w for k, w in enumerate(words) if k not in gone]


def samples():
    rng = random.Random(5)
    for size in (1, 2, 3):
        for _ in range(250):
            yield rng.choices("abc"[:size], k=rng.randrange(0, 70))
    for _ in range(250):  # powers of powers, cut and spoilt
        unit = rng.choices("abcd", k=rng.randrange(1, 6)) * rng.randrange(1, 6)
        words = unit * rng.randrange(1, 12) + rng.choices("abcd", k=rng.randrange(0, 4)) + unit * rng.randrange(0, 6)
        if words and rng.random() < 0.6:
            words[rng.randrange(len(words))] = "x"
        yield words[rng.randrange(0, 3) :]
    fib = ["a", "ab"]
    while len(fib[-1]) < 150:
        fib.append(fib[-1] + fib[-2])
    yield list(fib[-1])
    yield ["a"] * 1000
    yield (["a"] * 6 + ["b"]) * 30


def test_runs_by_brute_force():
    for words in samples():
        codes = np.unique(words, return_inverse=True)[1].astype(np.int64) if words else np.zeros(0, np.int64)
        assert periods.find_runs(codes) == brute(words)[0], words
    for words in samples():
        codes = np.unique(words, return_inverse=True)[1].astype(np.int64) if words else np.zeros(0, np.int64)
        assert periods.find_runs(codes, 2, 5) == brute(words, 2, 5)[0], words
    with pytest.raises(ValueError):
        periods.find_runs(np.zeros(3, np.int64), 6, 3)


def test_texts_by_brute_force(spark):
    texts = [" ".join(w) for w in samples()] + TEXTS + [None, "", "\x1fa\x1c a\x85 a", "a\ta\na\x0ba\x0ca\ra "]
    texts += ["k v w " * 340_000, "w" * 100_000, " ".join(map(str, range(200_000))), "the same"]
    given = [*enumerate(texts), (None, "a " * 9), (3, "a " * 9), (3, "a " * 9)]
    docs = spark.createDataFrame(given, "doc_id bigint, text string").selectExpr("*", "1 AS RUNS", "2 AS N_words", "3 AS period")
    got = periods.collapse(docs).collect()
    assert len(got) == len(given) and all(r.period == 3 for r in got)
    seen = {}
    for r in got:
        if r.text not in seen:
            words = WORD.findall(r.text or "")
            if len(words) > 5000:  # all one run, or none
                same = words[0] == words[3]
                want = ([(0, len(words), 3)], words[:3]) if same else ([], words)
            else:
                want = brute(words)
            seen[r.text] = len(words), want
        n, (runs, kept) = seen[r.text]
        assert (r.n_words, [tuple(x) for x in r.runs], r.collapsed) == (n, runs, " ".join(kept))
    assert periods.collapse(docs.limit(0)).count() == 0
    assert "text" not in periods.collapse(docs, keep_text=False).columns


def test_planted_words_of_the_query(spark):
    import zlib

    rng = random.Random(8)
    given = [(i, " \n".join(rng.choices(["w%d" % k for k in range(50)], k=rng.randrange(0, 80)))) for i in range(300)]
    given += [(None, "a b"), (5, None)]
    docs = spark.createDataFrame(given, "doc_id bigint, text string")
    planted = 0
    for r in docs.select("*", queries.planted_words().alias("made")).collect():
        words = (r.text or "").split()
        n, h = len(words), zlib.crc32(b"" if r.doc_id is None else str(r.doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
            planted += 1
        assert r.made.split() == words
    assert planted > 10
    assert docs.select(F.lit(1)).count() == len(given)
