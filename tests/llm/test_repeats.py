import random
import re

import numpy as np
import pytest
from odd_texts import TEXTS

from purchaselens.llm import repeats

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window):
    first = {}
    words_of = [WORD.findall(t or "") for _, t in rows]
    for (i, _), words in zip(rows, words_of, strict=True):
        for k in range(len(words) - window + 1 if i is not None else 0):
            key = tuple(words[k : k + window])
            first[key] = min(i, first.get(key, i))
    out = []
    for (i, t), words in zip(rows, words_of, strict=True):
        gone = set()
        for k in range(len(words) - window + 1 if i is not None else 0):
            if first[tuple(words[k : k + window])] < i:
                gone.update(range(k, k + window))
        runs = []
        for k in sorted(gone):
            if runs and sum(runs[-1]) == k:
                runs[-1][1] += 1
            else:
                runs.append([k, 1])
        out.append((i, t, len(words), len(gone), runs, " ".join(w for k, w in enumerate(words) if k not in gone)))
    return sorted(out, key=str)


def rows(seed):
    rng = random.Random(seed)
    text = lambda n: " ".join(rng.choices(["a", "b", "été"], k=n))
    passages = [text(n) for n in (12, 13, 14, 40)]
    out = [(i, f"{text(rng.randrange(0, 20))}\t{rng.choice(passages)} \n {text(rng.randrange(0, 9))}") for i in range(150)]
    out += [(200 + i, "a hot passage " * 10 + str(i)) for i in range(100)]
    out += [(-3, passages[3]), (None, passages[3]), (None, None), (5, None), (7, ""), (7, out[7][1]), (7, out[7][1])]
    out += [(900, text(6) + " " + passages[1]), (900, passages[1] + " " + text(6)), *((400 + i, t) for i, t in enumerate(TEXTS[:60]))]
    return out


@pytest.mark.parametrize("seed,batch", [(1, (8 << 20, 64 << 20)), (2, (500, 500)), (3, (3000, 3000))])
def test_equal_to_brute_force(spark, seed, batch):
    given = rows(seed)
    for window in (13, 3, 1):
        docs = spark.createDataFrame(given, "doc_id bigint, text string").selectExpr("*", "1 AS KEPT", "2 AS n_WORDS", "3 AS hashes")
        got = repeats.remove(docs, window=window, batch_bytes=batch).collect()
        found = [(r.doc_id, r.text, r.n_words, r.n_removed, [[x.start, x.length] for x in r.removed], r.kept) for r in got]
        assert sorted(found, key=str) == brute(given, window)
        assert all(r.hashes == 3 for r in got)
        if window == 13:
            assert any(r.n_removed for r in got) and any(not r.n_removed and r.n_words > 13 for r in got)
    assert repeats.remove(docs.limit(0)).count() == 0


def test_long_texts(spark):
    rng = random.Random(4)
    long = [str(rng.randrange(10**9)) for _ in range(220_000)]
    given = [(1, " ".join(long)), (2, "new " + " ".join(long[100_000:100_050]) + " end"), (3, "w" * 100_000)]
    given += [(4, " ".join(["x"] + long)), (5, "日" * 100_000 + " b" * 20)]
    docs = spark.createDataFrame(given, "doc_id bigint, text string")
    got = {r.doc_id: r for r in repeats.remove(docs).collect()}
    assert [got[i].n_removed for i in (1, 2, 3, 4, 5)] == [0, 50, 0, 220_000, 0]
    assert (got[2].kept, got[4].kept, got[3].kept) == ("new end", "x", "w" * 100_000)
    assert [tuple(x) for x in got[2].removed] == [(1, 50)]


def test_rolled_hashes_and_unequal_pairs():
    rng = np.random.default_rng(1)
    codes = rng.integers(0, 2**63, 50).astype(np.uint64)
    base = repeats._BASES[0]
    want = [sum(int(c) * base**k for k, c in enumerate(codes[i : i + 13])) % 2**64 for i in range(38)]
    assert repeats.rolled(codes, base, 13).tolist() == want
    first, second = np.array([5, 5, 1, 5], np.uint64), np.array([1, 2, 9, 1], np.uint64)
    order, new = repeats.alike(first, second)
    assert order.tolist() == [2, 0, 3, 1] and new.tolist() == [True, True, False, True]
