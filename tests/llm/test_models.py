import random
import string
import zlib

import numpy as np
import pytest
from odd_texts import TEXTS

from purchaselens.llm import fm, langid
from purchaselens.llm.queries import op2_language, op10_quality

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    return langid.learned(spark.read.parquet(f"{SF}/documents.parquet"))


def test_languages_of_held_out_documents(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = op2_language(spark, SF).collect()
    assert len(got) == len(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r.held_out]
    assert np.mean([r.lang_pred == docs[r.doc_id].lang for r in held]) > 0.98
    assert all(0 <= r.score <= 1 for r in got)
    assert sum(r.rejected for r in got) <= 2  # and those have no letters


def test_texts_of_no_language(spark, model):
    rng = random.Random(2)
    noise = ["".join(rng.choices("qxzjkvwy", k=6)) for _ in range(200)]
    rows = [None, "", "123 ?!", "\n", " ".join(noise), "the and of that this with"] + TEXTS
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string").selectExpr("*", "1 AS SCORE", "'x' AS lang_pred")
    got = {r.doc_id: r for r in langid.identify(docs, model).collect()}
    assert len(got) == len(rows)
    for i in range(4):
        assert (got[i].lang_pred, got[i].score, got[i].rejected) == ("und", 0.0, True)
    assert got[4].rejected and got[4].lang_pred in model.languages
    assert got[5].lang_pred == "en" and not got[5].rejected
    for i, t in enumerate(rows):
        has = bool(t) and any(c.isalpha() for c in t)
        assert (got[i].lang_pred == "und") == (not has)


def test_several_centroids_a_language(model):
    assert all((model.owner == k).sum() > 1 for k in range(len(model.languages)))
    assert np.allclose(np.linalg.norm(model.centroids, axis=1), 1, atol=1e-5)


def test_training_sample_is_bounded_whatever_the_copies(spark, monkeypatch):
    rows = [(f"copied text {k} " + "abcdefghij"[k % 10] * 5, "en") for k in range(300) for _ in range(40)]
    rows += [(f"mot {k} de la langue", "fr") for k in range(30)] * 20
    docs = spark.createDataFrame(rows, "text string, lang string")
    seen, cluster = [], langid._cluster
    monkeypatch.setattr(langid, "_cluster", lambda v, k: seen.append(v) or cluster(v, k))
    models = [langid.train(docs.repartition(n), sample=50) for n in (3, 7)]
    assert [len(v) for v in seen] == [50, 30] * 2
    assert np.array_equal(models[0].centroids, models[1].centroids)


def test_no_training_rows(spark):
    docs = spark.createDataFrame([(1, None, "en"), (2, "text", None)], "doc_id bigint, text string, lang string")
    model = langid.train(docs)
    assert {r.lang_pred for r in langid.identify(docs, model).collect()} == {"und"}
    assert langid.identify(docs.limit(0), model).count() == 0


def test_pair_term_equals_the_double_sum():
    rng = np.random.default_rng(1)
    machine = fm.Machine(0.3, rng.normal(size=fm.FEATURES), rng.normal(size=(fm.FEATURES, fm.FACTORS)))
    at, x = fm.features("Some words, some MORE words | 12\nand a line")
    double = machine.bias + machine.weights[at] @ x + sum(
        machine.factors[at[i]] @ machine.factors[at[j]] * x[i] * x[j]
        for i in range(len(at)) for j in range(i + 1, len(at))
    )
    assert machine.raw(at, x) == pytest.approx(double)


def test_quality_of_held_out_documents(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = op10_quality(spark, SF).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    held = [(r.score, labels[r.doc_id]) for r in got if r.held_out and r.doc_id in labels]
    good, bad = [s for s, y in held if y == 1], [s for s, y in held if y == 0]
    assert np.mean([a > b for a in good for b in bad]) > 0.97
    assert np.mean([(s >= 0.7) == y for s, y in held]) > 0.93


def test_odd_texts_and_missing_labels(spark):
    rows = [(i, t) for i, t in enumerate([None, "", *TEXTS])] + [(None, "x"), (3, string.ascii_letters * 50)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'a' AS Score")
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    out = fm.score(docs, fm.train(docs, none)).collect()
    assert len(out) == len(rows) and {r.score for r in out} == {0.5}
    odd = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (999, 0), (4, 1), (5, 0)], "doc_id bigint, quality int")
    machine = fm.train(docs, odd)
    assert all(0 <= r.score <= 1 for r in fm.score(docs, machine).collect())
    assert fm.score(docs.limit(0), machine).count() == 0


def test_languages_equal_naive_cosines(spark, model):
    """TF-IDF vectors as dictionaries, compared with every centroid one by one."""
    rng = random.Random(6)
    rows = [t for t in TEXTS if t and any(c.isalpha() for c in t)][:120]
    rows += ["Straße und Überall, die " * 90_000, "w" * 100_000, rows[0], rows[0]]
    rows += [" ".join(rng.choices(["la", "the", "der", "que", "x9"], k=30)) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string")
    for r in langid.identify(docs, model).collect():
        folded = [c if c >= 128 or 97 <= c <= 122 else 32 for c in f" {r.text.lower()} ".encode()]
        letters = [c for k, c in enumerate(folded) if c != 32 or k == 0 or folded[k - 1] != 32]
        weights, multipliers = {}, {2: 2654435761, 3: 2246822519}
        for size, times in multipliers.items():
            for k in range(len(letters) - size + 1 if len(letters) >= 3 else 0):
                number = int.from_bytes(bytes(letters[k : k + size]), "big")
                at = (number * times % 2**32) >> 20
                weights[at] = weights.get(at, 0) + 1
        total = sum(weights.values())
        weights = {at: n**0.5 * model.idf[at] for at, n in weights.items()}
        length = sum(w * w for w in weights.values()) ** 0.5 or 1.0
        close = [sum(w * c[at] for at, w in weights.items()) / length for c in model.centroids.astype(float)]
        best = int(np.argmax(close))
        assert r.score == pytest.approx(min(1.0, max(0.0, close[best])), abs=1e-4)
        near = {model.languages[model.owner[k]] for k in range(len(close)) if close[k] > close[best] - 1e-5}
        assert r.lang_pred in near
        band = sum(total >= end for end in langid.LENGTHS)
        floor = model.floors[model.owner[best], band]
        assert r.rejected == (r.score < floor) or len(near) > 1 or abs(r.score - floor) < 1e-5


def naive_features(text):
    """Values of the hashed words and the classes of the statistics, by plain Python over ASCII text."""
    words, out = text.split(), {}
    for code in (int(h) >> (64 - fm.WORD_BITS) for h in fm.word_hashes(text.encode())):
        out[code] = out.get(code, 0) + 1
    values = {k: np.log1p(n) for k, n in out.items()}
    length = sum(v * v for v in values.values()) ** 0.5
    values = {k: v / length for k, v in values.items()}
    n, many = max(1, len(text)), max(1, len(words))
    count = lambda test: sum(map(test, text)) / n
    low = [w.lower() for w in words]
    shares = [
        count(str.isupper), count(str.isdigit), count(lambda c: c in " \t\n\r\x0b\x0c"),
        count(lambda c: not (c.isalnum() or c in " \t\n\r\x0b\x0c.,")), count(lambda c: c in ".,"),
        sum(a == b for a, b in zip(low, low[1:], strict=False)) / many, len(set(low)) / many,
        min(1.0, (text.count("\n") + 1) / many), min(1.0, len(text) / 2**20),
    ]
    for k, share in enumerate(shares):
        kind = 0 if share <= 0 else min(15, max(1, 15 + int(np.floor(2 * np.log2(share)))))
        values[(1 << fm.WORD_BITS) + 16 * k + kind] = fm.STATISTIC_WEIGHT
    return values


def test_quality_features_and_score_by_plain_python(spark):
    rng = np.random.default_rng(3)
    machine = fm.Machine(-0.2, rng.normal(0, 0.3, fm.FEATURES), rng.normal(0, 0.2, (fm.FEATURES, fm.FACTORS)))
    texts = ["Some words, some MORE words | 12\nand a line", "a a a A b", "!!!", "x", "One. Two.\n\nThree"]
    texts += ["long text of many words " * 85_000, "w" * 100_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for r in fm.score(docs, machine).collect():
        values = naive_features(r.text)
        at, x = fm.features(r.text)
        assert dict(zip(at.tolist(), x.tolist(), strict=True)) == pytest.approx(values)
        keys = list(values)
        raw = machine.bias + sum(machine.weights[k] * values[k] for k in keys) + sum(
            machine.factors[a] @ machine.factors[b] * values[a] * values[b]
            for i, a in enumerate(keys) for b in keys[i + 1 :]
        )
        assert r.score == pytest.approx(1 / (1 + np.exp(-raw)), abs=1e-9)


def test_quality_sample_is_bounded_and_knows_no_order(spark, monkeypatch):
    rows = [(1, f"row {k % 900} of one id") for k in range(3000)] + [(k, f"text {k} {'bad!' * (k % 2)}") for k in range(2, 400)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(1, 400)] + [(10_000, 0)], "doc_id bigint, quality int")
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS y", "2 AS at")
    seen, fit = [], fm.fit
    monkeypatch.setattr(fm, "fit", lambda r, sizes=None: seen.append(r) or fit(r, sizes))
    machines = [fm.train(docs.repartition(n), labels, sample=40) for n in (2, 5)]
    for got in seen:
        assert [sum(y == k for _, _, y in got) for k in (0, 1)] == [40, 40]
    assert np.array_equal(machines[0].weights, machines[1].weights)
    assert np.array_equal(machines[0].factors, machines[1].factors)
    # An id with few texts counts once for each, however often they are repeated.
    few = spark.createDataFrame([(1, "same")] * 500 + [(2, "other"), (2, None)], "doc_id bigint, text string")
    fm.train(few, labels.where("doc_id <= 2"), sample=40)
    assert len(seen[-1]) == 3
