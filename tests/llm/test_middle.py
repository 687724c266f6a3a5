import hashlib
import random

import numpy as np
import pytest
from odd_texts import TEXTS

from purchaselens.llm import middle


def brute(doc_id, text):
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(text)
    if not n or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, "<S>" + text[b:] + "<P>" + text[:a] + "<M>" + text[a:b]
    return n, "psm", a, b - a, "<P>" + text[:a] + "<S>" + text[b:] + "<M>" + text[a:b]


def rows():
    rng = random.Random(3)
    mixed = ["".join(rng.choices("ab<>PSM é日👍\n\x00", k=rng.randrange(1, 60))) for _ in range(300)]
    out = list(enumerate([*TEXTS, *mixed, "a<P>b", "<S>", "x<M", "<", "S>" * 5, "é" * 50, "👍" * 50]))
    out += [(None, "no id"), (None, None), (7, None), (3, "again"), (3, "again"), (-5, "minus é")]
    out += [(9000, "long é日 " * 300_000), (9001, "w" * 100_000), (9002, "日" * 700_000)]
    return out


def test_equal_to_brute_force_and_restored(spark):
    given = rows()
    docs = spark.createDataFrame(given, "doc_id bigint, text string").selectExpr("*", "1 AS N", "2 AS FORM", "3 AS Restored", "4 AS other")
    got = middle.restore(middle.transform(docs)).collect()
    key = lambda r: (str(r[0]), r[1] or "", str(r))
    found = sorted(((r.doc_id, r.text, (r.n, r.form, r.prefix_chars, r.middle_chars, r.output)) for r in got), key=key)
    assert found == sorted(((i, t, brute(i, t)) for i, t in given), key=key)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert all(r.restored == (r.text or "") and r.other == 4 for r in got)
    assert middle.transform(docs.limit(0)).count() == 0


def test_places_in_both_units():
    text = "aé日👍" * 5 + "plain" + "ß"
    data = np.frombuffer(text.encode(), np.uint8)
    index = middle.Exceptions(data)
    chars = np.arange(len(text) + 1)
    places = np.array([len(text[:c].encode()) for c in chars])
    assert (index.bytes(chars) == places).all() and (index.chars(places) == chars).all()
    assert len(middle.Exceptions(np.frombuffer(b"ascii", np.uint8)).at_byte) == 0


def test_marks_and_rates(spark):
    docs = spark.createDataFrame([(i, f"text <P> {i}") for i in range(200)], "id int, body string")
    marks = middle.Marks("[pre]", "[suf]", "[mid]")
    made = middle.transform(docs, doc_id="id", text="body", cut_percent=100, spm_percent=0, marks=marks, keep_text=False)
    got = middle.restore(made, marks=marks).collect()
    assert {r.form for r in got} == {"psm"} and "body" not in made.columns
    assert all(r.restored == f"text <P> {r.id}" for r in got)
    for bad in (("", "b", "c"), ("aba", "x", "y"), ("<P>", "<P>x", "y"), ("ab", "bc", "x")):
        with pytest.raises(ValueError):
            middle.Marks(*bad)
