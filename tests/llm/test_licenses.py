import random
import re

import numpy as np
import pytest
import regex
from odd_texts import TEXTS

from purchaselens.llm import licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(text):
    words = WORD.findall((text or "").translate(FOLD))
    found = [
        (i, label) for phrase, label in licenses.PHRASES.items()
        for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()
    ]
    places = [p for p, _ in found]
    return (len(words), len(places), min(places, default=None), max(places, default=None),
            sorted({x for _, x in found}))


def cases():
    rng = random.Random(3)
    parts = ["GNU General Public License", "the", "Apache", "License,", "MIT license", "CC-BY", "cc by",
             "Licensed under the Apache License, Version 2.0", "mit LICENSE/mit license", "é", "\n", "# ",
             "GNU\n * General  Public License", "cc bye", "xmit license"]
    return TEXTS + [None, "mit license mit license", "CC BY"] + [
        " ".join(rng.choices(parts, k=rng.randrange(1, 12))) for _ in range(200)
    ]


def test_base_phrases_equal_brute_force(spark):
    docs = spark.createDataFrame(list(enumerate(cases())), "doc_id bigint, text string").selectExpr("*", "7 AS N_WORDS")
    for r in licenses.scan(docs).collect():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(r.text), r.text
        assert set(r.base_labels) <= set(r.labels)
        assert 0 <= r.score <= 1 and (r.score == 1) >= (r.n_base > 0)


def test_seeds_cover_a_notice():
    for notice in licenses.NOTICES:
        parts = licenses.seeds(notice)
        assert len(parts) == licenses.allowed(notice) + 1
        assert "".join(p for _, p in parts) == notice and all(p for _, p in parts)


def editable(notice):
    """Places of a notice outside its telling words and the blanks around them."""
    telling = [re.search(rf" ?\b{words}\b ?", notice).span() for words in licenses.TELLING.get(notice, ())]
    return [i for i in range(len(notice)) if not any(a <= i < b for a, b in telling)]


@pytest.mark.parametrize("seed", range(5))
def test_edited_notices_are_found_as_the_whole_text_search_finds_them(seed):
    rng = random.Random(seed)
    letters = "abcdefghijklmnopqrstuvwxyz "
    for notice, label in licenses.NOTICES.items():
        edited = list(notice)
        for at in rng.choices(editable(notice), k=licenses.allowed(notice)):
            edited[at] = rng.choice((edited[at] + letters[rng.randrange(27)], letters[rng.randrange(27)], ""))
        text = "some words before " + re.sub(" +", " ", "".join(edited)).strip() + " and after"
        body, starts = licenses.plain(text)
        found = [x for x in licenses.fuzzy(body, starts) if x[0] == label]
        whole = regex.search(f"(?b)(?:{regex.escape(notice)}){{e<={licenses.allowed(notice)}}}", body)
        assert bool(found) == bool(whole)
        if whole:
            assert min(x[3] for x in found) <= sum(whole.fuzzy_counts)


def test_edited_notices_side_by_side():
    for text, spans in {
        "all right reserved all rights reserved": [(0, 2, 1), (3, 5, 0)],
        "released undr the mit license released under the mit license": [(0, 4, 1), (5, 9, 0)],
        "all rights reserved all right reserved all rights reserved all rihts reserved":
            [(0, 2, 0), (3, 5, 1), (6, 8, 0), (9, 11, 1)],
        " ".join(["all rights reserved", "al rights reserved"] * 30):
            [(3 * k, 3 * k + 2, k % 2) for k in range(60)],
    }.items():
        found = licenses.fuzzy(*licenses.plain(text))
        assert [x[1:4] for x in found if x[0] in ("all-rights-reserved", "mit-notice")] == spans, text


@pytest.mark.parametrize("seed", range(5))
def test_no_match_is_left_beside_those_found(seed):
    rng = random.Random(seed)
    for notice, label in licenses.NOTICES.items():
        parts = []
        for _ in range(6):
            part = list(notice)
            for at in rng.choices(editable(notice), k=rng.randrange(0, licenses.allowed(notice) + 1)):
                part[at] = rng.choice("xyz")
            parts += ["".join(part), *rng.choices(["", "and", "some words"], k=1)]
        body, starts = licenses.plain(" ".join(parts))
        found = sorted(x[1:3] for x in licenses.fuzzy(body, starts) if x[0] == label)
        assert all(a[1] <= b[0] for a, b in zip(found, found[1:], strict=False))
        assert len(found) == 6, (body, found)


def test_no_label_without_its_telling_words():
    """A hand-made table of notices and the labels that each supports."""
    for text, want in {
        "licensed under cc by nc": {"cc-by-nc"},
        "Licensed under CC-BY-SA 4.0": {"cc-by-sa"},
        "licensed under cc by": set(),
        "released under the bsd license": set(),
        "Relased under the MIT licence.": {"mit-notice"},
        "released under the mitt license": set(),
        "Licensed under the Apache License, Version 1.1": set(),
        "Licensed under the Apache License, Version 2.0": {"apache-2.0"},
        "Licenced under the Apache Licence version 2.0": {"apache-2.0"},
        "licensed under the GNU Lesser General Public License": {"lgpl-notice"},
        "licensed under the GNU Affero General Public License": {"agpl-notice"},
        "licensed under the GNU General Public License": {"gpl-notice"},
        "licensed under the gnu generel public license": set(),
        "subject to the terms of the Mozila Public License": set(),
        "subject to the term of the Mozilla Public Licence": {"mpl-notice"},
        "released under the bsd license, released under the mit licens": {"mit-notice"},
        "all right reserved": {"all-rights-reserved"},
    }.items():
        found = {x[0] for x in licenses.fuzzy(*licenses.plain(text))}
        assert found == want, text


def test_spans_are_words():
    body, starts = licenses.plain("We say: Licenced under the Apache Licence, Version 2.0 (the text)")
    (label, first, last, errors, similarity), = [x for x in licenses.fuzzy(body, starts) if x[0] == "apache-2.0"]
    assert (first, last, errors) == (2, 9, 2) and similarity > 0.9
    assert licenses.fuzzy(*licenses.plain("nothing of that kind stands here at all")) == []


def test_plain_places():
    body, starts = licenses.plain("..Ab,c\n é ")
    assert [body[a:].split(" ")[0] for a in starts] == ["ab", "c", "é".encode().decode("latin-1")]
    assert licenses.plain("")[1].tolist() == [] and np.array_equal(licenses.plain("a")[1], [1])


def test_empty_table(spark):
    assert licenses.scan(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_long_texts_and_repeated_rows(spark):
    long = "Some words, all rights reserved. " * 65_000 + "MIT License"
    rows = [(1, long), (2, "w" * 100_000), (3, "cc by"), (3, "cc by"), (None, None)]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    found = {r.doc_id: r for r in got}
    assert len(got) == 5 and found[1].n_words == 5 * 65_000 + 2 and found[1].n_base == 1
    assert len([n for n in found[1].notices if n["label"] == "all-rights-reserved"]) == 65_000
    assert (found[2].n_words, found[2].labels, found[3].base_labels) == (1, [], ["cc-by"])
