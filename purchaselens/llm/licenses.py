"""License scans by fuzzy search for short notices.

A notice with at most k errors, cut into k + 1 seeds, holds one seed unchanged: that is the
pigeonhole. An Aho-Corasick automaton finds all seeds of all notices in one pass over a text; around
each, the regex library matches the whole notice with up to k errors (insertions, deletions,
substitutions) and gives the span and the errors.

Text is matched as its words, A-Z folded, with one blank between: line breaks, comment marks
and punctuation do not count as errors. Four base phrases are counted exactly besides.
"""

from __future__ import annotations

import re
from bisect import bisect, insort
from collections.abc import Callable
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from purchaselens.llm.common import map_texts

# The base phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Short notices as licenses word them, lower case, and the label of each.
NOTICES = {
    "licensed under the apache license version 2 0": "apache-2.0",
    "released under the mit license": "mit-notice",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit-text",
    "licensed under the gnu general public license": "gpl-notice",
    "this program is free software you can redistribute it and or modify": "gpl-text",
    "licensed under the gnu lesser general public license": "lgpl-notice",
    "licensed under the gnu affero general public license": "agpl-notice",
    "licensed under a creative commons attribution": "cc-by-text",
    "licensed under cc by nc": "cc-by-nc",
    "licensed under cc by sa": "cc-by-sa",
    "redistribution and use in source and binary forms with or without modification": "bsd-text",
    "subject to the terms of the mozilla public license": "mpl-notice",
    "all rights reserved": "all-rights-reserved",
}
# The words that tell a notice from others like it; no error is allowed in them.
TELLING = {
    "licensed under the apache license version 2 0": ("apache", "2 0"),
    "released under the mit license": ("mit",),
    "licensed under the gnu general public license": ("gnu general",),
    "licensed under the gnu lesser general public license": ("lesser",),
    "licensed under the gnu affero general public license": ("affero",),
    "licensed under a creative commons attribution": ("creative commons",),
    "licensed under cc by nc": ("nc",),
    "licensed under cc by sa": ("sa",),
    "subject to the terms of the mozilla public license": ("mozilla",),
}
#: One error is allowed for this many letters of a notice.
LETTERS_PER_ERROR = 10

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True

SPANS = T.ArrayType(T.StructType([
    T.StructField("label", T.StringType()), T.StructField("first_word", T.LongType()),
    T.StructField("last_word", T.LongType()), T.StructField("errors", T.IntegerType()),
    T.StructField("similarity", T.DoubleType()),
]))


def allowed(notice: str) -> int:
    return len(notice) // LETTERS_PER_ERROR


def seeds(notice: str) -> list[tuple[int, str]]:
    """allowed + 1 parts of near-equal length that cover the notice: (offset, part)."""
    n = allowed(notice) + 1
    cuts = [len(notice) * i // n for i in range(n + 1)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def plain(text: str) -> tuple[str, np.ndarray]:
    """The words of a text joined by blanks, a blank on either end, and where each starts.

    Letters beyond ASCII are kept as single Latin-1 characters, one per UTF-8 byte: none of the
    notices has any, so places and errors are counted alike for all.
    """
    data = _FOLD[np.frombuffer(text.encode(), np.uint8)]
    inside = _WORD[data]
    edge = np.diff(inside.astype(np.int8), prepend=0)
    starts = np.flatnonzero(edge == 1)
    # Keep the letters of words and one blank before each word.
    keep = inside.copy()
    blanks = starts[starts > 0] - 1
    keep[blanks] = True
    out = np.where(inside, data, 32)[keep]
    if len(starts) and starts[0] == 0:
        out = np.append(np.uint8(32), out)
    joined = np.append(out, np.uint8(32))
    return joined.tobytes().decode("latin-1"), np.flatnonzero(joined[:-1] == 32) + 1


@lru_cache(maxsize=1)
def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    entries: dict[str, list[tuple[str, int]]] = {}
    for notice in NOTICES:
        for offset, seed in seeds(notice):
            entries.setdefault(seed, []).append((notice, offset))
    for seed, places in entries.items():
        found.add_word(seed, (len(seed), places))
    found.make_automaton()
    return found


@lru_cache(maxsize=None)
def _pattern(notice: str):
    import regex

    return regex.compile(f"(?b)(?:{regex.escape(notice)}){{e<={allowed(notice)}}}")


def _windows(text: str) -> dict[str, set[tuple[int, int]]]:
    """Per notice the stretches of text in which a seed says it may stand."""
    found: dict[str, set[tuple[int, int]]] = {}
    for end, (size, places) in _automaton().iter(text):
        for notice, offset in places:
            k, start = allowed(notice), end + 1 - size - offset
            span = max(0, start - k), min(len(text), start + len(notice) + k)
            found.setdefault(notice, set()).add(span)
    return found


def tells(notice: str, text: str, start: int, end: int) -> bool:
    """Whether the telling words of a notice stand whole in a match, which may end within a word."""
    while start and text[start - 1] != " " and text[start] != " ":
        start -= 1
    while end < len(text) and text[end - 1] != " " and text[end] != " ":
        end += 1
    inside = f" {text[start:end].strip()} "
    return all(f" {words} " in inside for words in TELLING.get(notice, ()))


def _free(a: int, b: int, taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The parts of a stretch outside the taken spans, which are sorted and do not overlap."""
    out = []
    for k in range(max(0, bisect(taken, (a, a)) - 1), len(taken)):
        start, end = taken[k]
        if start >= b:
            break
        if a < start:
            out.append((a, start))
        a = max(a, end)
    return [*out, (a, b)] if a < b else out


def fuzzy(text: str, starts: np.ndarray) -> list[tuple[str, int, int, int, float]]:
    """(label, first word, last word, errors, similarity) of every notice found in plain text;
    matches of one notice do not overlap.

    The best match is taken first. A window that overlaps it is searched again in what is left
    of it, so that a weaker match beside a better one is found too. A match without the notice's telling
    words is none; the window is searched for others that begin later or end earlier.
    """
    out = []
    for notice, windows in _windows(text).items():
        least = len(notice) - allowed(notice)
        taken: list[tuple[int, int]] = []
        open_: list[tuple[int, int, int, int, int]] = []
        tried: set[tuple[int, int]] = set()

        def search(a: int, b: int) -> None:
            if (a, b) in tried:
                return
            tried.add((a, b))
            if b - a >= least and (m := _pattern(notice).search(text, a, b)):
                heappush(open_, (sum(m.fuzzy_counts), m.start(), m.end(), a, b))

        for a, b in windows:
            search(a, b)
        while open_:
            errors, start, end, a, b = heappop(open_)
            free = _free(a, b, taken)
            if not any(x <= start and end <= y for x, y in free):
                for x, y in free:
                    search(x, y)
                continue
            if not tells(notice, text, start, end):
                search(start + 1, b)
                search(a, end - 1)
                continue
            first = int(np.searchsorted(starts, start + (text[start] == " "), side="right")) - 1
            last = int(np.searchsorted(starts, end - 1, side="right")) - 1
            out.append((NOTICES[notice], max(first, 0), max(last, 0), errors, 1 - errors / len(notice)))
            insort(taken, (start, end))
            for x, y in _free(a, b, taken):
                search(x, y)
    return sorted(out)


def exact(text: str, starts: np.ndarray) -> list[tuple[int, str]]:
    """(first word, label) of every place of a base phrase in plain text."""
    out = []
    for phrase, label in PHRASES.items():
        if phrase in text:
            for m in re.finditer(f"(?= {phrase} )", text):
                out.append((int(np.searchsorted(starts, m.start() + 1)), label))
    return out


def scan(docs: DataFrame, *, text: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` plus n_words, n_base, first_word, last_word, base_labels, labels (sorted arrays),
    notices (label, first and last word, errors, similarity) and score.

    ``score`` is 1 with a base phrase, else the best similarity of a notice, else 0. NULL counts
    as the empty text: no words, no places, score 0. Every row is scanned whole and by itself.
    Columns of the input with the names of the new ones are replaced; an empty table gives an
    empty result.
    """

    def one(value: str | None) -> tuple:
        body, starts = plain(value or "")
        base, near = exact(body, starts), fuzzy(body, starts)
        places = [p for p, _ in base]
        base_labels = sorted({label for _, label in base})
        labels = sorted({*base_labels, *(n[0] for n in near)})
        best = 1.0 if base else max((n[4] for n in near), default=0.0)
        notices = [
            {"label": a, "first_word": b, "last_word": c, "errors": d, "similarity": e}
            for a, b, c, d, e in near
        ]
        return (
            len(starts), len(places), min(places, default=None), max(places, default=None),
            base_labels, labels, notices, best,
        )

    def make() -> Callable:
        return lambda texts: [list(c) for c in zip(*map(one, texts), strict=True)]

    long, strings = T.LongType(), T.ArrayType(T.StringType())
    kinds = {
        "n_words": long, "n_base": long, "first_word": long, "last_word": long,
        "base_labels": strings, "labels": strings, "notices": SPANS, "score": T.DoubleType(),
    }
    fields = [T.StructField(n, k) for n, k in kinds.items()]
    return map_texts(docs, text, fields, make, keep_text)
