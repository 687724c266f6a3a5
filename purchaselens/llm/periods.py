"""Periodic runs of words, found by a dictionary of basic factors, and texts without the repeats.

A run is a stretch of consecutive words with smallest period q (words q apart are equal) that is at
least ``least`` words and ``times`` periods long and that no neighbouring word extends with that period.

The dictionary names, for every power of two, the factors of that many words: two places of a document
have one name if the factors there are equal. The names of one length are sorted pairs of names of
half the length, and a factor that a document has once is left out from then on. Per name, the next
occurrence within twice the length gives a distance; consecutive places at one distance are an
arithmetic progression of occurrences, and the distance is proposed as a period. With at least
``times`` >= 4 periods in a run, the length from q up to 2q shows at least q such places in
a row, so shorter rows are no proposal. Proposals are extended word by word both ways, equal stretches
kept once with their smallest period.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from purchaselens.llm.common import chunks, without

LEAST, TIMES = 6, 4

RUN = T.StructType([T.StructField(n, T.LongType(), False) for n in ("start", "length", "period")])
FIELDS = [
    T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(RUN, False)),
    T.StructField("collapsed", T.StringType()),
]


def proposals(names: np.ndarray) -> set[tuple[int, int]]:
    """(place, period) of progressions in a sequence of names that are the same only within a
    document; each lies in a stretch of equal names a period apart."""
    found: list[np.ndarray] = []
    places, length = np.arange(len(names)), 1
    while len(places):
        # Equal names stand together and in order of place: neighbours are successive occurrences.
        order = np.argsort(names, kind="stable")
        sorted_names, sorted_places = names[order], places[order]
        same = sorted_names[1:] == sorted_names[:-1]
        repeated = np.zeros(len(order), bool)
        repeated[1:] |= same
        repeated[:-1] |= same
        distance = np.zeros(len(order), np.int64)
        distance[order[:-1]] = np.where(same, sorted_places[1:] - sorted_places[:-1], 0)
        distance[distance > 2 * length] = 0
        # Rows of consecutive places at one distance, at least that distance long.
        breaks = np.flatnonzero((distance[1:] != distance[:-1]) | (places[1:] != places[:-1] + 1)) + 1
        firsts = np.concatenate([[0], breaks])
        sizes = np.diff(np.append(firsts, len(places)))
        good = (distance[firsts] > 0) & (sizes >= distance[firsts])
        found.append(np.stack([distance[firsts[good]], places[firsts[good]]], axis=1))
        # Factors of twice the length: pairs of repeated ones, the second ``length`` further on.
        alive = np.zeros(len(order), bool)
        alive[order] = repeated
        number = np.zeros(len(order), np.int64)
        number[order] = np.concatenate([[0], np.cumsum(~same)])
        places, names = places[alive], number[alive]
        partner = np.searchsorted(places, places + length)
        partner[partner == len(places)] = 0
        if len(places):
            paired = places[partner] == places + length
            names = names[paired] * (int(names.max()) + 1) + names[partner[paired]]
            places = places[paired]
        length *= 2
    return {(int(p), int(d)) for d, p in np.concatenate(found)} if found else set()


def _stretch(names: np.ndarray, place: int, period: int) -> tuple[int, int]:
    """The longest stretch around a place in which names a period apart are equal."""
    low, high = place, place
    step = 64
    while high + period < len(names):
        a = names[high : high + step]
        b = names[high + period : high + period + step]
        differ = np.flatnonzero(a[: len(b)] != b)
        if len(differ):
            high += int(differ[0])
            break
        high += len(b)
        step *= 2
    step = 64
    while low:
        from_ = max(0, low - step)
        differ = np.flatnonzero(names[from_:low] != names[from_ + period : low + period])
        if len(differ):
            low = from_ + int(differ[-1]) + 1
            break
        low = from_
        step *= 2
    return low, high + period


def find_runs(names: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start, then period."""
    if times < 4:
        raise ValueError("times must be 4 at least: shorter runs may show no progression")
    periods: dict[tuple[int, int], int] = {}
    reached: dict[int, int] = {}
    for place, period in sorted(proposals(names)):
        if place < reached.get(period, 0):
            continue  # inside a stretch of that period already found
        start, end = _stretch(names, place, period)
        # The next stretch of this period begins after the first pair of names that differ.
        reached[period] = end - period + 1
        if end - start >= max(least, times * period):
            periods[start, end] = min(period, periods.get((start, end), period))
    return sorted((start, end - start, period) for (start, end), period in periods.items())


def _find_all(texts: list[bytes], least: int, times: int) -> tuple[list[int], list[list[dict]], list[bytes]]:
    words_of = [t.split() for t in texts]  # on bytes: blank and \t to \r, nothing else
    sizes = [len(w) for w in words_of]
    ends = np.cumsum([0, *sizes])
    words = pa.array([w for words in words_of for w in words], pa.large_binary())
    codes = words.dictionary_encode().indices.to_numpy().astype(np.int64)
    document = np.repeat(np.arange(len(texts)), sizes)
    found = find_runs(document * (int(codes.max(initial=0)) + 1) + codes, least, times)
    runs: list[list[dict]] = [[] for _ in texts]
    repeats = np.zeros(len(codes) + 1, np.int32)
    for start, length, period in found:
        of = int(document[start])
        runs[of].append({"start": start - int(ends[of]), "length": length, "period": period})
        repeats[start + period] += 1
        repeats[start + length] -= 1
    kept = np.cumsum(repeats[:-1]) == 0
    collapsed = []
    for i, words in enumerate(words_of):
        if runs[i]:
            words = [w for w, k in zip(words, kept[ends[i] : ends[i + 1]].tolist(), strict=True) if k]
        collapsed.append(b" ".join(words))
    return sizes, runs, collapsed


def collapse(
    docs: DataFrame, *, text: str = "text", least: int = LEAST, times: int = TIMES, keep_text: bool = True,
) -> DataFrame:
    """``docs`` plus n_words, runs (array of start, length, period; by start, then period) and
    collapsed: the words that no run repeats, joined by one blank.

    Words are what blanks and the characters 9 to 13 separate. Of a run its first period stays, unless
    another run repeats it. A NULL or empty text has no words and no runs. Every row is taken whole
    and by itself: repeated rows come out alike. Columns of ``docs`` named like the new ones are
    replaced; an empty table gives an empty one.
    """
    base = without(docs, [f.name for f in FIELDS])
    given = [f for f in base.schema if keep_text or f.name != text]
    schema = T.StructType([*given, *FIELDS])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = pa.list_(pa.struct([pa.field(f.name, pa.int64(), False) for f in RUN]))
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            texts = [t or b"" for t in column.cast(pa.large_string()).cast(pa.large_binary()).to_pylist()]
            old = [batch.column(batch.schema.get_field_index(f.name)) for f in given]
            for start, end in chunks([len(t) for t in texts]):
                sizes, runs, collapsed = _find_all(texts[start:end], least, times)
                made = [
                    pa.array(sizes, pa.int64()), pa.array(runs, run),
                    pa.array(collapsed, pa.binary()).cast(pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(
                    [*[c.slice(start, end - start) for c in old], *made], [f.name for f in schema]
                )

    return base.mapInArrow(work, schema)
