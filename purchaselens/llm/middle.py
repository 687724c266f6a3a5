"""Fill-in-middle: texts cut in three and put together in another order.

Cuts are drawn in code points, texts are bytes. Of a column of UTF-8 texts only the characters of
more than one byte are recorded: where each starts and how many bytes it has beyond one. Between
two of them a code point is a byte, so a place is turned from one unit into the other by one binary
search among those exceptions and a subtraction; ASCII texts have none. All cuts of an Arrow batch are
turned at once, and texts are cut as bytes without being decoded.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from purchaselens.llm.common import without


@dataclass(frozen=True)
class Marks:
    """What stands before the three parts. None may be empty or begin inside another."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self):
        marks = (self.prefix, self.suffix, self.middle)
        for a in marks:
            for b in marks:
                if not a or any(b.startswith(a[k:]) for k in range(1, len(a))) or (a is not b and a in b):
                    raise ValueError(f"marks {marks} cannot be told apart in a text")

    @property
    def all(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle


class Exceptions:
    """Characters of more than one byte in a block of UTF-8, and places turned by means of them."""

    def __init__(self, data: np.ndarray):
        self.at_byte = np.flatnonzero(data >= 0xC0)
        lead = data[self.at_byte]
        excess = 1 + (lead >= 0xE0).astype(np.int64) + (lead >= 0xF0)
        self.total = np.concatenate([np.zeros(1, np.int64), np.cumsum(excess)])
        self.at_char = self.at_byte - self.total[:-1]

    def chars(self, places: np.ndarray) -> np.ndarray:
        """Code points before each byte place (the start of a character, or the end)."""
        return places - self.total[np.searchsorted(self.at_byte, places)]

    def bytes(self, places: np.ndarray) -> np.ndarray:
        """Bytes before each code point."""
        return places + self.total[np.searchsorted(self.at_char, places)]


def _draws(doc_id: str, seed: str) -> list[Column]:
    """Four unsigned 32-bit numbers of a row, from SHA-256 of ``seed:doc_id``."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("")))
    digest = F.sha2(text, 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("bigint") for k in range(4)]


FIELDS = [
    T.StructField("n", T.LongType()), T.StructField("form", T.StringType()),
    T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()),
    T.StructField("output", T.StringType()),
]


def transform(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", seed: str = "1",
    cut_percent: int = 90, spm_percent: int = 20, marks: Marks = Marks(), keep_text: bool = True,
) -> DataFrame:
    """``docs`` plus n (code points), form (``plain``, ``psm``, ``spm``), prefix_chars and
    middle_chars (NULL where plain) and output.

    Cuts and form depend on seed and doc_id alone, so repeated rows come out alike and a task that
    runs again gives the same. A text that is NULL, empty or holds a mark stays plain; its output is the
    text, empty for NULL. A NULL doc_id draws like an empty one. Any of the three parts may be empty.
    Columns of ``docs`` named like the new ones are replaced; an empty table gives an empty one.
    """
    base = without(docs, [f.name for f in FIELDS])
    drawn = [f"__draw_{k}" for k in range(4)]
    given = [f for f in base.schema if keep_text or f.name != text]
    sent = base.select("*", *[h.alias(n) for h, n in zip(_draws(doc_id, seed), drawn, strict=True)])
    raw_marks = [m.encode() for m in marks.all]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        kinds = [to_arrow_type(f.dataType) for f in FIELDS]
        for batch in batches:
            column = {n: batch.column(batch.schema.get_field_index(n)) for n in (text, *drawn)}
            draws = [column[n].to_numpy(zero_copy_only=False) for n in drawn]
            made = cut_batch(column[text], draws, raw_marks, cut_percent, spm_percent)
            arrays = [batch.column(batch.schema.get_field_index(f.name)) for f in given]
            arrays += [a.cast(k) for a, k in zip(made, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, [f.name for f in [*given, *FIELDS]])

    return sent.mapInArrow(work, T.StructType([*given, *FIELDS]))


def cut_batch(texts: pa.Array, draws: list[np.ndarray], marks: list[bytes], cut: int, spm: int) -> list[pa.Array]:
    """One array per field of FIELDS, for a batch of texts."""
    filled = texts.cast(pa.large_string()).fill_null("")
    ends = np.frombuffer(filled.buffers()[1], np.int64)[filled.offset : filled.offset + len(filled) + 1]
    body = filled.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body else np.zeros(0, np.uint8)
    index = Exceptions(data)
    starts = index.chars(ends)
    n = np.diff(starts)
    one, two = draws[0] % (n + 1), draws[1] % (n + 1)
    first, second = np.minimum(one, two), np.maximum(one, two)
    cut_1, cut_2 = index.bytes(starts[:-1] + first).tolist(), index.bytes(starts[:-1] + second).tolist()
    plain = (n == 0) | (draws[2] % 100 >= cut)
    spm_row = draws[3] % 100 < spm
    raw, at = data.tobytes(), ends.tolist()
    form, out = [], []
    p, s, m = marks
    for i in range(len(filled)):
        a, b, c, d = at[i], cut_1[i], cut_2[i], at[i + 1]
        if plain[i] or any(raw.find(mark, a, d) >= 0 for mark in marks):
            plain[i] = True
            form.append("plain")
            out.append(raw[a:d])
        elif spm_row[i]:
            form.append("spm")
            out.append(b"".join((s, raw[c:d], p, raw[a:b], m, raw[b:c])))
        else:
            form.append("psm")
            out.append(b"".join((p, raw[a:b], s, raw[c:d], m, raw[b:c])))
    return [
        pa.array(n), pa.array(form), pa.array(first, mask=plain), pa.array(second - first, mask=plain),
        pa.array(out, pa.large_binary()).cast(pa.large_string()),
    ]


def restore(
    made: DataFrame, *, output: str = "output", form: str = "form", into: str = "restored", marks: Marks = Marks(),
) -> DataFrame:
    """``made`` plus the text that each output was made of, from output and form alone.

    A NULL output gives NULL; a form other than the three stops the job.
    """
    parts = F.split(F.col(output), "|".join(re.escape(m) for m in marks.all), -1)
    part = [F.get(parts, F.lit(k)) for k in range(4)]
    text = (
        F.when(F.col(form) == "plain", F.col(output))
        .when(F.col(form) == "psm", F.concat(part[1], part[3], part[2]))
        .when(F.col(form) == "spm", F.concat(part[2], part[3], part[1]))
        .otherwise(F.raise_error(F.concat(F.lit("unknown form "), F.coalesce(F.col(form), F.lit("NULL")))))
    )
    return without(made, [into]).withColumn(into, text)
