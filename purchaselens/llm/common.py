"""What several operators share: stored intermediate tables, size-checked joins, text chunks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from purchaselens.plans.joins import lookup_join
from purchaselens.plans.scratch import scratch_path

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Characters of text that a Python function works on at a time; a longer text is one chunk.
CHUNK_CHARS = 1_000_000
#: Files or blocks whose totals the driver adds up, at most; beyond, each takes more rows.
MOST_BLOCKS = 100_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """The rows of ``df`` as a table in the shared folder: lineage ends there, and a lost
    executor costs a read, not a recomputation."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ascii_lower(text: Column) -> Column:
    """A-Z only; letters outside ASCII stay as they are."""
    return F.translate(text, UPPER, LOWER)


def counted_join(big: DataFrame, counted: DataFrame, on: str) -> DataFrame:
    """Inner join with a stored table that has each key once and in ``n`` the rows of ``big`` with that key.

    Rows of a key that holds over twice an even partition's share are not shuffled: there are fewer such
    keys than partitions, and their rows of ``counted`` are broadcast.
    """
    parts = int(big.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = counted.agg(F.sum("n").alias("n")).first()["n"] or 0
    hot = counted.where(F.col("n") > 2 * max(1, total // parts)).collect()
    if not hot:
        return big.join(counted, on)
    few = F.broadcast(big.sparkSession.createDataFrame(hot, counted.schema))
    rest = big.join(few, on, "left_anti").join(counted, on)
    return big.join(few, on).unionByName(rest)


def checked_join(big: DataFrame, small: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """``small`` has each key once. It is broadcast if its measured bytes allow; else both
    sides are shuffled, but for the rows of hot keys."""
    return lookup_join(big, small, [on], how)


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """Leave out columns that an operator is about to add (names compare as Spark does)."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def chunks(sizes: list[int], most: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """(start, end) of runs of texts, given by size, that are worked on together."""
    start = total = 0
    for i, size in enumerate(sizes):
        if total and total + size > most:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


def map_texts(
    docs: DataFrame,
    text: str,
    fields: list[T.StructField],
    make: Callable[[], Callable[[list[str | None]], list[list]]],
    keep_text: bool = True,
    most: int = CHUNK_CHARS,
) -> DataFrame:
    """Add columns worked out from a text column in Python, Arrow batch by Arrow batch.

    ``make`` runs once per task and returns a function from texts to one list per field; it gets
    texts of ``most`` bytes at a time, or one that is longer.
    Columns of ``docs`` with the names of the new ones are replaced. ``keep_text=False``
    leaves the text out of what comes back from Python.
    """
    base = without(docs, [f.name for f in fields])
    given = [f for f in base.schema if keep_text or f.name != text]
    schema = T.StructType([*given, *fields])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        kinds = [to_arrow_type(f.dataType) for f in fields]
        function = make()
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            # Texts become Python strings chunk by chunk, not all of a batch at once.
            sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
            for start, end in chunks(sizes, most):
                made = function(column.slice(start, end - start).to_pylist())
                old = [batch.column(batch.schema.get_field_index(f.name)) for f in given]
                arrays = [c.slice(start, end - start) for c in old]
                arrays += [pa.array(v, k) for v, k in zip(made, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, [f.name for f in schema])

    return base.mapInArrow(work, schema)
