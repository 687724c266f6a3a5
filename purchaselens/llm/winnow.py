"""Benchmark decontamination by winnowing.

Of every six consecutive 5-gram hashes the smallest is kept, on both sides. A span of ten equal
words holds the same six 5-grams, hence the same smallest one: each shared span of at least ten
words yields a common fingerprint. Joined fingerprints only say where to look; there the hit is
extended to the document's ten-word windows, which are compared as text with the benchmark's.

A benchmark item of fewer than ten words is one window of its own length, which winnowing
does not cover. Its fingerprint is its first gram of up to five words, looked for among all such
grams, and extended the same way.

Everything is built-in functions: no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from purchaselens.llm.common import ascii_lower, checked_join, stored

GRAM = 5
WINDOW_GRAMS = 6
WINDOW = GRAM + WINDOW_GRAMS - 1

#: Runs of these are words; the rest of ASCII separates.
_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words of a text in order; NULL has none."""
    parts = F.split(ascii_lower(F.coalesce(text, F.lit(""))), _SEPARATORS, -1)
    return F.filter(parts, lambda w: w != "")


def _hashes(words_: Column) -> Column:
    return F.transform(words_, lambda w: F.xxhash64(w))


def _places(n: Column) -> Column:
    """0 .. n-1; nothing if n is not positive."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _grams(hashes: Column, size: int) -> Column:
    """A hash of each run of ``size`` words, by the place of its first."""
    return F.transform(
        _places(F.size(hashes) - (size - 1)),
        lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(size)]),
    )


def _smallest(grams: Column) -> Column:
    """The smallest of WINDOW_GRAMS grams, by the place where the ten-word window starts."""
    return F.transform(
        _places(F.size(grams) - (WINDOW_GRAMS - 1)),
        lambda i: F.least(*[F.get(grams, i + k) for k in range(WINDOW_GRAMS)]),
    )


def _fingerprints(df: DataFrame, sizes: list[int]) -> DataFrame:
    """Add ``at_<size>``: for each window size the fingerprint of the window at each place."""
    df = df.withColumn("hashes", _hashes(F.col("words")))
    for g in sorted({min(z, GRAM) for z in sizes}):
        df = df.withColumn(f"grams_{g}", _grams(F.col("hashes"), g))
    for z in sizes:
        grams = F.col(f"grams_{min(z, GRAM)}")
        df = df.withColumn(f"at_{z}", _smallest(grams) if z == WINDOW else grams)
    return df


def _window_text(words_: Column, place: Column, size: int | Column) -> Column:
    return F.array_join(F.slice(words_, place + 1, size), " ")


def _hit_windows(size: int) -> Column:
    """The windows of a size whose fingerprint is among the marks: place, size and text."""
    at = F.col(f"at_{size}")

    def hit(mark: Column) -> Column:
        return F.array_contains(F.get("marks_by", mark.bitwiseAND(F.col("mask")).cast("int")), mark)

    places = F.filter(_places(F.size("words") - (size - 1)), lambda i: hit(F.get(at, i)))
    return F.transform(places, lambda i: F.struct(
        i.alias("place"), F.lit(size).alias("size"), _window_text(F.col("words"), i, size).alias("window")
    ))


def _by_last_bits(df: DataFrame) -> DataFrame:
    """Split ``marks`` by their last bits into about as many lists as the root of the words' number, so
    that looking up every place of a long text does not go through all of its marks."""
    bits = F.floor((F.log2(F.size("words") + 1) + 1) / 2).cast("int")
    df = df.withColumn("mask", F.call_function("shiftleft", F.lit(1).cast("bigint"), bits) - 1)
    parts = F.sequence(F.lit(0).cast("bigint"), F.col("mask"))
    return df.withColumn(
        "marks_by", F.transform(parts, lambda b: F.filter("marks", lambda m: m.bitwiseAND(F.col("mask")) == b))
    )


def benchmark_windows(benchmark: DataFrame, *, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(window, size, mark, items): each distinct window of the items, its fingerprint, and the
    ids of the items that hold it."""
    items = benchmark.select(F.col(item_id).cast("string").alias("item"), words(F.col(text)).alias("words"))
    items = items.withColumn("size", F.least(F.size("words"), F.lit(WINDOW))).where("size > 0")
    windows = items.select(
        "item", "size", "words",
        F.explode(_places(F.size("words") - F.col("size") + 1)).alias("place"),
    ).select(
        "size", "item", F.slice("words", F.col("place") + 1, F.col("size")).alias("words"),
    ).withColumn("hashes", _hashes(F.col("words")))
    mark = _smallest(_grams(F.col("hashes"), GRAM))[0]
    for g in range(1, GRAM):
        mark = F.when(F.col("size") == g, _grams(F.col("hashes"), g)[0]).otherwise(mark)
    mark = F.when(F.col("size").between(GRAM, WINDOW - 1), _grams(F.col("hashes"), GRAM)[0]).otherwise(mark)
    return windows.select("size", "item", mark.alias("mark"), F.array_join("words", " ").alias("window")).groupBy(
        "window", "size", "mark"
    ).agg(F.array_sort(F.collect_set("item")).alias("items"))


def document_key(doc_id: Column, text: Column) -> Column:
    """A document is told by its id and a hash of its text, so ids may repeat or be missing."""
    return F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("-")), F.hex(F.xxhash64(text)))


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", text: str = "text",
    item_id: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """(doc_id, key, n_words, n_hit, items, contaminated): one row per row of ``docs``.

    A word inside any occurrence of a benchmark window is hit; ``items`` are the ids, as
    strings, of the items whose windows occur. NULL and empty texts have no words and no hits;
    so have items. An item without an id makes hits but is not listed. Rows that repeat a
    document are answered one by one; NULL doc_ids too. Other columns are not read. An empty
    benchmark leaves every document clean, an empty table gives an empty result.
    """
    windows = stored(
        benchmark_windows(benchmark, item_id=item_id, text=item_text), "benchmark-windows"
    )
    sizes = sorted(r.size for r in windows.select("size").distinct().collect())
    own = docs.select(
        F.col(doc_id).alias("doc_id"), document_key(F.col(doc_id), F.col(text)).alias("key"),
        words(F.col(text)).alias("words"),
    )
    marks = _fingerprints(own, sizes)
    every = F.array_distinct(F.concat(F.array().cast("array<bigint>"), *[F.col(f"at_{z}") for z in sizes]))
    # One more row per document carries its word count through the join.
    rows = marks.select(
        "doc_id", "key",
        F.explode(F.concat(
            F.array(F.struct(F.xxhash64("key").alias("mark"), F.size("words").alias("n_words"))),
            F.transform(every, lambda m: F.struct(m.alias("mark"), F.lit(None).cast("int").alias("n_words"))),
        )).alias("r"),
    ).select("doc_id", "key", "r.mark", "r.n_words")
    known = windows.select("mark").distinct().withColumn("known", F.lit(True))
    seen = stored(
        checked_join(rows, known, "mark", "left").where("n_words IS NOT NULL OR known")
        .select("doc_id", "key", "mark", "n_words"),
        "fingerprint-hits",
    )
    hits = stored(
        seen.where("n_words IS NULL").groupBy("key").agg(F.collect_set("mark").alias("marks")), "hit-documents"
    )
    # The texts of documents with hits only, once each, extended at the hits.
    found = _by_last_bits(_fingerprints(checked_join(own.drop("doc_id"), hits, "key"), sizes))
    spans = [_hit_windows(z) for z in sizes]
    none = F.array().cast("array<struct<place: int, size: int, window: string>>")
    looked = found.select("key", F.explode(F.concat(none, *spans)).alias("s")).select("key", "s.*")
    matched = checked_join(looked, windows.select("window", "items"), "window")
    covered = F.aggregate(
        F.array_sort("spans"),
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda a, s: F.struct(
            F.greatest(a["end"], s["place"] + s["size"]).alias("end"),
            (a["n"] + F.greatest(F.lit(0), s["place"] + s["size"] - F.greatest(a["end"], s["place"]))).alias("n"),
        ),
    )["n"]
    per_document = (
        matched.groupBy("key").agg(
            F.collect_set(F.struct("place", "size")).alias("spans"), F.collect_set("items").alias("items")
        )
        .select("key", covered.cast("bigint").alias("n_hit"),
                F.array_sort(F.array_distinct(F.flatten("items"))).alias("items"))
    )
    return seen.where("n_words IS NOT NULL").join(per_document, "key", "left").select(
        "doc_id", "key", F.col("n_words").cast("bigint").alias("n_words"),
        F.coalesce("n_hit", F.lit(0).cast("bigint")).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, **names: str) -> DataFrame:
    """The rows of ``docs`` without any benchmark window, all columns as they were."""
    found = decontaminate(docs, benchmark, **names)
    bad = stored(found.where("contaminated").select(F.col("key").alias("__key")).distinct(), "contaminated")
    key = document_key(F.col(names.get("doc_id", "doc_id")), F.col(names.get("text", "text")))
    return checked_join(docs.withColumn("__key", key), bad, "__key", "left_anti").drop("__key")
