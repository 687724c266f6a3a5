"""Document fingerprints as invertible Bloom lookup tables.

A text is the set of the 64-bit digests of its paragraphs (a line, cut further at sentence
ends). A table has three parts; a digest goes into one cell of each. A cell keeps how many
digests it took, their XOR and the XOR of a check hash of each. Tables subtract cell by cell, and
what two texts share cancels. A cell left with one digest gives it away; taking that out of its two
other cells lays open the next: peeling recovers the digests that differ, by side.

Two texts are compared by tables as large as the texts: the digests are split by their first bits
into groups of about four, each a table of 12 cells. A group that does not peel to nothing is retried
with tables of 24, 48 and 96 cells, whose places use other bits of the digest; should all fail
(two digests that meet in every cell of every table: about 1e-11 a pair), its digests are compared
directly. The fingerprint is the smallest table, of a whole text.

Everything is built-in functions: no Python runs on the executors.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from purchaselens.llm.common import MOST_BLOCKS, checked_join, stored

PARTS = 3
#: Cells of a part are 2 ** bits; each size reads its own bits of a digest, from (first) on.
SIZES = ((2, 0), (3, 6), (4, 15), (5, 27))
#: Digests, of both texts together, that a group has on average at most.
GROUP = 4
_GROUP_BITS, _GROUP_FROM = 20, 44
ROUNDS = 10
#: Rows of ids that one task orders.
BLOCK_ROWS = 50_000

_NONE = "array<bigint>"


def digests(text: Column) -> Column:
    """Distinct digests of the paragraphs that are not empty."""
    parts = F.split(F.coalesce(text, F.lit("")), r"\n+|(?<=[.!?])\s+", -1)
    return F.array_distinct(F.transform(F.filter(parts, lambda p: p != ""), lambda p: F.xxhash64(p)))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _xor(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("bigint"), lambda a, v: a.bitwiseXOR(v))


def _check(key: Column) -> Column:
    return F.xxhash64(F.lit(9), key)


def _cell(left: Column, right: Column, cell: Column, size: tuple[int, int], start: Column | None = None) -> Column:
    """struct(n, key, check) of one cell: ``start`` (or nothing) plus the digests of ``left``
    whose place it is, less those of ``right``."""
    bits, first = size
    mask = F.lit((1 << bits) - 1).cast("bigint")

    def folded(shift: Column, place: Column) -> Column:
        def put(sign: int) -> Callable[[Column, Column], Column]:
            return lambda a, k: F.when(
                F.call_function("shiftrightunsigned", k, shift).bitwiseAND(mask) == place,
                F.struct(
                    (a["n"] + sign).alias("n"), a["key"].bitwiseXOR(k).alias("key"),
                    a["check"].bitwiseXOR(_check(k)).alias("check"),
                ),
            ).otherwise(a)

        nothing = F.struct(
            F.lit(0).alias("n"), F.lit(0).cast("bigint").alias("key"), F.lit(0).cast("bigint").alias("check")
        )
        return F.aggregate(right, F.aggregate(left, nothing if start is None else start, put(1)), put(-1))

    # The cell's part says which bits of a digest count, its place in the part what they must be.
    return _let(
        F.shiftright(cell, bits) * bits + first, lambda shift: _let(cell.bitwiseAND(mask), lambda place: folded(shift, place))
    )


def table(left: Column, right: Column, size: tuple[int, int]) -> Column:
    """The table of ``left`` less the table of ``right``."""
    cells = F.sequence(F.lit(0), F.lit((PARTS << size[0]) - 1))
    return F.transform(cells, lambda i: _cell(left, right, i, size))


def _empty(cell: Column) -> Column:
    return (cell["n"] == 0) & (cell["key"] == 0) & (cell["check"] == 0)


def _peel(cells: Column, size: tuple[int, int]) -> Column:
    """struct(cells, left, right, open, whole): what is left of a table, the digests recovered, and
    whether they are all of it."""
    nothing = F.array().cast(_NONE)

    def is_all(state: Column, left: Column, right: Column) -> Column:
        """Whether these digests add up to what the cells of one part hold together."""
        part = F.slice(state["cells"], 1, 1 << size[0])
        return _let(F.concat(left, right), lambda both: (
            (F.aggregate(part, F.lit(0), lambda n, c: n + c["n"]) == F.size(left) - F.size(right))
            & (_xor(F.transform(part, lambda c: c["key"])) == _xor(both))
            & (_xor(F.transform(part, lambda c: c["check"])) == _xor(F.transform(both, _check)))
        ))

    def state_of(cells_: Column, left: Column, right: Column, open_: Column, whole: Column) -> Column:
        return F.struct(
            cells_.alias("cells"), left.alias("left"), right.alias("right"), open_.alias("open"), whole.alias("whole")
        )

    def take(state: Column, left: Column, right: Column) -> Column:
        """Take the digests out of their other cells, unless they are the last."""
        more = F.concat(state["left"], left), F.concat(state["right"], right)
        # What was on the left is taken away, so the sides change places.
        rest = F.transform(state["cells"], lambda c, i: _cell(right, left, i, size, c))
        return F.when(
            is_all(state, left, right), state_of(state["cells"], *more, F.lit(False), F.lit(True))
        ).otherwise(state_of(rest, *more, F.lit(True), F.lit(False)))

    def turn(state: Column, _: Column) -> Column:
        lone = F.filter(state["cells"], lambda c: (F.abs(c["n"]) == 1) & (c["check"] == _check(c["key"])))

        def side(found: Column, n: int) -> Column:
            return F.array_distinct(F.transform(F.filter(found, lambda c: c["n"] == n), lambda c: c["key"]))

        closed = state_of(state["cells"], state["left"], state["right"], F.lit(False), F.forall(state["cells"], _empty))
        return F.when(~state["open"], state).otherwise(_let(lone, lambda found: F.when(
            F.size(found) == 0, closed
        ).otherwise(_let(side(found, 1), lambda a: _let(side(found, -1), lambda b: take(state, a, b))))))

    start = state_of(cells, nothing, nothing, F.lit(True), F.lit(False))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn)


def fingerprint(keys: Column) -> Column:
    """The smallest table of a text as a string: count:digests:checks of each cell."""
    return F.array_join(
        F.transform(
            table(keys, F.array().cast(_NONE), SIZES[0]),
            lambda c: F.concat_ws(":", c["n"].cast("string"), F.hex(c["key"]), F.hex(c["check"])),
        ),
        ",",
    )


def _groups(df: DataFrame, left: str, right: str) -> DataFrame:
    """Add ``__groups``: both sides split by as many bits of the digests as make about GROUP a
    group; first coarsely, then each part again, so that a text of n digests costs n to the
    power 1.5 and not its square. What all digests share is worked out once, in columns."""
    nothing = F.array().cast(_NONE)
    wide = F.greatest(F.lit(1), F.ceil((F.size(left) + F.size(right)) / GROUP))
    df = df.withColumn("__bits", F.least(F.lit(_GROUP_BITS), F.ceil(F.log2(wide)).cast("int")))
    df = df.withColumn("__coarse", F.floor((F.col("__bits") + 1) / 2).cast("int"))

    def mask(bits: Column) -> Column:
        return F.call_function("shiftleft", F.lit(1).cast("bigint"), bits) - 1

    df = df.withColumns({
        "__mask_1": mask(F.col("__coarse")), "__mask_2": mask(F.col("__bits") - F.col("__coarse")),
        "__shift_2": F.col("__coarse") + _GROUP_FROM,
    })

    def of(keys: Column, shift: Column, mask_: Column, value: Column) -> Column:
        return F.filter(
            keys, lambda k: F.call_function("shiftrightunsigned", k, shift).bitwiseAND(mask_) == value
        )

    def split(a: Column, b: Column, shift: Column, mask_: Column, made: Callable[[Column, Column], Column]) -> Column:
        return F.transform(
            F.sequence(F.lit(0).cast("bigint"), mask_), lambda v: made(of(a, shift, mask_, v), of(b, shift, mask_, v))
        )

    df = df.withColumn("__parts", split(
        F.col(left), F.col(right), F.lit(_GROUP_FROM), F.col("__mask_1"),
        lambda a, b: F.struct(a.alias("left"), b.alias("right")),
    ))
    return df.withColumn("__groups", F.flatten(F.transform("__parts", lambda p: split(
        p["left"], p["right"], F.col("__shift_2"), F.col("__mask_2"),
        lambda a, b: F.struct(
            a.alias("left"), b.alias("right"), nothing.alias("left_only"), nothing.alias("right_only"),
            F.lit(0).alias("tries"),
        ),
    )))).drop("__bits", "__coarse", "__mask_1", "__mask_2", "__shift_2", "__parts")


def differences(df: DataFrame, left: str, right: str, name: str = "difference") -> DataFrame:
    """Add ``name``: struct(left_only, right_only, tries) of two digest arrays of a row.

    Everything happens in the row: nothing is shuffled and no digest of another row is near it.
    ``tries`` is the number of table sizes that the hardest group took, 0 for two empty sides.
    """
    df = _groups(df, left, right)
    for k, size in enumerate(SIZES):

        def retried(g: Column, k: int, size: tuple[int, int]) -> Column:
            def judged(s: Column) -> Column:
                return F.struct(
                    g["left"].alias("left"), g["right"].alias("right"), s["left"].alias("left_only"),
                    s["right"].alias("right_only"), F.when(s["whole"], k + 1).otherwise(0).alias("tries"),
                )

            return F.when((g["tries"] > 0) | (F.size(g["left"]) + F.size(g["right"]) == 0), g).otherwise(
                _let(_peel(table(g["left"], g["right"], size), size), judged)
            )

        def step(k: int, size: tuple[int, int]) -> Callable[[Column], Column]:
            return lambda g: retried(g, k, size)

        df = df.withColumn("__groups", F.transform("__groups", step(k, size)))
    direct = F.transform("__groups", lambda g: F.when(
        (g["tries"] > 0) | (F.size(g["left"]) + F.size(g["right"]) == 0), g
    ).otherwise(F.struct(
        g["left"].alias("left"), g["right"].alias("right"),
        F.array_except(g["left"], g["right"]).alias("left_only"),
        F.array_except(g["right"], g["left"]).alias("right_only"), F.lit(len(SIZES) + 1).alias("tries"),
    )))
    df = df.withColumn("__groups", direct)
    return df.withColumn(name, F.struct(
        F.flatten(F.transform("__groups", lambda g: g["left_only"])).alias("left_only"),
        F.flatten(F.transform("__groups", lambda g: g["right_only"])).alias("right_only"),
        F.coalesce(F.array_max(F.transform("__groups", lambda g: g["tries"])), F.lit(0)).alias("tries"),
    )).drop("__groups")


def _following(ids: DataFrame) -> DataFrame:
    """(key, next_key, n_chars) of distinct documents by descending doc_id; the last is followed
    by the first. Ids are ordered in ranges, and a range's last finds the next range's first."""
    count = ids.count()
    parts = max(1, min(MOST_BLOCKS, -(-count // BLOCK_ROWS)))
    order = [F.col("doc_id").desc_nulls_last(), F.col("key")]
    ranged = stored(
        ids.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "ordered-ids"
    )
    within = Window.partitionBy("part").orderBy(*order)
    led = ranged.withColumn("next_key", F.lead("key").over(within)).withColumn(
        "place", F.row_number().over(within)
    )
    firsts = [(r.part, r.key) for r in led.where("place = 1").select("part", "key").orderBy("part").collect()]
    turn = [(p, firsts[(i + 1) % len(firsts)][1]) for i, (p, _) in enumerate(firsts)]
    table_ = ids.sparkSession.createDataFrame(turn, "part int, first_key string")
    return led.join(F.broadcast(table_), "part").select(
        "key", F.coalesce("next_key", "first_key").alias("next_key"), "n_chars"
    )


def edited_pairs(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every document and of its edited text, and how near they are.

    The edited text has its last third (in code points, rounded down) replaced by as much from the
    start of the next document by descending doc_id; the first follows the last, and NULL ids
    come last. Result: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next: shared digests over all digests, 1 for two texts without any.

    NULL counts as empty. Rows that repeat a doc_id are told apart by their text; rows that repeat
    both are one document to the order, and each gets its answer. Other columns are not
    read. An empty table gives an empty result.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    own = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.concat_ws(":", F.coalesce(F.col(doc_id).cast("string"), F.lit("-")), F.hex(F.xxhash64(body))).alias("key"),
        body.alias("text"),
    )
    rows = stored(own.select("doc_id", "key", F.length("text").cast("bigint").alias("n_chars")), "document-ids")
    ids = rows.groupBy("doc_id", "key", "n_chars").count()
    if rows.isEmpty():
        follow = rows.select("key", F.col("key").alias("next_key"), "n_chars")
    else:
        follow = stored(_following(ids.drop("count")), "following")
    if not ids.where("count > 1").isEmpty():
        own = own.dropDuplicates(["key"])
    # What a document gives to the one before it: as many of its first code points as that one
    # loses, and its digests.
    asked = follow.select(
        F.col("next_key").alias("key"), F.col("key").alias("asker"),
        F.floor(F.col("n_chars") / 3).cast("int").alias("wanted"),
    )
    given = checked_join(own.select("key", "text"), asked, "key").select(
        F.col("asker").alias("key"), F.substring("text", F.lit(1), F.col("wanted")).alias("head"),
        digests(F.col("text")).alias("next"),
    )
    n = F.length("text")
    texts = own.select("key", "text").join(given, "key").select(
        "key", "text", F.concat(F.substring("text", F.lit(1), (n - F.floor(n / 3)).cast("int")), "head").alias("edited"), "next"
    )
    sets = texts.select(
        "key", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        digests(F.col("text")).alias("own"), digests(F.col("edited")).alias("edited"), "next",
    )
    apart = differences(differences(sets, "own", "edited", "to_edited"), "own", "next", "to_next")

    def near(other: str) -> Column:
        all_ = F.size("own") + F.size(f"{other}.right_only")
        return F.when(all_ == 0, 1.0).otherwise((F.size("own") - F.size(f"{other}.left_only")) / all_)

    result = apart.select(
        "key", "edited_sha256", fingerprint(F.col("own")).alias("fingerprint"),
        fingerprint(F.col("edited")).alias("edited_fingerprint"),
        near("to_edited").alias("near_edited"), near("to_next").alias("near_next"),
    )
    return rows.join(result, "key").drop("key")
