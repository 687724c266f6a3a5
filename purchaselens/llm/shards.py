"""Sharding by histogram sort.

Rows are ordered by a 128-bit key (hash of the text, hash of the row); shards are ranges of
that order with near-equal bytes. The boundaries come from counting: each pass adds up the exact
bytes below a set of probe keys, map-side in every partition, and the next probes lie between the
two that enclose each wanted total. Only when the splitters stand are rows exchanged, once.

Equal texts have equal first key halves. As long as a boundary between two different texts lies
within the tolerance, equal texts share a shard; a group too large for that is cut inside.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from purchaselens.llm.common import MOST_BLOCKS, stored, without

#: A splitter may leave the ideal total by this share of a shard's bytes.
TOLERANCE = 0.005
#: Probe keys per splitter and pass.
PROBES = 16
#: So many rows between two probes are fetched by key.
FEW = 256
#: Rows that one task numbers.
BLOCK_ROWS = 200_000

_LOW, _HIGH = -(2**63), 2**63 - 1
_K1, _K2 = "__key", "__key_in_group"


def _byte_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + 1


def _between(low: int, high: int) -> list[int]:
    """Up to PROBES keys in (low, high), evenly spaced."""
    gap = high - low
    return sorted({low + gap * i // (PROBES + 1) for i in range(1, PROBES + 1)} - {low, high})


def _below(rows: DataFrame, key: str, probes: list[int]) -> dict[int, tuple[int, int]]:
    """Exact bytes and number of the rows with a key up to each probe: one pass, one row per
    partition."""
    inside = [F.col(key) <= F.lit(p) for p in probes]
    row = rows.agg(
        *[F.coalesce(F.sum(F.when(c, F.col("size"))), F.lit(0)) for c in inside],
        *[F.count_if(c) for c in inside],
    ).first()
    return {p: (row[i], row[len(probes) + i]) for i, p in enumerate(probes)}


def _search(
    rows: DataFrame, key: str, goals: dict[int, tuple[int, int]], total: tuple[int, int]
) -> tuple[dict[int, int], dict[int, tuple[int, int, int, int]]]:
    """For each goal (wanted bytes, slack): a key whose bytes-below is within the slack, or the
    enclosing (low, bytes to low, high, bytes to high) where only ``high`` has rows in between.

    An interval of FEW rows or less is not probed any further: its keys are fetched."""
    open_ = {g: (_LOW - 1, (0, 0), _HIGH, total) for g in goals}
    found: dict[int, int] = {}
    stuck: dict[int, tuple[int, int, int, int]] = {}
    few: dict[int, tuple[int, tuple[int, int], int, tuple[int, int]]] = {}
    while open_:
        for g, (low, below, high, upto) in list(open_.items()):
            if upto[1] - below[1] <= FEW:
                few[g] = open_.pop(g)
            elif high - low == 1:
                stuck[g] = (low, below[0], high, upto[0])
                del open_[g]
        probes = sorted({p for low, _, high, _ in open_.values() for p in _between(low, high)})
        counted = _below(rows, key, probes) if probes else {}
        for g, (low, below, high, upto) in list(open_.items()):
            wanted, slack = goals[g]
            for p in _between(low, high):
                if counted[p][0] <= wanted and p > low:
                    low, below = p, counted[p]
                elif counted[p][0] > wanted and p < high:
                    high, upto = p, counted[p]
            open_[g] = (low, below, high, upto)
            near, left = min(((low, wanted - below[0]), (high, upto[0] - wanted)), key=lambda x: x[1])
            if left <= slack:
                found[g] = near
                del open_[g]
    if few:
        spans = [F.col(key).between(F.lit(max(low + 1, _LOW)), F.lit(high)) for low, _, high, _ in few.values()]
        near = rows.where(reduce(lambda a, b: a | b, spans)).groupBy(key).agg(F.sum("size").alias("size"))
        keys = sorted(near.collect())
        for g, (low, (below, _), high, _) in few.items():
            wanted, slack = goals[g]
            last, upto, beyond = low, below, None
            for k, size in ((k, n) for k, n in keys if low < k <= high):
                if upto + size > wanted:
                    beyond = (k, upto + size)
                    break
                last, upto = k, upto + size
            ends = [(last, wanted - upto)] + ([(beyond[0], beyond[1] - wanted)] if beyond else [])
            best = min(ends, key=lambda x: x[1])
            if best[1] <= slack or beyond is None:
                found[g] = best[0]
            else:
                stuck[g] = (last, upto, *beyond)
    return found, stuck


def _after(key: str, end: int) -> Column:
    """Rows beyond a key; ``end`` may lie before every key."""
    return F.lit(True) if end < _LOW else F.col(key) > F.lit(end)


def shard(
    docs: DataFrame, n_shards: int = 8, *, text: str = "text", tolerance: float = TOLERANCE,
) -> DataFrame:
    """``docs`` plus size, text_crc32, shard (0 .. n_shards-1) and slot (gapless from 0 in each
    shard).

    Size is the UTF-8 bytes of the text plus 1; a NULL text counts as empty. Every row is put
    into exactly one shard, repeated rows included; an empty table gives an empty result.
    Columns of the input with the names of the new ones are replaced. Boundaries are within
    ``tolerance`` of a shard's bytes, or as near as whole rows allow.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    base = without(docs, ["size", "text_crc32", "shard", "slot"])
    others = [F.col(f"`{c}`").cast("string") for c, kind in base.dtypes if c != text and kind in
              ("bigint", "int", "string", "double", "boolean")]
    keyed = base.select(
        "*",
        _byte_size(F.col(text)).alias("size"),
        F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"),
        F.xxhash64(body).alias(_K1),
        F.xxhash64(F.lit(1), *others, body).alias(_K2),
    )
    sizes = stored(keyed.select("size", _K1, _K2), "shard-keys")
    total, count = sizes.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    goals = {
        s: (total * s // n_shards, int(tolerance * total / n_shards)) for s in range(1, n_shards)
    }
    found, stuck = _search(sizes, _K1, goals, (total, count))
    # (key, key in group) of each splitter: rows up to it belong to the shards before.
    splitters = {s: (k, _HIGH) for s, k in found.items()}
    for s, (low, below, high, upto) in stuck.items():
        group = sizes.where(F.col(_K1) == F.lit(high))
        wanted, slack = goals[s][0] - below, goals[s][1]
        inside, tie = _search(group, _K2, {s: (wanted, slack)}, (upto - below, group.count()))
        if s in inside:
            splitters[s] = (high, inside[s])
        else:  # one row, or repeated rows, left: the nearer end
            a, under, b, over = tie[s]
            splitters[s] = (high, a if wanted - under <= over - wanted else b)
    beyond = [
        _after(_K1, k) | ((F.col(_K1) == F.lit(max(k, _LOW))) & _after(_K2, inner))
        for k, inner in splitters.values()
    ]
    shard_of = reduce(lambda n, c: n + F.when(c, 1).otherwise(0), beyond, F.lit(0))
    # Slots: each shard is numbered in blocks that any number of tasks can take; the blocks'
    # counts, a row each, give the offsets.
    blocks = max(1, -(-count // (BLOCK_ROWS * n_shards)), min(64, count // (1000 * n_shards)))
    blocks = min(blocks, max(1, MOST_BLOCKS // n_shards))
    block = F.pmod(F.xxhash64(F.lit(2), _K1, _K2), F.lit(blocks)).cast("int")
    counted = {
        (r.shard, r.block): r.n
        for r in sizes.groupBy(shard_of.alias("shard"), block.alias("block"))
        .agg(F.count("*").alias("n")).collect()
    }
    offsets, rows = [], 0
    for s in range(n_shards):
        rows = 0
        for b in range(blocks):
            offsets.append((s, b, rows))
            rows += counted.get((s, b), 0)
    table = docs.sparkSession.createDataFrame(offsets, "shard int, __block int, __first bigint")
    placed = keyed.withColumns({"shard": shard_of.cast("int"), "__block": block})
    from pyspark.sql import Window

    order = Window.partitionBy("shard", "__block").orderBy(_K1, _K2)
    numbered = placed.withColumn("__n", F.row_number().over(order)).join(
        F.broadcast(table), ["shard", "__block"]
    )
    kept = [F.col(f"`{c}`") for c in keyed.columns if c not in (_K1, _K2)]
    return numbered.select(
        *kept, "shard", (F.col("__first") + F.col("__n") - 1).alias("slot")
    )
