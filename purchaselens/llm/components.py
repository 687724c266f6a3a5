"""Connected components by alternating large-star and small-star.

Both steps only move edges towards the smallest node known nearby; no node's neighbours are
ever gathered in one row or task: the smallest neighbour comes from a combined aggregate and reaches
the edges by a join that does not shuffle the edges of nodes with very many.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from purchaselens.llm.common import counted_join, stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over edges (u > v).

    Large-star: every neighbour of u above u is tied to the smallest of u and its neighbours.
    Small-star: every neighbour of u below u, and u, is tied to the smallest of them.
    """
    arcs = edges.union(edges.select("v", "u")) if large else edges
    arcs = arcs.toDF("node", "near")
    least = stored(
        arcs.groupBy("node").agg(F.least(F.col("node"), F.min("near")).alias("low"), F.count("*").alias("n")), "least"
    )
    joined = counted_join(arcs, least, "node")
    if large:
        moved = joined.where("near > node").select(F.col("near").alias("u"), F.col("low").alias("v"))
    else:
        moved = joined.select(F.col("near").alias("u"), F.col("low").alias("v")).union(
            least.select(F.col("node").alias("u"), F.col("low").alias("v"))
        )
    return moved.where("u <> v").distinct()


def _sum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(
        F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    ).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node that has an edge; a component is its smallest node.

    ``edges`` has two bigint columns; direction, repeats and loops do not matter, rows with a
    NULL are left out. Each round is written to the shared folder, which ends its lineage.
    """
    a, b = edges.columns
    now = stored(
        edges.where(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(),
        "edges",
    )
    before = None
    while (state := _sum(now)) != before:
        before = state
        now = stored(_star(_star(now, large=True), large=False), "edges")
    # Stars now: every node but the smallest points to it.
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
