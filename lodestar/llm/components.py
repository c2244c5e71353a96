"""Connected components of a graph of any size by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.session import cut


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step on edges (u, v): every node ties its larger (or smaller) neighbours to its least neighbour.

    The least neighbour is found by aggregation with partial sums on the map side and joined back, so a hub is never
    collected into one task.
    """
    if large:
        near = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    tied = near.join(least, "u")
    if large:
        out = tied.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = tied.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame, a: str, b: str, most: int = 60) -> DataFrame:
    """(node, component): the least node of each node's component, for all nodes that occur in an edge.

    Lineage is cut every round; rounds go on until the edges no longer change (about log of the longest path).
    """
    now = cut(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v").distinct())
    mark = None
    for _ in range(most):
        row = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"), F.sum(F.col("v").cast("decimal(38,0)")).alias("s")).first()
        if (row.n, row.x, row.s) == mark:
            break
        mark = (row.n, row.x, row.s)
        now = cut(_star(_star(now, True), False))
    else:
        raise RuntimeError(f"components did not settle in {most} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component"))
    ).distinct()
