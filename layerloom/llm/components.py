"""Connected components of an edge table by alternating large-star and small-star steps.

Each step groups edges by node, finds the least neighbour by a partial aggregation and joins it back, so a hub is an
equi-join skew that adaptive execution splits, never a collected list. The number of rounds is logarithmic in the
nodes. Every round is written to the shared folder, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from layerloom.llm.common import release, stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Edges (u, v) with u > v. Large: each node's greater neighbours go to its least; small: the lesser ones and itself."""
    both = edges.select(F.col("u").alias("n"), F.col("v").alias("x"))
    if large:
        both = both.unionByName(edges.select(F.col("v").alias("n"), F.col("u").alias("x")))
    least = both.groupBy("n").agg(F.least(F.min("x"), F.col("n")).alias("m"))
    joined = both.join(least, "n")
    if large:
        out = joined.where("x > n").select(F.col("x").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("x").alias("u"), F.col("m").alias("v")).unionByName(least.select(F.col("n").alias("u"), F.col("m").alias("v")))
    return out.where("u != v").distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component): for every node of edges (u, v) the least node that can be reached. Direction, loops and repeats do not matter."""
    least, most = F.least("u", "v"), F.greatest("u", "v")
    now = stored(edges.where("u != v").select(most.alias("u"), least.alias("v")).distinct(), "edges")
    mark = _mark(now)
    for _ in range(max_rounds):
        if not mark[0]:
            break
        large = stored(_star(now, True), "edges")
        nxt = stored(_star(large, False), "edges")
        release(large)
        release(now)
        now, before = nxt, mark
        mark = _mark(now)
        if mark == before:
            break
    else:
        raise RuntimeError("components did not settle")
    # every edge is now (node, least node of its component)
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").cast("decimal(20,0)"))).first())
