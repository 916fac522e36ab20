"""Connected components of a graph given as an edge table, by star contraction.

Large and small stars in turn hang every node on the smallest node it can see, until
nothing moves. A step keeps one aggregate per node and never gathers a node's
neighbours; each round is written to the shared folder, so lineage stays short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written

#: The rounds needed grow with the logarithm of the longest path.
MAX_ROUNDS = 60


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One contraction. ``edges`` has ``u > v`` (small star) or both directions (large)."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    joined = edges.join(least, "u")
    if large:  # no more rows than edges; what repeats goes with the small star
        return joined.where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
    out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
        least.select("u", F.col("m").alias("v"))
    )
    return out.where("u != v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``edges(a, b)``; the component is its least node."""
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct()
    down = written(down, "edges")
    before = None
    if down.isEmpty():
        return down.select(F.col("u").alias("node"), F.col("v").alias("component"))
    for _ in range(MAX_ROUNDS):
        both = down.unionByName(down.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # in one execution both sides of the small star's join would make the large one
        large = written(_star(both, large=True), "edges")
        discard(down)
        down = written(_star(large, large=False), "edges")
        discard(large)
        # a graph of stars is a fixed point: no centre hangs on another node
        state = down.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if (state["n"], state["x"]) == before:
            break
        before = (state["n"], state["x"])
    else:
        raise RuntimeError("components did not settle")
    centres = down.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    return down.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(centres)
