"""Fixed points of a substitution table by pointer jumping.

A table maps a character to a text whose characters may be mapped again. Each turn replaces the characters of
every target by their own current targets, so what a row has followed doubles in each turn and a chain of depth d
takes the logarithm of d in joins. Rows are spread over tasks by character; no task sees the whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.codec import chars
from ..intermediate import written


def resolve(table: DataFrame, source: str = "source", target: str = "target") -> DataFrame:
    """``source, target, depth, expansion``: each source's text at the fixed point, how many steps it is away and how many characters it has.

    A source that maps to itself has depth 0. Of several rows of one source the least target counts; null sources
    and targets are left out; an empty target drops the character. A cycle has no fixed point and raises.
    """
    rows = table.where(F.col(source).isNotNull() & F.col(target).isNotNull()).groupBy(F.col(source).alias("source")).agg(F.min(target).alias("target"))
    state = written(rows.withColumn("depth", F.when(F.col("source") == F.col("target"), 0).otherwise(1).cast("long")), "chains")
    moving = state.where("depth > 0").count()
    turns = moving.bit_length() + 1  # a chain is no longer than there are sources
    while moving:
        if not turns:
            raise ValueError("the table has a cycle")
        each = state.where("depth > 0").select("source", "depth", F.posexplode_outer(chars(F.col("target"))).alias("at", "c"))
        onward = state.where("depth > 0").select(F.col("source").alias("c"), F.col("target").alias("to"), F.col("depth").alias("more"))
        joined = each.join(onward, "c", "left")
        text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", F.coalesce("to", "c", F.lit("")).alias("x")))), lambda p: p["x"]), "")
        stepped = joined.groupBy("source", "depth").agg(text.alias("target"), F.max(F.coalesce("more", F.lit(0).cast("long"))).alias("more"))
        stepped = written(stepped.select("source", "target", (F.col("depth") + F.col("more")).alias("depth"), (F.col("more") > 0).alias("moved")), "chains")
        moving = stepped.where("moved").count()
        state, turns = stepped.drop("moved").unionByName(state.where("depth = 0")), turns - 1
    return state.select("source", "target", F.col("depth").cast("int").alias("depth"), F.size(chars(F.col("target"))).alias("expansion"))
