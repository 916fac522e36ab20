"""Range joins: points to the intervals that hold them, as an equi-join on blocks.

An interval is cut by the blocks of a level whose width suits it, so that it takes few rows whatever its
length; a point looks into one block of each level in use. The block is the join key, so Spark hashes and shuffles
(or broadcasts) as it does for any key, and the bounds are checked on the few pairs that share a block. No nested loop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of the narrowest blocks, by which each level widens them, and of the widest.
FIRST_BITS, STEP_BITS, LAST_BITS = 6, 4, 58


def _level(lo: Column, hi: Column) -> Column:
    """Bits of the narrowest level at which an interval touches 17 blocks at most."""
    found = None
    for bits in range(FIRST_BITS, LAST_BITS, STEP_BITS):
        fits = F.shiftright(hi, bits) - F.shiftright(lo, bits) <= 1 << STEP_BITS
        found = F.when(fits, bits) if found is None else found.when(fits, bits)
    return found.otherwise(LAST_BITS)


def blocks_of(ranges: DataFrame, lo: str = "lo", hi: str = "hi") -> DataFrame:
    """``ranges`` with ``_bits, _block``: a row for each block of its level that an interval touches."""
    low, high = F.col(lo).cast("long"), F.col(hi).cast("long")
    rows = ranges.where(low <= high).withColumn("_bits", _level(low, high))
    shifted = lambda c: F.expr(f"shiftright(cast(`{c}` as bigint), _bits)")
    return rows.withColumn("_block", F.explode(F.sequence(shifted(lo), shifted(hi))))


def range_join(points: DataFrame, ranges: DataFrame, point: str, lo: str = "lo", hi: str = "hi", how: str = "inner") -> DataFrame:
    """Each row of ``points`` with each row of ``ranges`` whose interval holds it, ends included.

    ``how`` is inner, or left to keep points that no interval holds, with nulls. Columns of both sides follow each
    other and must differ in name. Points are whole numbers; a null one is in no interval, nor is anything in an
    interval with a null end or one that ends before it starts. Intervals may overlap and repeat: each gives its row.
    """
    names = [*points.columns, *ranges.columns]
    if len(set(names)) < len(names):
        raise ValueError("columns of points and ranges must differ")
    cut = blocks_of(ranges, lo, hi)
    # a level is a small number: which ones are in use is known before the join, a dozen at most
    levels = sorted(r["_bits"] for r in cut.select("_bits").distinct().collect())
    at = F.col(point).cast("long")
    looks = F.array(*[F.struct(F.lit(b).alias("_bits"), F.shiftright(at, b).alias("_block")) for b in levels]) if levels else F.array().cast("array<struct<_bits:int,_block:bigint>>")
    probes = points.select("*", F.explode(looks).alias("_look")).select(*points.columns, "_look._bits", "_look._block")
    inside = (F.col(lo).cast("long") <= at) & (at <= F.col(hi).cast("long"))
    found = probes.join(cut, ["_bits", "_block"]).where(inside).select(*names)
    if how == "inner":
        return found
    if how != "left":
        raise ValueError("how is inner or left")
    held = found.select(F.col(point).alias("_held")).distinct()
    alone = points.join(held, F.col(point) == F.col("_held"), "left_anti")
    return found.unionByName(alone, allowMissingColumns=True)


def codepoint_counts(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, cp, n``: how often each row's text holds each code point; counts meet in each task before they are shuffled."""
    each = df.select(F.col(key), F.explode(F.split(text, "")).alias("c")).where("c != ''")
    return each.groupBy(key, "c").agg(F.count(F.lit(1)).alias("n")).select(key, F.ascii("c").alias("cp"), "n")


def property_profile(df: DataFrame, key: str, text: str, ranges: DataFrame, default: str) -> DataFrame:
    """``key, value, n``: code points of each row's text by the value that ``ranges(lo, hi, value)`` give them.

    Code points in no range have the value ``default``. Rows with null or empty texts have no counts.
    """
    counts = codepoint_counts(df, key, text)
    # a code point's value is looked up once for the whole table, then joined back to the counts
    known = range_join(counts.select("cp").distinct(), ranges, "cp").select("cp", "value").distinct()
    valued = counts.join(known, "cp", "left")
    return valued.groupBy(key, F.coalesce("value", F.lit(default)).alias("value")).agg(F.sum("n").alias("n"))


def script_ranges(spark: SparkSession) -> DataFrame:
    """``(lo, hi, value)``: maximal runs of one script, unassigned code points left out."""
    from ..tables import icu

    return icu.range_table(spark, "Script").where("value != 'Zzzz'")
