"""Joins that find look-alike names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.confusables import letter_skeleton, skeleton


def skeletons(df: DataFrame, column: str) -> DataFrame:
    """``df`` with its column's ``skeleton``."""
    return df.withColumn("skeleton", skeleton(F.col(column)))


def lookalike_groups(df: DataFrame, column: str) -> DataFrame:
    """``(skeleton, first, n_names)``: distinct names that share a skeleton, never paired."""
    names = skeletons(df.select(column).distinct(), column)
    groups = names.groupBy("skeleton").agg(F.min(column).alias("first"), F.count(F.lit(1)).alias("n_names"))
    return groups.where("n_names > 1")


def confusable_with(df: DataFrame, column: str, protected: DataFrame, name: str) -> DataFrame:
    """Rows of ``df`` whose letters equal those of a protected name that they are not."""
    left = df.withColumn("_letters", letter_skeleton(F.col(column)))
    right = protected.select(F.col(name).alias("imitated"), letter_skeleton(F.col(name)).alias("_key")).distinct()
    joined = left.join(right, (F.col("_letters") == F.col("_key")) & (F.col(column) != F.col("imitated")))
    return joined.drop("_letters", "_key")
