"""Collation by Spark's own ICU collations (CLDR root order)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Spark collations by strength.
STRENGTHS = {"tertiary": "UNICODE", "secondary": "UNICODE_CI", "primary": "UNICODE_CI_AI"}


def collated(s: Column, strength: str = "tertiary", locale: str | None = None) -> Column:
    """``s`` with a collation: its comparisons, sorts, joins and groups follow it.

    ``locale`` is an ICU locale name such as ``de`` in place of the root.
    """
    name = STRENGTHS[strength]
    return F.collate(s, name if locale is None else name.replace("UNICODE", locale))


def compare(a: Column, b: Column, strength: str = "tertiary") -> Column:
    """-1, 0 or 1 as ``a`` sorts before, with or after ``b``; null with a null."""
    x, y = collated(a, strength), collated(b, strength)
    return F.when(x < y, -1).when(x == y, 0).when(x > y, 1)


def ordered(df: DataFrame, column: str, strength: str = "tertiary") -> DataFrame:
    return df.orderBy(collated(F.col(column), strength), F.col(column))


def groups(df: DataFrame, column: str, strength: str = "primary"):
    """``df`` grouped by what its column's values collate with, for an aggregate."""
    return df.withColumn("_collated", collated(F.col(column), strength)).groupBy("_collated")
