"""Names of Unicode properties: strict and loose look-ups as joins with an alias table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def loose(name: Column) -> Column:
    """A name without regard to case, blanks, underscores and hyphens."""
    return F.regexp_replace(F.lower(name), r"[ \t\n\r_-]", "")


def resolved(df: DataFrame, column: str, aliases: DataFrame, strict: bool = False) -> DataFrame:
    """``df`` with ``property``, the short name of the property that ``column`` names, null for none.

    ``aliases(short, alias)`` has a row for each name; where a spelling fits several properties, the least short name counts. The
    key is the spelling itself or its loose form, so names meet the table in an equality join.
    """
    key = (lambda c: c) if strict else loose
    table = aliases.groupBy(key(F.col("alias")).alias("_key")).agg(F.min("short").alias("property"))
    return df.withColumn("_key", key(F.col(column))).join(table, "_key", "left").drop("_key")
