"""Confusable skeletons: prototype substitution between case folds and decompositions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from ..tables import icu
from .casing import fold
from .normalize import nfd

_prototypes: dict[str, dict[int, str]] = {}


def prototype_map() -> dict[int, str]:
    """Confusable prototypes of this session's ICU, a fixed table of some 6,000 entries."""
    spark = SparkSession.active()
    key = spark.sparkContext.applicationId
    if key not in _prototypes:
        _prototypes[key] = icu.prototypes(spark)
    return _prototypes[key]


def confusable_class() -> str:
    return icu.char_class(*sorted(prototype_map()))


def step_table(spark: SparkSession) -> DataFrame:
    """``(source, target)``: one step of each character that folds or else has a prototype, which is folded in turn."""
    cps = spark.range(0, 0x110000, 1, 8).where("id not between 55296 and 57343").select(F.expr("decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32')").alias("source"))
    folded = cps.withColumn("target", fold(F.col("source"))).where("source != target")
    known = spark.createDataFrame([(chr(cp), t) for cp, t in prototype_map().items()], "source string, target string")
    return folded.unionByName(known.join(folded, "source", "left_anti").withColumn("target", fold(F.col("target"))))


def substitute(s: Column) -> Column:
    """Each character to its prototype, once."""
    spark = SparkSession.active()
    ship(spark)
    shared = spark.sparkContext.broadcast(prototype_map())

    @F.pandas_udf("string")
    def swap(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        table = shared.value
        for batch in batches:
            yield batch.map(lambda t: t.translate(table), na_action="ignore")

    return swap(s)


def skeleton(s: Column) -> Column:
    """Decompose, fold, substitute, fold and decompose again."""
    return nfd(fold(substitute(fold(nfd(s)))))


def letter_skeleton(s: Column, rounds: int = 2) -> Column:
    """A repeated skeleton without combining marks and default-ignorable characters.

    Two rounds reach the fixed point of ICU's table, whose prototypes are final but for
    the folding between.
    """
    for _ in range(rounds):
        s = skeleton(s)
    return F.regexp_replace(s, icu.regex("[[:^ccc=0:][:DI:]]"), "")
