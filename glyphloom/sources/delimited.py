"""Readers of semicolon-separated property files and of detector fixtures.

Lines come from ``spark.read.text``; parsing is Spark expressions, so a folder of files is one
distributed scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def hex_list(s: Column) -> Column:
    """Code points of a space-separated hex list; an empty list for blank text."""
    parts = F.filter(F.split(F.trim(s), r"\s+"), lambda p: p != "")
    return F.transform(parts, lambda p: F.conv(p, 16, 10).cast("int"))


def decimal_list(s: Column) -> Column:
    parts = F.filter(F.split(F.trim(s), r"\s*,\s*"), lambda p: p != "")
    return F.transform(parts, lambda p: p.cast("int"))


def _body(line: Column) -> Column:
    return F.trim(F.substring_index(line, "#", 1))


def property_rows(lines: DataFrame, column: str = "value") -> DataFrame:
    """``lo, hi, fields`` of lines such as ``0041..005A ; Latin # note``; others are skipped."""
    parts = F.transform(F.split(_body(F.col(column)), ";"), lambda p: F.trim(p))
    span = F.split(parts[0], r"\.\.")
    rows = lines.select(parts.alias("parts"), span.alias("span")).where("span[0] rlike '^[0-9A-Fa-f]{1,6}$'")
    number = lambda i: F.conv(F.get("span", F.lit(i)), 16, 10).cast("int")
    return rows.select(
        number(0).alias("lo"), F.coalesce(number(1), number(0)).alias("hi"), F.slice("parts", 2, F.greatest(F.size("parts") - 1, F.lit(0))).alias("fields")
    )


def tabbed_rows(lines: DataFrame, column: str = "value") -> DataFrame:
    """``lines`` with ``cp, field, entry`` of rows such as ``U+4E00<tab>kName<tab>1``; notes and other rows are skipped."""
    parts = F.split(F.col(column), "\t")
    good = lines.where(F.col(column).rlike("^U\\+[0-9A-F]{4,6}\t[^\t]+\t"))
    return good.withColumns({"cp": F.conv(F.substring(parts[0], 3, 6), 16, 10).cast("int"), "field": parts[1], "entry": F.trim(parts[2])})


def read_tabbed(spark: SparkSession, path: str) -> DataFrame:
    """``cp, field, entry`` of tab-separated files; of several rows of one code point and field the first counts, by file name and then place in it."""
    lines = spark.read.text(path).select("value", F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("at"))
    return tabbed_rows(lines).groupBy("cp", "field").agg(F.min_by("entry", F.struct("file", "at")).alias("entry"))


def read_properties(spark: SparkSession, path: str) -> DataFrame:
    return property_rows(spark.read.text(path))


def read_fixtures(spark: SparkSession, path: str) -> DataFrame:
    """Rows of fixture files: ``family, line, section, level, input, tag, positions, attribution, citation``.

    ``@section`` and ``@level`` directives carry forward within a file. A file is numbered by
    its own window; fixture files are small, and the window is by file.
    """
    lines = spark.read.text(path).select(F.input_file_name().alias("file"), F.col("value").alias("v"), F.monotonically_increasing_id().alias("at"))
    order = Window.partitionBy("file").orderBy("at")
    before = order.rowsBetween(Window.unboundedPreceding, 0)
    directive = lambda name: F.nullif(F.regexp_extract("v", rf"^#\s*@{name}\s+(.*?)\s*$", 1), F.lit(""))
    carried = lambda name, default: F.coalesce(F.last(directive(name), True).over(before), F.lit(default))
    rows = lines.withColumn("line", F.row_number().over(order)).withColumn("section", carried("section", "<unspecified>")).withColumn("level", carried("level", "basic"))
    rows = rows.where("v not rlike '^\\\\s*(#|$)'")
    fields = F.split(_body(F.col("v")), ";")
    pairs = F.filter(F.transform(F.slice(fields, 4, 1000), lambda p: F.trim(p)), lambda p: p.contains("="))
    keyed = F.map_from_entries(
        F.transform(pairs, lambda p: F.struct(F.trim(F.substring_index(p, "=", 1)), F.regexp_replace(F.regexp_extract(p, "=(.*)$", 1), '^\\s*"?|"?\\s*$', "")))
    )
    return rows.select(
        F.regexp_extract("file", r"([^/]+?)(?:Test)?\.txt$", 1).alias("family"), "line", "section", "level", hex_list(fields[0]).alias("input"),
        F.nullif(F.regexp_extract(fields[1], r"Hazard:\s*(\w+)", 1), F.lit("")).alias("tag"), decimal_list(F.coalesce(F.get(fields, F.lit(2)), F.lit(""))).alias("positions"),
        keyed.alias("attribution"), F.trim(F.regexp_extract("v", "#(.*)$", 1)).alias("citation"),
    )


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """``path, sha256`` of every file, read as binary."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def read_word_lists(spark: SparkSession, path: str) -> DataFrame:
    """``lang, rank, word`` of files with a word on each line, named after their language."""
    lines = spark.read.text(path).select(F.input_file_name().alias("file"), F.trim("value").alias("word"), F.monotonically_increasing_id().alias("at")).where("word != ''")
    rank = F.row_number().over(Window.partitionBy("file").orderBy("at")) - 1
    return lines.select(F.regexp_extract("file", r"([^/]+)\.txt$", 1).alias("lang"), rank.alias("rank"), "word")
