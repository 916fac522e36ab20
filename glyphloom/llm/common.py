"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..intermediate import shared_folder

#: The six ASCII white-space characters that separate words.
SPACE_CHARS = " \t\n\x0b\x0c\r"
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``; a cluster that names none raises.

    A session on one machine without one (tests) gets a temporary folder.
    """
    return shared_folder(spark)


#: Spark removes the shuffle files of a query at its end, not when the driver happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _cleaned_shuffles(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it back.

    This cuts the lineage: a lost executor costs a re-read, not a recomputation,
    and several consumers of ``df`` share one evaluation. The shuffle files go with the write.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    with _cleaned_shuffles(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete the files of ``written`` tables that nothing reads any more."""
    for table in tables:
        for folder in {name.rpartition("/")[0] for name in table.inputFiles()}:
            spark = table.sparkSession
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def by_shuffle(rows: DataFrame) -> DataFrame:
    """``rows`` as a join's side that is never broadcast.

    Spark sizes what ``explode`` makes, and groups of it, like the table before it, and a table of Parquet like its
    packed files. So it may broadcast rows that take many times the threshold in the driver.
    """
    return rows.hint("merge")


#: A group of at least this many rows is joined by broadcast, and one of a thousandth of all rows beyond ten million.
HOT_ROWS = 10_000


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, n_rows: int, how: str = "left") -> DataFrame:
    """``rows`` joined to their ``groups(key, size, ..)``, whose ``size`` counts the group's rows.

    Rows of hot groups would all land in one task of a shuffle. There are at most a thousand
    groups of a thousandth of the rows or more, or of HOT_ROWS of fewer than ten million, so
    these are broadcast whatever the data; the other rows are joined by shuffle. Rows must be
    cheap to read twice. ``how`` is left or inner.
    """
    limit = max(HOT_ROWS, n_rows // 1_000)
    hot = F.broadcast(groups.where(F.col(size) >= limit))
    tagged = rows.join(hot, key, "left")
    cold = tagged.where(F.col(size).isNull()).select(*rows.columns).join(groups.where(F.col(size) < limit), key, how)
    return tagged.where(F.col(size).isNotNull()).unionByName(cold)


def plain_names(docs: DataFrame, *wanted: str) -> tuple[DataFrame, list[str]]:
    """``docs`` with columns ``_c0, _c1, ..``, which clash with nothing, and the new names of ``wanted``."""
    names = [f"_c{i}" for i in range(len(docs.columns))]
    return docs.toDF(*names), [names[docs.columns.index(w)] for w in wanted]


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def ascii_lower(value: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(value, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def held_out(modulus: int, remainder: int = 2) -> Column:
    """True for documents whose crc32(doc_id as text) falls in the held-out fold."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == remainder
