"""Neighbours in a global order, found without a one-task window.

Rows are range-partitioned by the order and sorted where they land; each partition's task hands every row the one
before it. Across partitions only the edges meet, one row for each partition.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..intermediate import written
from ..shipping import ship


def _shift(columns: list[str]):
    """Add ``_before``, the given columns of the row before in the same partition, and the row's number there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, at = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            here = pa.StructArray.from_arrays([batch.column(c) for c in columns], columns)
            first = pa.nulls(1, here.type) if last is None else last
            before = pa.concat_arrays([first, here.slice(0, batch.num_rows - 1)])
            last = here.slice(batch.num_rows - 1)
            number = pa.array(range(at, at + batch.num_rows), pa.int64())
            at += batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, before, number], [*batch.schema.names, "_before", "_at"])

    return run


def neighbours(df: DataFrame, order: Sequence[Column | str], columns: Sequence[str]) -> DataFrame:
    """``df`` with ``before``: a struct of ``columns`` of the row just before in ``order``, null for the first row.

    Rows that ``order`` does not tell apart stand in any order, so its last columns should. Nulls sort as
    the order says. An empty table stays empty. A value that a third of all rows share needs further columns in
    ``order`` to be cut between partitions; without any it makes one large partition, which is still read as a stream.
    Columns named ``before`` or starting with ``_`` must not be there.
    """
    ship(df.sparkSession)
    by = [F.col(c) if isinstance(c, str) else c for c in order]
    struct = StructType([df.schema[c] for c in columns])
    schema = StructType([*df.schema, StructField("_before", struct), StructField("_at", LongType())])
    spread = df.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(_shift(list(columns)), schema)
    rows = written(spread.withColumn("_part", F.spark_partition_id()), "neighbours")
    last = rows.groupBy("_part").agg(F.max_by(F.struct(*columns), "_at").alias("_last"))
    # as many rows as there are partitions; each one is told the last row of the one before that has any
    edges = last.select(F.lead("_part").over(Window.orderBy("_part")).alias("_part"), "_last").where("_part is not null")
    joined = rows.join(F.broadcast(edges), "_part", "left")
    return joined.select(*df.columns, F.when(F.col("_at") > 0, F.col("_before")).otherwise(F.col("_last")).alias("before"))


def out_of_order(df: DataFrame, order: Sequence[Column | str], columns: Sequence[str], ordered: Column) -> DataFrame:
    """Rows whose neighbour ``before`` in ``order`` does not fulfil ``ordered``, a condition on both; where it is unknown they count, too."""
    found = neighbours(df, order, columns)
    return found.where(F.col("before").isNotNull() & ~F.coalesce(ordered, F.lit(False)))
