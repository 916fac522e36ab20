"""Tables between the jobs of one operator, in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. A session on one machine that names none gets a temporary one; a cluster has to name it."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.match(r"local(\[[^,\]]*(,\s*\d+)?\])?$", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="glyphloom-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as Parquet in the shared folder, read back: evaluated once, and re-read if an executor is lost."""
    path = f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
