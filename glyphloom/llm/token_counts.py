"""Token counts with a digest cache.

Each text's content digest and the tokenizer's version digest are looked up in a table of
stored counts. Only distinct contents that the table lacks are encoded, and their counts
are appended to it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from pathlib import Path
from uuid import uuid4

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from .common import join_groups, shared_dir, text_or_empty, written

#: Characters given to the encoder in one call.
CALL_CHARS = 1_000_000
LIMIT = 4096
CACHE_SCHEMA = "digest string, n_tokens long, version string"


def _loader(name: str):
    """A function from the file's bytes to a function from texts to token counts."""
    if name.endswith(".json"):

        def load(model: bytes):
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_str(model.decode())
            tokenizer.no_truncation()
            tokenizer.no_padding()
            return lambda texts: [len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]

    else:

        def load(model: bytes):
            from sentencepiece import SentencePieceProcessor

            processor = SentencePieceProcessor(model_proto=model)
            return lambda texts: [len(ids) for ids in processor.encode(texts, num_threads=1, add_bos=False, add_eos=False)]

    return load


def _encode(texts: DataFrame, model: bytes, name: str) -> DataFrame:
    """``(digest, n_tokens)`` for each row of ``texts(text)``."""
    shared = texts.sparkSession.sparkContext.broadcast(model)
    load = _loader(name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = load(shared.value)
        for batch in batches:
            digests, counts, call, size = [], [], [], 0
            for value in batch.column(0):
                text = value.as_py()
                digests.append(hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest())
                call.append(text)
                size += len(text)
                if size >= CALL_CHARS:
                    counts += count(call)
                    call, size = [], 0
            if call:
                counts += count(call)
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.string()), pa.array(counts, pa.int64())], names=["digest", "n_tokens"])

    ship(texts.sparkSession)
    return texts.mapInArrow(run, "digest string, n_tokens long")


def stored_counts(spark: SparkSession, cache_path: str, version: str) -> DataFrame:
    """The cache's counts for one tokenizer version; none if there is no cache yet."""
    try:
        cache = spark.read.schema(CACHE_SCHEMA).parquet(cache_path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        cache = spark.createDataFrame([], CACHE_SCHEMA)
    # two runs that append at once may both store a digest, with the same count
    return cache.where(F.col("version") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(
    docs: DataFrame, model_path: str, cache_path: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row for each row of ``docs``: id, ``n_bytes, n_tokens, over_limit``.

    ``model_path`` is a ``.model`` or ``.json`` file that the driver can read; ``cache_path``
    is a Parquet folder that all executors share, made when absent and appended to.

    * The digest's content is the text with null as empty and no other change, since any
      other would change what the tokenizer counts.
    * Rows with equal texts are encoded once; repeated rows each have a result, and so has a
      row with a null id. A very long text is encoded by one call. An empty table gives an
      empty result; other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    model = Path(model_path).read_bytes()
    version = hashlib.sha256(model).hexdigest()
    text = text_or_empty(text_col)
    keyed = written(
        docs.select(F.col(id_col).alias("_id"), F.sha2(text, 256).alias("digest"), F.octet_length(text).cast("long").alias("n_bytes")),
        "token-keys",
    )
    first = written(keyed.groupBy("digest").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_rows")), "token-digests")
    misses = written(first.drop("_rows").join(stored_counts(spark, cache_path, version), "digest", "left_anti"), "token-misses")
    if not misses.isEmpty():
        # one row stands for each content; ids spread evenly whatever the size of a group of copies
        chosen = misses.select("_first").distinct().hint("shuffle_hash")
        texts = docs.select(F.col(id_col).alias("_id"), text.alias("text")).join(chosen, F.col("_id").eqNullSafe(F.col("_first")), "left_semi")
        new = _encode(texts.select("text"), model, model_path)
        new.withColumn("version", F.lit(version)).write.mode("append").parquet(cache_path)
    counts = first.select("digest", "_rows").join(stored_counts(spark, cache_path, version), "digest")
    out = join_groups(keyed, written(counts, "token-counts"), "digest", "_rows", keyed.count(), "inner")
    return out.select(F.col("_id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    cache = f"{shared_dir(spark)}/token-cache-{uuid4().hex}"  # a new cache, so that every run does the whole work
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"), cache)
