"""Exact deduplication by progressive refinement, in DataFrame operations only.

Texts are equal when they are identical after every ASCII white-space character is
deleted. Groups are refined in three rounds: by length, then by a hash of the first
characters, then by a SHA-256 of the whole normalised text. A round only sees what
the round before could not tell apart, and the whole text is hashed only in groups
that are still larger than one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_CHARS, join_groups, plain_names, text_or_empty, written

#: Code points of the normalised text that the second round hashes.
PREFIX_CHARS = 256
#: Up to so many surviving groups (16 bytes each) are broadcast to the scan that hashes their texts.
FEW_GROUPS = 1_000_000


def normalised(column: str = "text") -> Column:
    return F.translate(text_or_empty(column), SPACE_CHARS, "")


def refine(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The key combinations of ``keys`` that more than one row has, with their rows ``_n``."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_all: bool = False) -> DataFrame:
    """One row for each row of ``docs``: ``id, keep_id, group_size, kept, text_sha256``.

    The row that stays is the one with the most code points in the original text, then
    the smallest id. ``text_sha256`` is null where the whole text never had to be
    hashed, unless ``hash_all`` asks for every digest. Texts are read where they lie and never
    shuffled: rounds and keepers see ids, sizes and hashes only.

    * A null text counts as empty; empty texts and texts of white space form one group.
      A very long text is normalised and hashed whole in its task.
    * Rows repeated with the same id and text are one group whose size counts each of
      them; all of them carry ``kept`` when their id is the one that stays. A null id
      is last among ids.
    * An empty table gives an empty result; other columns of ``docs`` are ignored,
      whatever their names.
    """
    rows = docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text")).withColumn("_norm", normalised("_text"))
    prefix = F.xxhash64(F.substring("_norm", 1, PREFIX_CHARS), F.octet_length("_norm"))
    full = F.sha2("_norm", 256)
    narrow = ["_id", F.length("_text").alias("_chars"), F.octet_length("_norm").alias("_bytes"), prefix.alias("_prefix")]
    sized = written(rows.select(*narrow, (full if hash_all else F.lit(None).cast("string")).alias("_sha")), "exact-sizes")
    n = sized.count()
    by_length = refine(sized, ["_bytes"])
    # few lengths: no text is longer than 2 GB and most lengths repeat, so this join is small on one side or the other
    alike = join_groups(sized.select("_bytes", "_prefix"), by_length, "_bytes", "_n", n, "inner").drop("_n")
    by_prefix = written(refine(alike, ["_prefix"]), "exact-prefixes")
    if hash_all:
        tagged = join_groups(sized, by_prefix, "_prefix", "_n", n)
        hashed = tagged.select("_id", "_chars", "_sha", F.col("_n").isNotNull().alias("_open"))
    else:
        if by_prefix.count() <= FEW_GROUPS:
            again = rows.select(*narrow, "_norm").join(F.broadcast(by_prefix), "_prefix", "left")
        else:  # hashing all texts in the scan costs less than moving them
            again = rows.select(*narrow, "_norm").withColumn("_n", F.lit(1))
        open_row = F.col("_n").isNotNull()
        hashed = written(again.select("_id", "_chars", F.when(open_row, full).alias("_sha"), open_row.alias("_open")), "exact-hashes")
    return _keepers(hashed, id_col, n)


def _keepers(hashed: DataFrame, id_col: str, n: int) -> DataFrame:
    """Attach each group's size and the row that stays.

    The groups come from a partial aggregate (one row per key leaves each task). Rows of
    texts that are alone in their length and prefix never meet the join.
    """
    open_rows = hashed.where("_open").drop("_open")
    best = F.min(F.struct((-F.col("_chars")).alias("c"), F.col("_id").isNull().alias("n"), F.col("_id").alias("i")))
    groups = written(open_rows.groupBy("_sha").agg(F.count(F.lit(1)).alias("_size"), best.alias("_best")), "exact-groups")
    found = join_groups(open_rows, groups, "_sha", "_size", n, "inner").select("_id", "_sha", "_size", F.col("_best.i").alias("_keep"))
    alone = hashed.where("not _open").select("_id", "_sha", F.lit(1).cast("long").alias("_size"), F.col("_id").alias("_keep"))
    return found.unionByName(alone).select(
        F.col("_id").alias(id_col),
        F.col("_keep").alias("keep_id"),
        F.col("_size").cast("long").alias("group_size"),
        F.col("_keep").eqNullSafe(F.col("_id")).alias("kept"),
        F.col("_sha").alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that another row stands for; columns unchanged, whatever their names.

    Of rows repeated with one id and equal texts, one stays. Null texts count as empty, a
    null id is an id of its own. An empty table gives an empty result.
    """
    inner, (key, text) = plain_names(docs, id_col, text_col)
    marks = written(exact_dedup(inner, key, text), "exact-marks")
    per_id = marks.groupBy(F.col(key).alias("_id")).agg(F.count(F.lit(1)).alias("_rows"), F.count_if("kept").alias("_kept"))
    per_id = written(per_id.where("_rows > 1 or _kept = 0"), "exact-lost")
    same_id = F.col(key).eqNullSafe(F.col("_id"))
    out = inner.join(per_id.select("_id"), same_id, "left_anti")
    repeated = per_id.where("_rows > 1 and _kept > 0").select("_id")
    if not repeated.isEmpty():  # rows of one id are told apart by their texts
        some = inner.join(repeated, same_id, "left_semi").withColumn("_key", F.sha2(normalised(text), 256)).dropDuplicates([key, "_key"])
        lost = marks.where("not kept").select(F.col(key).alias("_id"), "text_sha256").distinct()
        some = some.join(lost, same_id & (F.col("_key") == F.col("text_sha256")), "left_anti")
        out = out.unionByName(some.drop("_key"))
    return out.toDF(*docs.columns)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), hash_all=True)


OP4_SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents
), h AS (SELECT doc_id, chars, norm, sha256(norm) AS text_sha256 FROM t)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept,
       text_sha256
FROM h WINDOW w AS (PARTITION BY norm ORDER BY chars DESC, doc_id)
"""
