"""Mix sources to target weights by Sainte-Laguë apportionment, in DataFrame operations.

Each source's text is laid end to end in a seeded order and cut into blocks of nearly
equal numbers of words. Highest quotients ``target / (2 k + 1)`` give each source a whole
number of words, which is rounded to blocks of the source, and the same rule deals these
blocks to its shards. Blocks are equal but for small sources, whose blocks are shorter. A shard takes every block ``quota div blocks`` times and a seeded choice of
its blocks once more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, plain_names, text_or_empty, written

#: No word is taken more often than this.
MAX_REPEATS = 3
#: A shard holds about this many words until a source has MAX_SHARDS of them.
SHARD_WORDS = 32_768
MAX_SHARDS = 4_096
#: Blocks are of T / BLOCKS words for T words in all, within 1 and MAX_BLOCK_WORDS.
BLOCKS = 100_000
MAX_BLOCK_WORDS = 512
#: A small source is cut to shorter blocks, into about this many at least where it has the words.
SOURCE_BLOCKS = 100
SEED = 17


def words(column: str = "text") -> Column:
    return F.regexp_count(text_or_empty(column), F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, source_col: str, weights: tuple[int, ...], max_repeats: int) -> DataFrame:
    """One row per source: ``source, source_size, weight, target``.

    ``sizes`` has a row per source (``source, source_size``). Sources in code-point
    order, null last, take the weights in turn. A target above ``max_repeats`` times its
    source is cut to that and the rest shared again by weight: the sources that end up
    cut are those with the smallest limit per unit of weight, so one pass in that order
    finds them all. This window runs over one row per source, not over documents.
    """
    by_name = Window.orderBy(F.col(source_col).isNull(), F.encode(F.col(source_col), "UTF-8"))
    turn = F.array(*[F.lit(w) for w in weights])
    ranked = sizes.withColumn("_rank", F.row_number().over(by_name)).withColumn(
        "weight", F.element_at(turn, ((F.col("_rank") - 1) % len(weights) + 1).cast("int")).cast("double")
    )
    limit = max_repeats * F.col("source_size").cast("double")
    ranked = ranked.withColumn("_ratio", limit / F.col("weight"))
    order = Window.orderBy("_ratio", "_rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum(limit).over(before), F.lit(0.0))
    weight_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    level = ranked.withColumn("_share", left / weight_left).withColumn("_cut", F.col("_ratio") <= F.col("_share"))
    # past the last source that is cut, the first share that no limit stops is everyone's
    free = F.min(F.when(~F.col("_cut"), F.struct("_ratio", "_rank", "_share"))).over(everything)
    return level.withColumn("_free", free["_share"]).select(
        source_col,
        "source_size",
        "weight",
        F.when(F.col("_cut"), limit).otherwise(F.col("_free") * F.col("weight")).alias("target"),
    )


def sainte_lague(parties: DataFrame, votes: str, seats: Column, group: list[str], tie: list[Column], out: str) -> DataFrame:
    """Add ``out``: the seats each party of a group gets by highest quotients.

    A party holds ``floor(votes / (2 x) + 1/2)`` of the quotients ``votes / (2 k + 1)``
    that are at least ``x``. With n parties, an ``x`` of total / (seats + n / 2) lies below
    the last winning quotient and one of total / (seats - n / 2) above it, so only about
    2 n quotients between the two are ranked. Ties go by ``tie``. Votes of zero get none.
    """
    over = Window.partitionBy(*group) if group else Window.partitionBy()
    p = parties.withColumn("_seats", seats.cast("double"))
    p = p.withColumn("_total", F.sum(votes).over(over)).withColumn("_n", F.count(F.lit(1)).over(over))

    def held(bound: Column) -> Column:
        quota = F.when(F.col("_total") > 0, F.col(votes) * bound / F.col("_total")).otherwise(0.0)
        return F.floor(quota + 0.5).cast("long")

    sure = F.greatest(F.col("_seats") - F.col("_n") / 2 - 0.25, F.lit(0.0))
    p = p.withColumn("_low", F.when(F.col(votes) > 0, held(sure)).otherwise(0))
    p = p.withColumn("_high", F.when(F.col(votes) > 0, held(F.col("_seats") + F.col("_n") / 2 + 0.25)).otherwise(0))
    # the quotients that may or may not win, one row for each
    q = p.withColumn("_open", F.col("_seats") - F.sum("_low").over(over)).withColumn(
        "_k", F.explode_outer(F.when(F.col("_high") > F.col("_low"), F.sequence("_low", F.col("_high") - 1)))
    )
    quotient = F.col(votes) / (2 * F.col("_k") + 1)
    best = over.orderBy(F.col("_k").isNull(), quotient.desc(), *tie)
    q = q.withColumn("_win", (F.col("_k").isNotNull() & (F.row_number().over(best) <= F.col("_open"))).cast("long"))
    kept = [c for c in parties.columns]
    return q.groupBy(*kept).agg((F.first("_low") + F.sum("_win")).alias(out))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = (1, 2, 3),
    max_repeats: int = MAX_REPEATS,
    seed: int = SEED,
) -> DataFrame:
    """One row for each row of ``docs``: id, ``size, source_size, target, taken``.

    ``taken`` counts the words that the mix takes of the document, repeats included, and
    never exceeds ``max_repeats`` times its size. The result depends on ids, sizes,
    sources and the seed only.

    * A null or wordless text has size 0 and nothing taken; a source of such texts
      has target 0. A null source is a source of its own, last in order.
    * Rows repeated with one id are separate rows; an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.col(source_col).alias("_source"), words(text_col).alias("_size"))
    rows = written(rows, "mix-sizes")
    targets = source_targets(
        rows.groupBy("_source").agg(F.sum("_size").alias("source_size")), "_source", weights, max_repeats
    )
    total = F.sum("source_size").over(Window.partitionBy())
    block = F.greatest(F.lit(1.0), F.least(F.lit(float(MAX_BLOCK_WORDS)), F.floor(total / BLOCKS), F.floor(F.col("source_size") / SOURCE_BLOCKS)))
    targets = targets.withColumn("_block", block).withColumn("_all", total)
    sources = sainte_lague(
        targets, "target", F.col("_all"), [], [F.col("_source").isNull(), F.col("_source")], "_quota_words"
    )
    sources = sources.withColumn("_blocks", F.floor(F.col("_quota_words") / F.col("_block") + 0.5).cast("long")).drop("_quota_words")
    sources = written(
        sources.withColumn(
            "_shards", F.greatest(F.lit(1), F.least(F.lit(MAX_SHARDS), F.ceil(F.col("source_size") / SHARD_WORDS))).cast("int")
        ),
        "mix-sources",
    )
    placed = rows.join(F.broadcast(sources) if _few(sources) else sources, rows["_source"].eqNullSafe(sources["_source"]), "left").drop(sources["_source"])
    order = F.xxhash64(F.lit(seed), F.col("_id").cast("string"))
    placed = placed.withColumn("_order", order).withColumn("_shard", F.pmod(F.xxhash64(F.lit(seed + 1), "_order"), F.col("_shards")))
    shard = ["_source", "_shard"]
    line = Window.partitionBy(*shard).orderBy("_order", F.col("_id").cast("string"), "_size")
    placed = placed.withColumn("_end", F.sum("_size").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    placed = placed.withColumn("_start", F.col("_end") - F.col("_size"))

    filled = placed.where("_size > 0")
    shards = filled.groupBy(*shard).agg(
        F.sum("_size").cast("double").alias("_words"), F.first("_block").alias("_block"), F.first("_blocks").alias("_blocks")
    )
    shards = shards.withColumn("_cuts", F.greatest(F.lit(1), F.floor(F.col("_words") / F.col("_block") + 0.5)).cast("long"))
    shards = sainte_lague(shards, "_words", F.col("_blocks"), ["_source"], [F.col("_shard")], "_quota")
    shards = shards.withColumn("_quota", F.least(F.col("_quota"), max_repeats * F.col("_cuts")))
    blocks = shards.select(*shard, "_cuts", "_quota", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_cuts") - 1)).alias("_b"))
    draw = Window.partitionBy(*shard).orderBy(F.xxhash64(F.lit(seed + 2), F.col("_source"), "_shard", "_b"), "_b")
    blocks = blocks.withColumn(
        "_times",
        F.floor(F.col("_quota") / F.col("_cuts")) + (F.row_number().over(draw) <= F.col("_quota") % F.col("_cuts")).cast("long"),
    )
    blocks = blocks.select(F.col("_source").alias("_s"), F.col("_shard").alias("_h"), "_b", "_times")

    # word x of a shard lies in block ((x + 1) * cuts - 1) div words; block b is [b * words div cuts, (b + 1) * words div cuts)
    cuts = shards.select(F.col("_source").alias("_s0"), F.col("_shard").alias("_h0"), "_cuts", F.col("_words").cast("long").alias("_words"))
    spread = filled.join(cuts, filled["_source"].eqNullSafe(cuts["_s0"]) & (filled["_shard"] == cuts["_h0"])).withColumn(
        "_b",
        F.explode(F.sequence(F.expr("((_start + 1) * _cuts - 1) div _words"), F.expr("(_end * _cuts - 1) div _words"))),
    )
    both = spread["_source"].eqNullSafe(blocks["_s"]) & (spread["_shard"] == blocks["_h"]) & (spread["_b"] == blocks["_b"])
    spread = spread.join(blocks, both).drop(blocks["_b"])
    low = F.greatest(F.col("_start"), F.expr("(_b * _words) div _cuts"))
    high = F.least(F.col("_end"), F.expr("((_b + 1) * _words) div _cuts"))
    taken = spread.groupBy("_id", "_source", "_shard", "_start", "_size").agg(
        F.first("source_size").alias("source_size"), F.first("target").alias("target"), F.sum((high - low) * F.col("_times")).alias("taken")
    )
    columns = ["_id", "_size", "source_size", "target", "taken"]
    none = placed.where("_size = 0").withColumn("taken", F.lit(0).cast("long"))
    return (
        taken.select(*columns)
        .unionByName(none.select(*columns))
        .select(
            F.col("_id").alias(id_col),
            F.col("_size").alias("size"),
            F.col("source_size").cast("long").alias("source_size"),
            F.col("target").cast("double").alias("target"),
            F.col("taken").cast("long").alias("taken"),
        )
    )


#: The source table is broadcast up to this many rows and joined by shuffle beyond.
FEW_SOURCES = 2_000


def _few(sources: DataFrame) -> bool:
    return sources.limit(FEW_SOURCES + 1).count() <= FEW_SOURCES


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The documents that the mix takes words of, with ``taken`` and ``repeats``.

    ``repeats`` is the whole number of times the document is to be read, one at least.
    Columns of ``docs`` that are called so give way; other names do not matter. Documents
    without words go. Rows repeated with one id share their counts; a null id is an id of
    its own. An empty table gives an empty result.
    """
    inner, (key, text, source) = plain_names(docs, id_col, text_col, source_col)
    found = mix(inner, key, text, source).where("taken > 0")
    counts = found.groupBy(F.col(key).alias("_id")).agg(F.sum("taken").alias("_taken"), F.sum("size").alias("_size"))
    out = inner.join(counts, F.col(key).eqNullSafe(F.col("_id")))
    kept = [F.col(n).alias(c) for n, c in zip(inner.columns, docs.columns) if c not in ("taken", "repeats")]
    repeats = F.greatest(F.lit(1), F.round(F.col("_taken") / F.col("_size"))).cast("int")
    return out.select(*kept, F.col("_taken").alias("taken"), repeats.alias("repeats"))
