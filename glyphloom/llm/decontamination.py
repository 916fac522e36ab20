"""Benchmark decontamination by greedy string tiling.

Texts and test items are words, lower case and without punctuation. Runs of SEED words
that a document shares with an item are found by a join. A pair that shares as many as the
coverage needs is tiled: the longest common runs that do not overlap are marked again and
again, found by running Karp-Rabin hashes, so a passage whose parts were reordered is still
covered. A document is contaminated by an item when the tiles cover enough of the item.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import ceil, log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from .common import join_groups, plain_names, written

#: Words of a seed, and the shortest tile.
SEED = 5
#: Part of an item's words that tiles must cover.
COVERAGE = 0.5
#: Bits of the filter for each seed of the benchmark, hashes, and least and most bits.
FILTER_BITS_PER_SEED = 64
FILTER_HASHES = 4
FILTER_LEAST, FILTER_MOST = 20, 27

_WORD = re.compile(r"\w+")
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def words(text: str | None) -> np.ndarray:
    """The words of a text as 64-bit hashes, signed."""
    digest = xxhash.xxh64_intdigest
    found = _WORD.findall((text or "").lower())
    return np.fromiter((digest(w.encode("utf-8", "surrogatepass")) for w in found), np.uint64, len(found)).view(np.int64)


def run_hashes(tokens: np.ndarray, width: int) -> np.ndarray:
    """A hash of every run of ``width`` tokens, from differences of one running sum."""
    n = len(tokens)
    if n < width or width < 1:
        return np.empty(0, np.uint64)
    mixed = (tokens.view(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(32)
    up, down = np.full(n, _BASE), np.full(n, _INVERSE)
    up[0] = down[0] = 1
    up, down = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed * up, dtype=np.uint64)])
    return (sums[width:] - sums[:-width]) * down[: n - width + 1]


class _Side:
    """A token sequence with marks; runs are looked up by hash among unmarked tokens only."""

    def __init__(self, tokens: np.ndarray):
        self.tokens, self.free = tokens, np.ones(len(tokens), bool)

    def runs(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes and starts of the unmarked runs of a width."""
        if len(self.tokens) < width:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        marked = np.concatenate([[0], np.cumsum(~self.free)])
        at = np.flatnonzero(marked[width:] == marked[:-width])
        return run_hashes(self.tokens, width)[at], at


def _near_seeds(doc: np.ndarray, item: np.ndarray, least: int) -> np.ndarray:
    """Places of the document's tokens that lie in a run of ``least`` which the item holds."""
    hit = np.flatnonzero(np.isin(run_hashes(doc, least), run_hashes(item, least)))
    covered = np.zeros(len(doc) + 1, np.int64)
    np.add.at(covered, hit, 1)
    np.add.at(covered, hit + least, -1)
    return np.flatnonzero(np.cumsum(covered)[:-1] > 0)


def tiles(doc: np.ndarray, item: np.ndarray, least: int = SEED) -> list[tuple[int, int, int]]:
    """Greedy tiles ``(doc start, item start, length)``, longest first.

    Each round halves its way to the greatest width at which both sides share an unmarked
    run, and marks all such runs: by the item's order, each at the document's first free
    place. Ties so go to the earliest. No pair of places is ever listed, so texts that repeat
    one word cost no more than others.
    """
    kept = _near_seeds(doc, item, least)
    if not len(kept):
        return []
    # the rest of the document holds no tile; a gap is one token that the item lacks
    gaps = np.flatnonzero(np.diff(kept) > 1) + 1
    foreign = np.int64(np.setdiff1d(np.arange(len(item) + 1), item)[0])
    d, i = _Side(np.insert(doc[kept], gaps, foreign)), _Side(item)
    places = np.insert(kept, gaps, -1)
    out: list[tuple[int, int, int]] = []

    def shared(width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        (hd, at_d), (hi, at_i) = d.runs(width), i.runs(width)
        both = np.isin(hi, hd)
        return hd, at_d, hi[both], at_i[both]

    high = min(len(d.tokens), len(item))
    while high >= least:
        low, top = least - 1, high  # a shared run of a width holds one of each lesser width
        while low < top:
            mid = (low + top + 1) // 2
            low, top = (mid, top) if len(shared(mid)[3]) else (low, mid - 1)
        if low < least:
            break
        width = high = low
        hd, at_d, hi, at_i = shared(width)
        order = np.argsort(hd, kind="stable")
        hd, at_d = hd[order], at_d[order]
        tried: dict[int, int] = {}
        for hash_i, start in zip(hi.tolist(), at_i.tolist()):
            if not i.free[start : start + width].all():
                continue
            first = int(np.searchsorted(hd, np.uint64(hash_i)))
            at = tried.get(hash_i, first)
            while at < len(hd) and int(hd[at]) == hash_i and not d.free[at_d[at] : at_d[at] + width].all():
                at += 1
            tried[hash_i] = at
            if at < len(hd) and int(hd[at]) == hash_i:
                p = int(at_d[at])
                d.free[p : p + width] = i.free[start : start + width] = False
                out.append((int(places[p]), start, width))
    return out


def _seeds(items: DataFrame) -> DataFrame:
    """``(item, words, hashes, times)`` of ``items(item, text)``: distinct seeds and how often each occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = [words(t) for t in batch.column(1).to_pylist()]
            found = [np.unique(run_hashes(t, SEED), return_counts=True) for t in tokens]
            lists = (tokens, [h.view(np.int64) for h, _ in found], [n for _, n in found])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.list_(pa.int64())) for x in lists)], names=["item", "words", "hashes", "times"])

    kind = items.schema["item"].dataType.simpleString()
    return items.mapInArrow(run, f"item {kind}, words array<long>, hashes array<long>, times array<long>")


def _places(hashes: np.ndarray, size: int) -> list[np.ndarray]:
    """The bits of the filter for each hash, from a double hash; size is a power of two."""
    step = (hashes >> np.uint64(32)) | np.uint64(1)
    return [(hashes + np.uint64(k) * step) & np.uint64(size - 1) for k in range(FILTER_HASHES)]


def seed_filter(seeds: DataFrame) -> np.ndarray:
    """A Bloom filter of the seeds' hashes, gathered as bytes with any bit set.

    Its size follows the number of seeds up to 2 ** FILTER_MOST bits (16 MB), whatever
    the benchmark's; past that more documents go to the join, which stays exact.
    """
    n = max(1, seeds.count())
    size = 1 << min(FILTER_MOST, max(FILTER_LEAST, ceil(log2(n * FILTER_BITS_PER_SEED))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            where = np.unique(np.concatenate(_places(hashes, size))).astype(np.int64)
            cells, start = np.unique(where >> 6, return_index=True)
            bits = np.bitwise_or.reduceat(np.left_shift(np.uint64(1), (where & 63).astype(np.uint64)), start) if len(where) else np.empty(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(bits.view(np.int64))], names=["cell", "bits"])

    cells = seeds.select("hash").mapInArrow(run, "cell long, bits long").groupBy("cell").agg(F.bit_or("bits").alias("bits")).toArrow().to_pandas()
    out = np.zeros(size // 64, np.uint64)
    out[cells["cell"].to_numpy()] = cells["bits"].to_numpy(np.int64).view(np.uint64)
    return out


def _hits(docs: DataFrame, bits: np.ndarray) -> DataFrame:
    """Documents with a run that passes the filter: ``id, key, words, hashes``; equal word sequences have one key."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = shared.value
        size = len(cells) * 64
        for batch in batches:
            rows, keys, tokens, passed = [], [], [], []
            for r, text in enumerate(batch.column(1)):
                own = words(text.as_py())
                hashes = run_hashes(own, SEED)
                for place in range(FILTER_HASHES):
                    where = _places(hashes, size)[place] if len(hashes) else hashes
                    hashes = hashes[(cells[where >> np.uint64(6)] >> (where & np.uint64(63))) & np.uint64(1) == 1]
                if len(hashes):
                    rows.append(r)
                    keys.append(xxhash.xxh128_hexdigest(own.tobytes()))
                    tokens.append(own)
                    passed.append(np.unique(hashes).view(np.int64))
            lists = (tokens, passed)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(keys, pa.string()), *(pa.array(x, pa.list_(pa.int64())) for x in lists)],
                names=["id", "key", "words", "hashes"],
            )

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(run, f"id {kind}, key string, words array<long>, hashes array<long>")


def _tiled(pairs: DataFrame) -> DataFrame:
    """Tile each row of ``(key, item, words, test)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            covered, number = [], []
            for d, i in zip(batch.column(2), batch.column(3)):
                item = i.values.to_numpy()
                found = tiles(d.values.to_numpy(), item)
                covered.append(sum(t[2] for t in found) / len(item))
                number.append(len(found))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(covered, pa.float64()), pa.array(number, pa.int32())], names=["key", "item", "coverage", "n_tiles"]
            )

    kind = pairs.schema["item"].dataType.simpleString()
    return pairs.mapInArrow(run, f"key string, item {kind}, coverage double, n_tiles int")


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    coverage: float = COVERAGE,
) -> DataFrame:
    """Pairs ``id, item, coverage, n_tiles`` of documents and the items they contain.

    * Null and empty texts and items match nothing, and nor do items of fewer than
      ``SEED`` words, which any text may hold by chance. A null document id is an id like
      others; an item without an id is left out. Rows repeated with one id, in either
      table, give a pair its best coverage. Ties between tiles go to the earliest.
    * A very long text is held whole by the task that hashes it, but only the parts
      that share a run with an item are tiled.
    * Empty tables give an empty result; other columns are ignored, whatever their names.
    """
    ship(docs.sparkSession)
    items = benchmark.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("text"))
    items = written(_seeds(items.where("item is not null")).where("size(hashes) > 0").withColumn("row", F.monotonically_increasing_id()), "benchmark-seeds")
    seeds = items.select("row", F.size("words").alias("length"), F.explode(F.arrays_zip("hashes", "times")).alias("x")).select("row", "length", F.col("x.hashes").alias("hash"), "x.times")
    bits = seed_filter(seeds)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    hits = written(_hits(rows, bits), "seed-hits")
    # one document stands for all of equal words; ids return at the end
    texts = written(hits.groupBy("key").agg(F.first("hashes").alias("hashes"), F.count(F.lit(1)).alias("rows")), "seed-texts")
    met = texts.select("key", F.explode("hashes").alias("hash")).join(seeds, "hash").groupBy("key", "row", "length").agg(F.sum("times").alias("places"))
    # a tile of SEED words or more holds a seed for every SEED of its words, so fewer shared places cannot cover enough
    enough = written(met.where(F.col("places") * SEED >= F.col("length") * coverage).select("key", "row"), "seed-pairs")
    needed = hits.join(enough.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.first("words").alias("words"))
    pairs = enough.join(needed, "key").join(items.select("row", "item", F.col("words").alias("test")), "row")
    found = _tiled(pairs.select("key", "item", "words", "test")).where(F.col("coverage") >= coverage)
    best = found.groupBy("key", "item").agg(F.max(F.struct("coverage", "n_tiles")).alias("x"))
    listed = best.join(texts.select("key", "rows"), "key").groupBy("key").agg(F.first("rows").alias("rows"), F.collect_list(F.struct("item", "x")).alias("found"))
    listed = written(listed, "contaminated-texts")
    each = join_groups(hits.select("id", "key"), listed, "key", "rows", hits.count(), "inner").select("id", F.explode("found").alias("f"))
    out = each.groupBy("id", F.col("f.item").alias("item")).agg(F.max("f.x").alias("x"))
    return out.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "x.coverage", "x.n_tiles")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without documents that contain a benchmark item; columns unchanged, whatever their names.

    A document goes with all rows of its id; null is an id of its own. Null and empty texts stay.
    """
    inner, (key, text) = plain_names(docs, id_col, text_col)
    lost = written(contaminated(inner, benchmark, key, text).select(F.col(key).alias("_lost")).distinct(), "contaminated")
    return inner.join(lost, F.col(key).eqNullSafe(F.col("_lost")), "left_anti").toDF(*docs.columns)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
