r"""SimHash near-duplicates by the generalised pigeonhole principle.

A text's fingerprint is the majority of the XXH64 hashes of its word shingles. To find
fingerprints within ``radius`` bits, the 64 bit positions are split into m partitions and
partition i gets a threshold t_i with sum(t_i + 1) = radius + 1: two fingerprints that
differ by more than t_i bits in every partition differ by more than ``radius``. Bits that
go together share a partition; the thresholds are unequal, from dynamic programming over
the candidates and probes that each would cost. One side stores its partition values, the
other probes all values within t_i, and a pair is verified inside the join.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from .common import by_shuffle, written
from .components import components

BITS = 64
RADIUS = 4
SEED = 42
#: Weight of a candidate pair against a probe in the cost of a plan.
CANDIDATE_COST = 4.0
#: Words of a text that are hashed at once, to bound memory on long texts.
CHUNK = 200_000

_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: str | None, width: int) -> int:
    """The 64-bit majority fingerprint of ``width``-word shingles, repeats included."""
    words = _WORD.findall((text or "").encode("utf-8", "surrogatepass").translate(_LOWER))
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) < width:
        return digest(b" ".join(words), SEED)
    n = len(words) - width + 1
    counts = np.zeros(BITS, np.int64)
    for low in range(0, n, CHUNK):
        high = min(n, low + CHUNK)
        runs = zip(*(words[low + k : high + k] for k in range(width)))
        hashes = np.fromiter((digest(b" ".join(r), SEED) for r in runs), np.uint64, high - low)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5) -> DataFrame:
    """``(id, fp)`` for each row; ``fp`` is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t.as_py(), width) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["id", "fp"])

    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, fp long")


def bit_moments(fps: DataFrame) -> tuple[int, np.ndarray]:
    """The number of fingerprints and, for each two bits, in how many both are set."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, both = 0, np.zeros((BITS, BITS))
        for f in frames:
            bits = np.unpackbits(f["fp"].to_numpy(np.int64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            n += len(f)
            both += bits.T @ bits
        if n:
            yield pd.DataFrame({"cell": np.arange(-1, BITS * BITS), "n": np.r_[n, both.ravel()].astype(np.int64)})

    sums = fps.select("fp").mapInPandas(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    flat = np.zeros(BITS * BITS + 1)
    for row in sums:
        flat[row["cell"] + 1] = row["n"]
    return int(flat[0]), flat[1:].reshape(BITS, BITS)


@dataclass(frozen=True)
class Plan:
    """Bit positions and threshold of each partition that is probed."""

    partitions: tuple[tuple[tuple[int, ...], int], ...]
    cost: float


def group_bits(both: np.ndarray, n: int, m: int) -> list[tuple[int, ...]]:
    """Split the bits into ``m`` groups of nearly equal size, correlated ones together.

    Each group starts from the bit least tied to those already placed and takes the
    free bit with the largest sum of absolute correlations to its members, in turn.
    """
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.clip(p * (1 - p), 1e-9, None))
    tie = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    free, groups = list(range(BITS)), []
    for k in range(m):
        size = (BITS + k) // m
        placed = [b for b in range(BITS) if b not in free]
        group = [min(free, key=lambda b: (tie[b, placed].sum(), b))]
        free.remove(group[0])
        while len(group) < size:
            group.append(max(free, key=lambda b: (tie[b, group].sum(), -b)))
            free.remove(group[-1])
        groups.append(tuple(sorted(group)))
    return groups


def choose_plan(
    n: int, both: np.ndarray, radius: int, pairs: float | None = None, candidate_cost: float = CANDIDATE_COST, probe_cost: float = 1.0
) -> Plan:
    """The cheapest partitions and thresholds for ``n`` fingerprints.

    A partition's expected candidates come from the chance that each of its bits
    differs between two fingerprints; its probes from the values within the threshold.
    ``pairs`` is how many pairs can meet at all, by default every pair.
    """
    n = max(n, 1)  # an empty table costs nothing whatever the probes, and would get the plan with most of them
    pairs = n * n / 2 if pairs is None else pairs
    p = np.diag(both) / max(n, 1)
    differ = np.clip(2 * p * (1 - p), 1e-3, 0.5)
    best = None
    for m in range(min(2, radius + 1), radius + 2):
        groups = group_bits(both, n, m)
        costs = []
        for g in groups:
            chance = np.zeros(radius + 2)
            chance[0] = 1.0
            for b in g:  # distribution of the number of differing bits, as far as radius
                chance[1:] = chance[1:] * (1 - differ[b]) + chance[:-1] * differ[b]
                chance[0] *= 1 - differ[b]
            within = np.cumsum(chance[: radius + 1])
            probes = np.cumsum([comb(len(g), j) for j in range(radius + 1)])
            costs.append([0.0, *(candidate_cost * pairs * within + probe_cost * n * probes)])  # [u]: threshold u - 1
        total, choice = {0: 0.0}, {0: ()}
        for row in costs:
            step, kept = {}, {}
            for used, cost in total.items():
                for u in range(radius + 2 - used):
                    if (c := cost + row[u]) < step.get(used + u, np.inf):
                        step[used + u], kept[used + u] = c, (*choice[used], u)
            total, choice = step, kept
        cost = total[radius + 1]
        if best is None or cost < best.cost:
            best = Plan(tuple((g, u - 1) for g, u in zip(groups, choice[radius + 1]) if u), cost)
    return best


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def _probe(flips: Column, part: Column, k: int) -> Column:
    return F.transform(flips, lambda f: F.struct(F.lit(k).alias("k"), part.bitwiseXOR(f).alias("key")))


def _stars(stored: DataFrame, radius: int) -> DataFrame:
    """Pairs of a fingerprint and the first that shares a partition value: one pair a member."""
    first = stored.groupBy("k", "key").agg(F.min(F.struct("a", "fa")).alias("first"), F.count(F.lit(1)).alias("members")).where("members > 1")
    near = F.bit_count(F.col("fa").bitwiseXOR(F.col("first.fa"))) <= radius
    met = stored.join(by_shuffle(first), ["k", "key"]).where(near & (F.col("a") != F.col("first.a")))
    return met.select(F.col("first.a").alias("a"), F.col("a").alias("b")).distinct()


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Pairs ``(a, b)`` of ids of distinct fingerprints at most ``radius`` bits apart.

    ``fps(id, fp)`` holds each fingerprint once. The pairs have the same components as all
    pairs within the radius: dense groups are linked by stars first, and then only pairs of
    two components are emitted. A pair is verified inside the join, so candidates never
    leave it; partitions that many fingerprints share are split by the skew join.
    """
    n, both = bit_moments(fps)
    plan = choose_plan(n, both, radius)
    keys, masks = [], []
    for k, (bits, t) in enumerate(plan.partitions):
        own = _signed(sum(1 << b for b in bits))
        flips = [_signed(sum(1 << b for b in c)) for j in range(t + 1) for c in combinations(bits, j)]
        part = F.col("fp").bitwiseAND(F.lit(own).cast("long"))
        keys.append(F.array(F.struct(F.lit(k).alias("k"), part.alias("key"))))
        probes = F.array(*[F.lit(x).cast("long") for x in flips])
        masks.append(_probe(probes, part, k))
    exploded = fps.select(F.col("id").alias("a"), F.col("fp").alias("fa"), F.explode(F.concat(*keys)).alias("x")).select("a", "fa", "x.k", "x.key")
    stars = written(_stars(exploded, radius), "simhash-stars")
    grouped = components(stars)
    fps = written(fps.join(grouped, fps["id"] == grouped["node"], "left").select("id", "fp", F.coalesce("component", "id").alias("comp")), "simhash-nodes")
    stored = fps.select(F.col("id").alias("a"), F.col("fp").alias("fa"), F.col("comp").alias("ca"), F.explode(F.concat(*keys)).alias("x")).select("a", "fa", "ca", "x.k", "x.key")
    probed = fps.select(F.col("id").alias("b"), F.col("fp").alias("fb"), F.col("comp").alias("cb"), F.explode(F.concat(*masks)).alias("x"))
    probed = probed.select("b", "fb", "cb", F.col("x.k").alias("pk"), F.col("x.key").alias("pkey"))
    near = F.bit_count(F.col("fa").bitwiseXOR(F.col("fb"))) <= radius
    match = (F.col("k") == F.col("pk")) & (F.col("key") == F.col("pkey")) & (F.col("fa") < F.col("fb")) & (F.col("ca") != F.col("cb")) & near
    return stored.join(by_shuffle(probed), match).select("a", "b").distinct().unionByName(stars)


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, radius: int = RADIUS
) -> DataFrame:
    """One row for each row of ``docs``: id, ``fp``, ``component_id`` (its smallest id).

    * A null, empty or wordless text has fingerprint zero, linked like any other; a text
      of fewer than ``width`` words is one shingle.
    * Rows with one fingerprint are one node, so copies are never paired. Rows repeated
      with one id stay separate rows. A row with a null id keeps its fingerprint, and its
      component is that of the rows it is linked to, or null.
    * An empty table gives an empty result; other columns of ``docs`` are ignored.
    """
    marked = written(fingerprints(docs, id_col, text_col, width), "fingerprints")
    nodes = written(marked.groupBy("fp").agg(F.min("id").alias("id")).where("id is not null"), "nodes")
    grouped = components(links(nodes, radius))
    labels = nodes.join(grouped, nodes["id"] == grouped["node"], "left").select(
        F.col("fp").alias("_fp"), F.coalesce("component", "id").alias("component_id")
    )
    out = marked.join(labels, marked["fp"] == labels["_fp"], "left")
    return out.select(F.col("id").alias(id_col), "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, radius: int = RADIUS) -> DataFrame:
    """``docs`` with the smallest id of each component only; columns unchanged, whatever their names.

    Rows with a null id stay, and so do rows repeated with the id that stays.
    """
    found = near_duplicates(docs.select(id_col, text_col), id_col, text_col, width, radius)
    lost = found.where(F.col("component_id") != F.col(id_col)).select(id_col).distinct()
    return docs.join(lost, id_col, "left_anti").select(*docs.columns)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=4)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
