"""Mixing: targets by water filling, words by count, and a large corpus with tiny sources."""

import random
import re

import pytest
from pyspark.sql import functions as F

from glyphloom.llm import mixing


def test_tiny_sources_meet_their_targets_in_a_large_corpus(spark):
    """60 million words make blocks of 512; sources of 60 and 30 words are still taken three times."""
    large = spark.range(600).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), 100_000).alias("text"), F.lit("a").alias("source"))
    tiny = spark.createDataFrame([(1000 + i, "w " * 10, "b" if i < 6 else None) for i in range(9)], "doc_id long, text string, source string")
    found = mixing.mix(large.unionByName(tiny)).groupBy("source_size").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    got = {r["source_size"]: (r["taken"], r["target"]) for r in found}
    assert got[60] == (180, 180) and got[30] == (90, 90)
    assert abs(got[60_000_000][0] - got[60_000_000][1]) <= 0.001 * got[60_000_000][1]


def water_filled(sizes, weights=(1, 2, 3), most=3):
    """Targets of sources in order, by cutting one source after the other until none is above its limit."""
    weight = {s: weights[i % len(weights)] for i, s in enumerate(sizes)}
    left, open_, target = sum(sizes.values()), set(sizes), {}
    while open_:
        share = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if weight[s] * share > most * sizes[s]]
        if not over:
            return target | {s: weight[s] * share for s in open_}
        target |= {s: most * sizes[s] for s in over}
        left -= sum(most * sizes[s] for s in over)
        open_ -= set(over)
    return target


@pytest.mark.parametrize("seed", range(3))
def test_targets_by_water_filling_and_words_by_count(spark, seed):
    rng = random.Random(seed)
    names = ["", "a", "b", "Z", "é", "web/x", "漢", None][: 3 + 2 * seed + 1]
    docs, at = [], 0
    for name in names:
        for _ in range(rng.choice([1, 3, 40])):
            docs.append((at, rng.choice([None, "", " ".join(["w"] * rng.randrange(1, 400)), "x\ty\x0bz  "]), name, 5))
            at += 1
    docs += docs[:2]  # repeated rows
    table = spark.createDataFrame(docs, "doc_id long, text string, source string, target int")
    found = mixing.mix(table.drop("target")).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = {}
    for name in sorted({d[2] for d in docs}, key=lambda s: (s is None, (s or "").encode())):
        sizes[name] = sum(size(t) for _, t, s, _ in docs if s == name)
    wanted = water_filled(sizes)
    assert len(found) == len(docs)
    by_source = {}
    for r in found:
        name = next(d[2] for d in docs if d[0] == r["doc_id"])
        assert r["size"] == size(next(d[1] for d in docs if d[0] == r["doc_id"])) and r["source_size"] == sizes[name]
        assert 0 <= r["taken"] <= 3 * r["size"] and abs(r["target"] - wanted[name]) < 1e-6 * max(1, wanted[name])
        by_source[name] = by_source.get(name, 0) + r["taken"]
    assert all(abs(by_source[s] - wanted[s]) <= max(2, 0.02 * wanted[s]) for s in sizes)
    again = mixing.mix(table.drop("target").repartition(3)).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in again) == sorted((r["doc_id"], r["taken"]) for r in found)
