"""Joins of exploded rows: Spark sizes them too low and would send them to the driver."""

import re

from glyphloom.llm import common, near_copies, simhash


def joins(df):
    return re.findall(r"(\w+Join) ", df._jdf.queryExecution().sparkPlan().toString())


def test_pigeonhole_candidates_are_not_broadcast(spark):
    rows = [(i, (i + 1) * 0x9E3779B97F4A7C1 % (1 << 63)) for i in range(50)] + [(50, 0), (51, 1)]
    pairs = simhash.links(common.written(spark.createDataFrame(rows, "id long, fp long"), "fps"))
    assert joins(pairs) == ["SortMergeJoin"]
    assert (50, 51) in {tuple(sorted(r)) for r in pairs.collect()}


def test_buckets_are_not_broadcast(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(near_copies, "written", lambda df, label: seen.append(df) or common.written(df, label))
    monkeypatch.setattr(near_copies, "_screened", lambda pairs, nodes, similarity: pairs)
    rows = [(i, 0, 5, 0, 0, 0, [0] * 16, [i // 2, 100 + i // 3], i // 4) for i in range(12)]
    nodes = common.written(spark.createDataFrame(rows, "sig long, fp long, n long, s0 long, s1 long, level int, odd array<long>, bands array<long>, comp long"), "nodes")
    assert joins(near_copies._star_pairs(nodes, 0.8)) == ["SortMergeJoin"]
    assert "SortMergeJoin" in joins(near_copies._retry_pairs(nodes, 0.8, 0))
    monkeypatch.setattr(near_copies, "discard", lambda *tables: None)
    near_copies._open_pairs(nodes, 0.8)
    # the buckets' largest components by key, then the buckets by key
    assert joins(seen[0]).count("SortMergeJoin") == 1 and joins(seen[1]).count("SortMergeJoin") == 1
