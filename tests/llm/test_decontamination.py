"""Greedy tiles against a plain search, and decontamination against tiling every pair."""

import random
import time

import numpy as np
from pyspark.sql import functions as F

from glyphloom.llm import decontamination as dec

SF = "/root/testdata/sf0.001"


def plain_tiles(doc, item, least):
    """The longest common unmarked run, earliest in the item and then in the document, again and again."""
    free_d, free_i, out = [True] * len(doc), [True] * len(item), []
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for d in range(len(doc)):
                n = 0
                while i + n < len(item) and d + n < len(doc) and free_i[i + n] and free_d[d + n] and item[i + n] == doc[d + n]:
                    n += 1
                if n > best[0]:
                    best = (n, d, i)
        n, d, i = best
        if n < least:
            return out
        free_d[d : d + n] = free_i[i : i + n] = [False] * n
        out.append((d, i, n))


def test_tiles_by_plain_search():
    rng = random.Random(8)
    for _ in range(150):
        letters = rng.choice([1, 2, 3, 12])
        doc = np.array([rng.randrange(letters) for _ in range(rng.randrange(40))], np.int64)
        item = np.array([rng.randrange(letters) for _ in range(rng.randrange(1, 25))], np.int64)
        least = rng.choice([1, 2, 3, 5])
        assert dec.tiles(doc, item, least) == plain_tiles(doc.tolist(), item.tolist(), least)


def test_one_word_over_and_over_is_not_square():
    start = time.monotonic()
    assert sum(t[2] for t in dec.tiles(np.zeros(200_000, np.int64), np.zeros(300, np.int64))) == 300
    assert time.monotonic() - start < 5


def test_query_by_tiling_every_pair(spark):
    docs = [(r["doc_id"], dec.words(r["text"])) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r["item_id"], dec.words(r["text"])) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    wanted = {}
    for d, doc in docs:
        for i, item in items:
            if len(item) >= dec.SEED and (found := dec.tiles(doc, item)):
                covered = sum(t[2] for t in found) / len(item)
                if covered >= dec.COVERAGE:
                    wanted[d, i] = (covered, len(found))
    got = {(r["doc_id"], r["item_id"]): (r["coverage"], r["n_tiles"]) for r in dec.op9_decontamination(spark, SF).collect()}
    assert got == wanted and wanted


def test_odd_rows(spark):
    item = " ".join(f"w{i}" for i in range(30))
    rows = [(None, item), (1, item), (1, "short"), (2, None), (3, ""), (4, "w1 " * 3000), (5, item), (5, item)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"_lost": F.lit(1), "key": F.lit("k"), "item": F.lit(0)})
    bench = spark.createDataFrame([(7, item), (7, "other words of the same item here"), (None, item), (8, "too short"), (9, None)], "item_id long, text string")
    got = sorted((r["doc_id"] or -1, r["item_id"], r["coverage"]) for r in dec.contaminated(docs, bench).collect())
    assert got == [(-1, 7, 1.0), (1, 7, 1.0), (5, 7, 1.0)]
    kept = dec.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [2, 3, 4]
    assert dec.contaminated(docs, bench.limit(0)).count() == 0 and dec.drop_contaminated(docs.limit(0), bench).count() == 0
