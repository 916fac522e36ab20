"""Ranked search against scores summed term by term."""

import math
import random
import re
from collections import Counter

from glyphloom.llm import impact_index

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    lower = "".join(c.lower() if c.isascii() else c for c in text or "")
    return TERM.findall(lower)


def brute(docs, items, k):
    held = [(i, Counter(terms(t))) for i, t in docs]
    n = sum(bool(c) for _, c in held)
    total = sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in held:
            m = total and 50 + 50 * c.total() * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in dict.fromkeys(terms(text)) if c[t])
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(item, r, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def ranked(spark, docs, items, k, **size):
    ds = spark.createDataFrame([(i, t, 1, 2, b"x") for i, t in docs], "doc_id long, text string, score long, term int, bits binary")
    its = spark.createDataFrame([(i, t, 7) for i, t in items], "item_id long, text string, q long")
    index = impact_index.build_index(ds.repartition(3), **size)
    return sorted(map(tuple, impact_index.search(index, its, k).collect()), key=repr)


def corpus(n, seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)] + ["Straße", "ÄÖ", "naïve", "x_y", "A1", "漢字", "\U0001f600a"]
    return [(i, " ".join(rng.choices(words, weights=[1 / (j + 1) for j in range(len(words))], k=rng.randrange(0, 60)))) for i in range(n)]


def test_same_ranks_as_brute_force(spark):
    docs = corpus(300, 1) + [(None, "w0 w1 w1 Straße"), (300, None), (301, ""), (302, "._-"), (303, "w3 " * 50_000 + "long")]
    docs += [(7, docs[7][1]), (400, docs[7][1]), (401, docs[7][1])]  # repeated rows and ties
    items = [(1, "W0 w1 W1 straße"), (2, "nothing-known here"), (3, None), (4, ""), (5, "ÄÖ äö 漢字 A1 a1"), (6, " ".join(f"w{i}" for i in range(40))), (7, "long w3")]
    wanted = brute(docs, items, 20)
    assert ranked(spark, docs, items, 20) == wanted
    assert ranked(spark, docs, items, 20, block_docs=16) == wanted  # ties across blocks
    assert ranked(spark, docs, [*items, items[0]], 20) == wanted  # a repeated item is one


def test_empty_tables(spark):
    assert ranked(spark, [], [(1, "a")], 5) == []
    assert ranked(spark, [(1, None), (2, "--")], [(1, "a")], 5) == []
    assert ranked(spark, [(1, "a b")], [], 5) == []
    assert ranked(spark, [(1, "a b"), (2, "c")], [(1, "a")], 5) == brute([(1, "a b"), (2, "c")], [(1, "a")], 5)


def test_bitwise_sums_and_best():
    rng = random.Random(2)
    for _ in range(200):
        sums, planes = [0] * 30, []
        for _ in range(rng.randrange(6)):
            values, shift = [rng.choice([0, rng.randrange(2**20)]) for _ in sums], rng.randrange(4)
            impact_index.add_planes(planes, [sum((v >> b & 1) << i for i, v in enumerate(values)) for b in range(20)], shift)
            sums = [a + (v << shift) for a, v in zip(sums, values)]
        assert [sum((p >> i & 1) << b for b, p in enumerate(planes)) for i in range(30)] == sums
        k = rng.randrange(1, 12)
        best = impact_index.best(planes, k)
        wanted = sorted(sorted(i for i in range(30) if sums[i]), key=lambda i: -sums[i])[:k]
        assert {i for i in range(30) if best >> i & 1} == set(wanted)
