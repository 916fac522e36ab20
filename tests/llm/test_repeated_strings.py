"""Removal of repeated strings against a search of every string, for tables with all kinds of odd rows."""

import hashlib
import random

import pytest

from glyphloom.llm import repeated_strings


def brute(rows, length):
    """Each row's kept bytes and spans; rows of one id follow the digest of their text, null ids come last."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, hashlib.sha256((rows[i][1] or "").encode()).hexdigest()))
    seen, out = set(), []
    for i in order:
        data = (rows[i][1] or "").encode()
        gone = bytearray(len(data))
        for a in range(len(data) - length + 1):
            if (s := data[a : a + length]) in seen:
                gone[a : a + length] = b"\1" * length
            seen.add(s)
        spans, at = [], 0
        while (a := gone.find(1, at)) >= 0:
            at = gone.find(0, a)
            at = len(data) if at < 0 else at
            spans.append((a, at))
        out.append((rows[i][0], len(data), spans, bytes(b for b, g in zip(data, gone) if not g)))
    return sorted(out, key=repr)


def found(spark, rows, length):
    df = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], "doc_id long, text string, key string, spans int, _key string").repartition(5)
    out = repeated_strings.repeated_strings(df, length, with_kept=True).collect()
    assert all(hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] for r in out)
    return sorted(((r["doc_id"], r["n_bytes"], [tuple(s) for s in r["spans"]], bytes(r["kept"])) for r in out), key=repr)


def passages(rng, n):
    return ["".join(rng.choice("abcdeé ") for _ in range(rng.randrange(20, 260))) for _ in range(n)]


@pytest.mark.parametrize("length", [38, 100])
def test_same_bytes_as_brute_force(spark, length):
    rng = random.Random(length)
    parts = passages(rng, 14)
    rows = [(i, "".join(rng.choices(parts, k=rng.randrange(5))) + "".join(rng.choice("abc") for _ in range(rng.randrange(200)))) for i in range(60)]
    rows += [(100, "ab" * 300), (101, "a" * 5000), (102, None), (103, ""), (104, parts[0][:37]), (105, rows[3][1]), (106, rows[3][1])]
    assert found(spark, rows, length) == brute(rows, length)


def test_repeated_and_null_ids(spark):
    rng = random.Random(9)
    parts = passages(rng, 6)
    rows = [(i % 4 if i % 5 else None, rng.choice(parts) + rng.choice(parts)) for i in range(30)] + [(2, None), (None, None), (2, parts[0]), (2, parts[0])]
    assert found(spark, rows, 60) == brute(rows, 60)


def test_hot_passage_and_boundaries(spark):
    line = "one line that a third of all documents share, with exactly one hundred and some more bytes in it, or so it is."
    rows = [(i, (line if i % 3 == 0 else "") + f" {i:05d} " * 20 + (line[:99] if i % 7 == 0 else "")) for i in range(400)]
    rows += [(1000, line[:50]), (1001, line[50:])]  # nothing crosses documents
    assert found(spark, rows, 100) == brute(rows, 100)


def test_empty_table(spark):
    assert found(spark, [], 100) == []
    with pytest.raises(ValueError):
        repeated_strings.repeated_strings(spark.createDataFrame([], "doc_id long, text string"), 20)
