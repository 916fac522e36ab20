"""The prefix trie against one built by following every prefix."""

import hashlib
import random
import zlib

from glyphloom.llm import prefix_trie
from glyphloom.llm.common import written

KIND = "conv_id long, turn long, role string, text string, depth int, ka string, base string"


def brute(rows):
    """Nodes of the rebuilt conversations, by plain sets of members."""
    turns = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            turns.setdefault(conv, []).append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [t[1:] for t in sorted(ts)] for c, ts in turns.items()}
    rebuilt = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        rebuilt[c] = tuple(own.get(c - c % 100, [])[:h] + own[c][h:])
    members = {}
    for c, path in rebuilt.items():
        for d in range(len(path) + 1):
            members.setdefault(path[:d], set()).add(c)
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    out = set()
    for node, held in members.items():
        below = [n for n in members if n[: len(node)] == node]
        ends = ",".join(str(c) for c in sorted(held) if len(rebuilt[c]) == len(node))
        saved = sum((len(members[n]) - 1) * len(n[-1][1]) for n in below if n)
        parent = min(members[node[:-1]]) if node else None
        leaves = sum(n not in children for n in below)
        out.add((min(held), len(node), parent, len(held), len(children.get(node, [])), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def nodes(spark, rows):
    df = spark.createDataFrame([(*r, 3, "x", "y") for r in rows], KIND)
    found = prefix_trie.prefix_trie(*prefix_trie.shared_heads(written(prefix_trie.ordered_turns(df), "turns")))
    return sorted(map(tuple, found.collect()), key=repr)


def test_same_nodes_as_brute_force(spark):
    rng, rows = random.Random(4), []
    for conv in [*range(100, 140), *range(205, 225), 300, 7]:  # 200 and 0 are not there: blocks without a first conversation
        n = 0 if conv == 7 else rng.randrange(1, 9)
        rows += [(conv, rng.choice([None, *range(9)]) if conv == 300 else i, rng.choice(["user", "bot", None]), rng.choice(["a", "bb", "", None])) for i in range(n)]
    rows += [(7, 0, "user", "x" * 100_000), (None, 1, "user", "lost"), (301, 5, "user", "same"), (301, 5, "user", "same")]
    # equal numbers with different turns have an order of their own, so turns of one number are equal here
    rows = [r for r in rows if r[0] != 300] + [(300, None, "user", "first"), (300, 2, None, None)]
    assert nodes(spark, rows) == sorted(brute(rows), key=repr)


def test_hot_first_turn_and_long_paths(spark):
    rows = [(c, i, "user", f"{i if i < 3 else c % 7}") for c in range(1, 600) for i in range(1 + c % 12)]
    rows += [(1000, i, "user", "deep") for i in range(300)]
    assert nodes(spark, rows) == sorted(brute(rows), key=repr)


def test_repeated_and_empty_tables(spark):
    assert nodes(spark, []) == []
    assert nodes(spark, [(None, 1, "a", "b")]) == []
    twice = [(100, 1, "u", "t"), (100, 1, "u", "t")]
    assert nodes(spark, twice) == sorted(brute(twice), key=repr)
