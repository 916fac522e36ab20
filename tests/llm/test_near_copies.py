"""The pipeline's near-copy stage against brute force over shingle sets."""

import random

import corpus_pipeline
import numpy as np
from glyphloom.llm import common, near_copies

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def planted(seed=5, bases=120):
    """Texts beside copies with one to seven of 120 words changed: similarities from about 0.5 to 0.96."""
    rng, texts = random.Random(seed), []
    for _ in range(bases):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([60, 120, 400]))]
        texts.append(" ".join(words))
        for share in (0.01, 0.02, 0.03):
            copy = [f"z{rng.randrange(5000)}" if rng.random() < share else w for w in words]
            texts.append(" ".join(copy))
    return texts


def similar(texts, at):
    sets = [set(near_copies.shingle_set(t, 5).tolist()) for t in texts]
    return [(i, j) for i in range(len(texts)) for j in range(i) if len(sets[i] & sets[j]) >= at * len(sets[i] | sets[j])]


def components(n, pairs):
    least = list(range(n))

    def root(i):
        while least[i] != i:
            i = least[i]
        return i

    for a, b in pairs:
        a, b = root(a), root(b)
        least[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def test_near_stage_links_pairs_of_similarity_and_no_others(spark):
    texts = planted()
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA)
    pairs = similar(texts, 0.8)
    got = {r["doc_id"]: r["component_id"] for r in near_copies.near_copies(docs).collect()}
    met = sum(got[a] == got[b] for a, b in pairs)
    print(f"pairs at 0.8 or more: {len(pairs)}, in one component: {met}")
    assert len(pairs) > 100 and met >= 0.98 * len(pairs)
    # nothing is linked that no chain of near copies links
    exact = components(len(texts), pairs)
    assert all(exact[d] == exact[c] for d, c in got.items())


def test_pipeline_stage_keeps_what_only_shares_a_fingerprint(spark):
    """A line repeated many times decides the old fingerprint; copies of 0.8 are dropped."""
    line = "one two three four five six seven " * 200
    words = [f"w{i}" for i in range(200)]
    changed = [w if i % 50 != 25 else "x" for i, w in enumerate(words)]
    texts = [line + " ".join(f"{k}{i}" for i in range(60)) for k in "ab"] + [None, "", "a b", "a  B", " ".join(words), " ".join(changed)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA)
    assert [r["doc_id"] for r in corpus_pipeline.near(spark, docs, "").orderBy("doc_id").collect()] == [0, 1, 2, 4, 6]


def test_empty_table(spark):
    assert near_copies.near_copies(spark.createDataFrame([], SCHEMA)).count() == 0


def test_radius_covers_the_similarity():
    assert near_copies.radius_for(0.8, 0.5) in (9, 10) and near_copies.radius_for(0.8) >= 16


def test_dense_group_of_near_copies(spark):
    """Three hundred copies of one text, each with its own changes: one component, whatever is the least."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(f"y{rng.randrange(9999)}" if rng.random() < 0.012 else w for w in words) for _ in range(300)]
    texts += [" ".join(f"u{rng.randrange(9999)}" for _ in range(200)) for _ in range(50)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA)
    exact = components(len(texts), similar(texts, 0.8))
    got = {r["doc_id"]: r["component_id"] for r in near_copies.near_copies(docs).collect()}
    assert sum(got[d] != exact[d] for d in got) <= 1


def test_odd_sketches_screen_by_difference():
    """At level 0 no more bits differ than shingles; a level's sample is ODD_SHINGLES at most, on average."""
    rng = np.random.default_rng(2)
    for n in (1, 255, 256, 257, 5000):
        a = np.unique(rng.integers(0, 1 << 63, n, np.uint64) << np.uint64(1))
        level, odd = near_copies.odd_sketches(a)
        assert n / 2**level <= near_copies.ODD_SHINGLES and len(odd) == 2 * near_copies.ODD_BITS // 64
        b = np.sort(np.r_[a[n // 10 :], rng.integers(0, 1 << 63, n // 10, np.uint64)])
        if level == 0:
            other = near_copies.odd_sketches(b)[1]
            words = near_copies.ODD_BITS // 64
            assert sum(int(x ^ y).bit_count() for x, y in zip(odd[:words].view(np.uint64), other[:words].view(np.uint64))) <= 2 * (n // 10)


def test_turns_link_a_group_whose_members_are_not_all_alike(spark):
    """Copies of one text whose changes put many pairs of them below the similarity: the components of brute force."""
    rng = random.Random(11)
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(f"y{rng.randrange(9999)}" if rng.random() < rng.choice([0.005, 0.02, 0.03]) else w for w in words) for _ in range(200)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA)
    pairs = similar(texts, 0.8)
    assert len(pairs) < 0.9 * 200 * 199 / 2
    exact = components(len(texts), pairs)
    got = {r["doc_id"]: r["component_id"] for r in near_copies.near_copies(docs).collect()}
    assert sum(got[d] != exact[d] for d in got) <= 2


def _leftovers(spark):
    """Shuffle files, and folders of intermediate tables by label."""
    import re
    from collections import Counter
    from pathlib import Path

    local = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    shuffles = sum(1 for d in local for f in Path(d).rglob("shuffle_*"))
    shared = Path(common.shared_dir(spark).removeprefix("file:"))
    return shuffles, Counter(re.sub(r"-[0-9a-f]{32}$", "", p.name) for p in shared.iterdir())


def test_turns_leave_no_shuffles_and_no_tables_behind(spark):
    """Each turn's tables and shuffle files go when it ends: on many partitions they outgrew the input."""
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(planted(bases=20))], SCHEMA)
    shuffles, tables = _leftovers(spark)
    found = near_copies.near_copies(docs)
    after, left = _leftovers(spark)
    left -= tables
    assert after <= shuffles + 12  # of jobs that count and look, not of those that write
    assert not left.keys() & {"near-pairs", "near-needed", "near-sets", "near-buckets", "near-edges"}, left
    assert left["near-nodes"] == 1 and left["edges"] <= 2
    assert found.count() == 80
