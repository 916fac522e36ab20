"""Near copies of a similarity or more, for the pipeline.

Two texts are near copies when the Jaccard similarity of their sets of word shingles is at
least ``similarity``. Candidates come from two searches over SimHash fingerprints of the sets:

* the generalised pigeonhole search of ``simhash`` finds all fingerprints a few bits apart;
* pairs near the similarity differ by ten bits and more of 64, where partitions would be
  three bits wide and meet nearly every pair. These pairs meet in buckets of least shingle
  hashes instead, BANDS of ROWS hashes each, and pass if their fingerprints, and sketches of
  one bit of each least hash, lie within the radii that the similarity implies.

Each candidate is verified on the whole sets in a join before it links. Large groups are
linked by stars first: each bucket's members to its first. Then only pairs that no star has
brought into one component are compared, after turns in which each set left outside tries
another member of the largest component it meets.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count
from math import acos, comb, pi

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .common import by_shuffle, discard, join_groups, written
from .components import components
from .simhash import _LOWER, _WORD, BITS, RADIUS, SEED, links

SIMILARITY = 0.8
#: Share of the pairs at exactly the similarity that the radius has to cover.
RECALL = 0.999
#: A pair of similarity J shares a bucket with the chance 1 - (1 - J ** ROWS) ** BANDS: 0.9997 at 0.8.
BANDS, ROWS = 20, 5
#: Shingles whose permuted hashes are held at once.
BLOCK = 4_096
#: Bits of an odd sketch, the sampled shingles that it takes at most, and deviations that its screen allows.
ODD_BITS = 512
ODD_SHINGLES = 256
ODD_SLACK = 4.0
#: Turns of stars go on while one links at least this share of the sets it tried.
TURN_GAIN = 0.25
#: Up to so many sets (8 bytes each) are told to the scan that reads them; more are joined by shuffle.
FEW_SETS = 2_000_000
#: Sets of so many shingles in all (8 bytes each) are broadcast to their pairs; of more the hubs only.
FEW_SHINGLES = 1_000_000


def _covering(bits: int, p: float, recall: float) -> int:
    """The smallest radius that covers ``recall`` of the pairs whose bits differ with the chance ``p`` each."""
    covered = 0.0
    for radius in range(bits + 1):
        covered += comb(bits, radius) * p**radius * (1 - p) ** (bits - radius)
        if covered >= recall:
            return radius
    return bits


def radius_for(similarity: float, recall: float = RECALL) -> int:
    """The fingerprints' radius: sets of equal size at Jaccard J have the cosine
    c = 2 J / (1 + J), and each of the bits differs with the chance acos(c) / pi."""
    return _covering(BITS, acos(2 * similarity / (1 + similarity)) / pi, recall)


def sketch_radius(similarity: float, recall: float = RECALL) -> int:
    """The sketches' radius: least hashes agree with the chance J, and their bits in half of the other cases."""
    return _covering(BANDS * ROWS, (1 - similarity) / 2, recall)


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """The sorted hashes of a text's distinct shingles; a shorter text is one shingle."""
    words = _WORD.findall((text or "").encode("utf-8", "surrogatepass").translate(_LOWER))
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    runs = zip(*(words[k:] for k in range(width))) if len(words) >= width else [words]
    return np.array(sorted({digest(b" ".join(r), SEED) for r in runs}), np.uint64)


def signature(grams: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(grams.tobytes(), SEED)


def set_fingerprint(grams: np.ndarray) -> int:
    counts = np.zeros(BITS, np.int64)
    for low in range(0, len(grams), 65_536):
        bits = np.unpackbits(grams[low : low + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(grams), bitorder="little").view(np.uint64)[0])


def _permutations() -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(SEED)
    return tuple(draw.integers(0, 1 << 63, BANDS * ROWS, np.uint64) << np.uint64(1) | np.uint64(1) for _ in range(2))


def bands(grams: np.ndarray, mixers: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """One number for each band, a hash of the least values of its permutations, and the sketch as two numbers."""
    if not len(grams):
        return np.zeros(0, np.int64), np.zeros(2, np.int64)
    add, times = mixers
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for low in range(0, len(grams), BLOCK):
        part = grams[low : low + BLOCK, None] ^ add
        part *= times
        np.minimum(least, part.min(axis=0), out=least)
    digest = xxhash.xxh64_intdigest
    odd = np.zeros(128, bool)
    # the least values' low bits hang on one bit of the shingle; a product's middle bit hangs on many
    odd[: len(least)] = (least * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(63)
    keys = np.array([digest(r.tobytes(), k) for k, r in enumerate(least.reshape(BANDS, ROWS))], np.uint64)
    return keys.view(np.int64), np.packbits(odd, bitorder="little").view(np.int64)


def odd_sketches(grams: np.ndarray) -> tuple[int, np.ndarray]:
    """A set's level and its odd sketches at that level and the next.

    Level k takes the shingles whose hash ends in k zero bits, so ODD_SHINGLES at most, more
    or less. A bit is set if an odd number of them falls on it: of two sketches no more
    bits differ than shingles that one set only has.
    """
    level = max(0, (len(grams) - 1) // ODD_SHINGLES).bit_length()
    out = []
    for k in (level, level + 1):
        own = grams[grams & np.uint64((1 << k) - 1) == 0] >> np.uint64(48)
        out.append(np.packbits(np.bincount((own & np.uint64(ODD_BITS - 1)).astype(np.int64), minlength=ODD_BITS) & 1, bitorder="little").view(np.int64))
    return level, np.concatenate(out)


def _marks(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """``(id, sig, fp, n, s0, s1, level, odd, bands)`` for each row; equal sets have one ``sig``.

    The sets themselves take more room than the texts and few are compared, so they are made again where needed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixers = _permutations()
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                grams = [shingle_set(t.as_py(), width) for t in part.column(1)]
                sig = np.fromiter(map(signature, grams), np.uint64, len(grams))
                fp = np.fromiter(map(set_fingerprint, grams), np.uint64, len(grams))
                size = np.fromiter(map(len, grams), np.int64, len(grams))
                listed = lambda rows: pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(r) for r in rows])], pa.int32()), pa.array(np.concatenate(rows).view(np.int64)))
                keys, sketch = zip(*(bands(g, mixers) for g in grams))
                sketch = np.array(sketch)
                levels, odd = zip(*map(odd_sketches, grams))
                columns = [part.column(0), *map(pa.array, (sig.view(np.int64), fp.view(np.int64), size, sketch[:, 0], sketch[:, 1], np.array(levels, np.int32))), listed(odd), listed(keys)]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "sig", "fp", "n", "s0", "s1", "level", "odd", "bands"])

    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, f"id {kind}, sig long, fp long, n long, s0 long, s1 long, level int, odd array<bigint>, bands array<bigint>")


def _sets(texts: DataFrame, width: int) -> DataFrame:
    """``(sig, grams)`` for each row of ``texts(text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                grams = [shingle_set(t.as_py(), width) for t in batch.column(0).slice(low, 256)]
                sig = np.fromiter(map(signature, grams), np.uint64, len(grams))
                ends = pa.array(np.r_[0, np.cumsum([len(g) for g in grams])], pa.int32())
                sets = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(grams).view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(sig.view(np.int64)), sets], names=["sig", "grams"])

    return texts.mapInArrow(run, "sig long, grams array<bigint>")


def _distance(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def _may_link(a: str, b: str, similarity: float) -> Column:
    """Whether two nodes, structs of ``_NODE``'s columns, have near fingerprints and sketches and fitting sizes.

    Sets of the similarity differ by (1 - J) / (1 + J) of both sizes' sum at most, and so do
    their odd sketches at level 0; at a level k it is a sample of 2 ** -k of them.
    """
    low, high = F.least(f"{a}.n", f"{b}.n"), F.greatest(f"{a}.n", f"{b}.n")
    near = _distance(f"{a}.fp", f"{b}.fp") <= radius_for(similarity)
    alike = _distance(f"{a}.s0", f"{b}.s0") + _distance(f"{a}.s1", f"{b}.s1") <= sketch_radius(similarity)
    level = F.greatest(f"{a}.level", f"{b}.level")
    words = ODD_BITS // 64
    at = lambda x: F.slice(F.col(f"{x}.odd"), F.when(F.col(f"{x}.level") == level, 1).otherwise(words + 1), F.lit(words))
    differ = F.aggregate(F.zip_with(at(a), at(b), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    most = (F.col(f"{a}.n") + F.col(f"{b}.n")) * ((1 - similarity) / (1 + similarity)) / F.pow(F.lit(2.0), level)
    slack = F.when(level > 0, ODD_SLACK * F.sqrt(most) + 1).otherwise(0.0)
    fits = (low >= high * similarity - 1e-9) & (F.abs(F.col(f"{a}.level") - F.col(f"{b}.level")) <= 1)
    return fits & near & alike & (differ <= most + slack + 1e-6)


_NODE = ("fp", "n", "s0", "s1", "level", "odd")


def _screened(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """The pairs ``(a, b)`` that may link."""
    side = lambda name: nodes.select(F.col("sig").alias(name), F.struct(*_NODE).alias("x" + name))
    return pairs.join(side("a"), "a").join(side("b"), "b").where(_may_link("xa", "xb", similarity)).select("a", "b")


def _star_pairs(nodes: DataFrame, similarity: float) -> DataFrame:
    """Pairs of a node and the least of its buckets' first members: one pair a node, however large its buckets."""
    rows = nodes.select("sig", F.explode("bands").alias("key"))
    first = rows.groupBy("key").agg(F.min("sig").alias("a"), F.count(F.lit(1)).alias("members")).where("members > 1").drop("members")
    met = rows.join(by_shuffle(first), "key").where("a != sig").groupBy(F.col("sig").alias("b")).agg(F.min("a").alias("a"))
    return _screened(met, nodes, similarity)


def _close_pairs(nodes: DataFrame) -> DataFrame:
    """Pairs of sets whose fingerprints are at most RADIUS bits apart, by the pigeonhole search.

    Sets of one fingerprint stand behind the least of them, to which each is paired.
    """
    one = nodes.groupBy("fp").agg(F.min("sig").alias("id"), F.count(F.lit(1)).alias("members"))
    one = written(one, "near-fingerprints")
    shared = one.where("members > 1").select("fp", F.col("id").alias("a"))
    same = nodes.select("fp", F.col("sig").alias("b")).join(shared, "fp").where("a != b").select("a", "b")
    return links(one.select("id", "fp"), RADIUS).unionByName(same)


def _buckets(nodes: DataFrame) -> DataFrame:
    return nodes.select("sig", "comp", F.explode("bands").alias("key"))


def _retry_pairs(nodes: DataFrame, similarity: float, turn: int) -> DataFrame:
    """Pairs of a set and a member of the largest component of one of its buckets, where it lies outside.

    The members are drawn anew each turn, one a bucket; of a set's buckets the one whose member's
    sketch is nearest gives the pair, so there is one pair a set.
    """
    rows = _buckets(nodes)
    drawn = F.min_by("sig", F.xxhash64("sig", F.lit(turn))).alias("a")
    held = rows.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("c"), drawn)
    largest = F.max_by(F.struct("comp", "a"), F.struct("c", "comp")).alias("main")
    mixed = held.groupBy("key").agg(largest, F.count(F.lit(1)).alias("comps")).where("comps > 1")
    met = rows.join(by_shuffle(mixed), "key").where(F.col("comp") != F.col("main.comp")).select("main.a", F.col("sig").alias("b")).distinct()
    side = lambda name: nodes.select(F.col("sig").alias(name), F.struct(*_NODE).alias("x" + name))
    both = met.join(side("a"), "a").join(side("b"), "b").where(_may_link("xa", "xb", similarity))
    apart = _distance("xa.s0", "xb.s0") + _distance("xa.s1", "xb.s1")
    return both.groupBy("b").agg(F.min_by("a", F.struct(apart.alias("d"), F.col("a"))).alias("a")).select("a", "b")


def _open_pairs(nodes: DataFrame, similarity: float) -> DataFrame:
    """Pairs of one bucket and two components that may link, each from the first bucket that both share.

    A bucket's largest component is never paired with itself: others meet all, it meets others.
    """
    rows = _buckets(nodes)
    held = rows.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("c"))
    mixed = held.groupBy("key").agg(F.max_by("comp", F.struct("c", "comp")).alias("main"), F.count(F.lit(1)).alias("comps")).where("comps > 1").drop("comps")
    rows = rows.join(by_shuffle(mixed), "key").join(nodes.select("sig", F.struct(*_NODE, "bands").alias("x")), "sig")
    rows = written(rows, "near-buckets")
    others = rows.where("comp != main").select("key", F.col("sig").alias("other"), F.col("x").alias("y"), F.col("comp").alias("its"))
    once = (F.col("comp") == F.col("main")) | (F.col("sig") < F.col("other"))
    # all buckets that sets of two components share hold two components, so the first is among these rows
    first = F.col("key") == F.element_at(F.array_intersect("x.bands", "y.bands"), 1)
    met = rows.join(by_shuffle(others), "key").where((F.col("comp") != F.col("its")) & once & _may_link("x", "y", similarity) & first)
    pairs = written(met.select(F.least("sig", "other").alias("a"), F.greatest("sig", "other").alias("b")).distinct(), "near-pairs")
    discard(rows)
    return pairs


def _verified(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """The pairs whose whole shingle sets are similar enough, written; ``texts(id, text)`` are those of the nodes' ids."""
    needed = pairs.select(F.col("a").alias("sig")).unionByName(pairs.select(F.col("b").alias("sig"))).distinct()
    needed = written(needed.join(nodes, "sig").select("sig", "id"), "near-needed")
    few = needed.count() <= FEW_SETS
    ids = needed.select("id").distinct()
    sets = _sets(texts.join(F.broadcast(ids) if few else ids, "id", "left_semi").select("text"), width)
    # rows repeated with a needed id may have other texts
    sets = sets.join(F.broadcast(needed.select("sig")) if few else needed.select("sig"), "sig", "left_semi")
    sets = written(sets.dropDuplicates(["sig"]), "near-sets")
    if sets.agg(F.coalesce(F.sum(F.size("grams")), F.lit(0)).alias("n")).first()["n"] <= FEW_SHINGLES:
        side = lambda sig, grams: F.broadcast(sets.select(F.col("sig").alias(sig), F.col("grams").alias(grams)))
        both = pairs.join(side("a", "ga"), "a").join(side("b", "gb"), "b")
    else:
        hubs = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("uses"))
        hubs = sets.withColumnsRenamed({"sig": "a", "grams": "ga"}).join(hubs, "a")
        both = join_groups(pairs, hubs, "a", "uses", pairs.count(), "inner")
        both = both.join(sets.withColumnsRenamed({"sig": "b", "grams": "gb"}), "b")
    shared = F.size(F.array_intersect("ga", "gb"))
    # shared / (na + nb - shared) >= similarity
    linked = both.where(shared * (1 + similarity) >= (F.size("ga") + F.size("gb")) * similarity - 1e-9).select("a", "b")
    linked = written(linked, "near-edges")
    discard(needed, sets)
    return linked


def _with_component(nodes: DataFrame, grouped: DataFrame) -> DataFrame:
    """``nodes`` with ``comp``, the set that stands for the component."""
    found = nodes.join(grouped, nodes["sig"] == grouped["node"], "left")
    return found.select(*nodes.columns, F.coalesce("component", "sig").alias("comp"))


def _joined(grouped: DataFrame, edges: DataFrame) -> DataFrame:
    """The components after further edges; those found stand for all edges before and are deleted."""
    found = components(grouped.select(F.col("node").alias("a"), F.col("component").alias("b")).where("a != b").unionByName(edges))
    discard(grouped)
    return found


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = SIMILARITY) -> DataFrame:
    """One row for each row of ``docs``: ``id, component_id``, the smallest id of its component.

    * Components join all texts that a chain of near copies links. Texts without words form one.
    * Rows repeated with one id stay separate. A row with a null id has the component of
      the rows of its set, or null. An empty table gives an empty result.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    marked = written(_marks(docs, id_col, text_col, width), "shingle-marks")
    nodes = marked.groupBy("sig").agg(F.min("id").alias("id"), *[F.first(c).alias(c) for c in (*_NODE, "bands")])
    nodes = written(nodes.where("id is not null"), "near-nodes")
    first = written(_star_pairs(nodes, similarity).unionByName(_close_pairs(nodes)).distinct(), "near-pairs")
    edges = _verified(first, nodes, texts, width, similarity)
    grouped = components(edges)
    discard(first, edges)
    for turn in count():
        comp = written(_with_component(nodes, grouped), "near-nodes")
        pairs = written(_retry_pairs(comp, similarity, turn), "near-pairs")
        tried = pairs.count()
        linked = 0
        if tried:
            more = _verified(pairs, nodes, texts, width, similarity)
            linked = more.count()
            if linked:
                grouped = _joined(grouped, more)
            discard(more)
        discard(pairs)
        if linked <= tried * TURN_GAIN:
            break
        discard(comp)
    if linked:
        discard(comp)
        comp = written(_with_component(nodes, grouped), "near-nodes")
    pairs = _open_pairs(comp, similarity)
    if not pairs.isEmpty():
        more = _verified(pairs, nodes, texts, width, similarity)
        if not more.isEmpty():
            grouped = _joined(grouped, more)
        discard(more)
    discard(comp, pairs)
    labels = _with_component(nodes, grouped).select("sig", "id", "comp")
    least = labels.groupBy("comp").agg(F.min("id").alias("component_id"))
    labels = labels.join(least, "comp").select(F.col("sig").alias("_sig"), "component_id")
    return marked.join(labels, marked["sig"] == labels["_sig"], "left").select(F.col("id").alias(id_col), "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with the smallest id of each component only; columns unchanged, whatever their names.

    Rows with a null id stay, and so do rows repeated with the id that stays.
    """
    found = near_copies(docs.select(id_col, text_col), id_col, text_col, width, similarity)
    lost = found.where(F.col("component_id") != F.col(id_col)).select(id_col).distinct()
    return docs.join(lost, id_col, "left_anti").select(*docs.columns)
