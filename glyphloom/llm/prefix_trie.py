"""A prefix trie of conversations by smallest-member ownership.

Each distinct sequence of first turns is a node, and a node is owned by its smallest
member. Whoever owns a node also owns every deeper node of the same path, for its members
are fewer, so a conversation owns a suffix of its path and the subtree of a node needs no
walk: what the subtree holds is what the node's members hold from its depth on, minus or plus
what they own there. One window marks the owned nodes and one group-by over prefixes sums.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shipping import ship
from .common import join_groups, read, written

#: A node: its depth and two 64-bit keys of its turns.
NODE = ["depth", "ka", "kb"]
#: Conversation ids are joined to pieces of about so many bytes before they are hashed in order.
PIECE_BYTES = 1_000_000
#: The heads that conversations share are shorter than this.
HEADS = 6
#: Conversations of one such block share the head of its first.
BLOCK = 100


def ordered_turns(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id, pos, digest, chars``: the turns of each conversation from 1, by turn number, null first.

    Equal numbers follow the digest of role and text, so equal turns are interchangeable. Null roles and
    texts become empty. Rows without a conversation are left out: there is nothing to attach them to.
    Texts are digested in the scan and never shuffled.
    """
    who, said = F.coalesce(F.col(role).cast("string"), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    digest = F.unhex(F.sha2(F.concat_ws(":", F.length(who).cast("string"), F.concat(who, said)), 256))
    rows = turns.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), digest.alias("digest"), F.length(said).cast("long").alias("chars"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "digest")
    return rows.where("conv_id is not null").select("conv_id", F.row_number().over(order).cast("long").alias("pos"), "digest", "chars")


def shared_heads(own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(conv_id, depth, digest, chars)`` of rebuilt conversations, and every ``conv_id``.

    A conversation starts with the first h turns of its block's first conversation and goes on
    with its own turns after its first h; h is a checksum of its id.
    """
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).alias("h")
    base = F.col("conv_id") - F.col("conv_id") % BLOCK
    heads = own.where((F.col("conv_id") % BLOCK == 0) & (F.col("pos") < HEADS)).withColumnRenamed("conv_id", "base")
    lengths = heads.groupBy("base").agg(F.max("pos").alias("n"))
    convs = own.groupBy("conv_id").agg(F.max("pos").alias("turns")).select("conv_id", base.alias("base"), h).join(lengths, "base", "left")
    convs = written(convs.select("conv_id", "base", "h", F.least("h", F.coalesce("n", F.lit(0).cast("long"))).alias("n_head")), "trie-conversations")
    first = convs.where("n_head > 0").join(heads, "base").where("pos <= n_head").select("conv_id", F.col("pos").alias("depth"), "digest", "chars")
    after = own.join(convs, "conv_id").where("pos > h").select("conv_id", (F.col("pos") - F.col("h") + F.col("n_head")).alias("depth"), "digest", "chars")
    return first.unionByName(after), convs.select("conv_id")


def _paths(steps: DataFrame, convs: DataFrame) -> DataFrame:
    """Each conversation's nodes, root included, with node and parent keys and the characters left from there on."""
    root = convs.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("chars"))
    path, whole = Window.partitionBy("conv_id").orderBy("depth"), Window.partitionBy("conv_id")
    tag = lambda *x: F.when(F.col("depth") > 0, F.xxhash64(*x)).otherwise(F.lit(0).cast("long"))
    rows = steps.unionByName(root).withColumns({"x": tag("depth", "digest"), "y": tag("digest", "depth", F.lit("b"))})
    rows = rows.withColumns({
        "ka": F.bit_xor("x").over(path), "kb": F.bit_xor("y").over(path), "length": F.max("depth").over(whole),
        "left": F.sum("chars").over(whole) - F.sum("chars").over(path) + F.col("chars"),
    })
    parent = {"pa": F.col("ka").bitwiseXOR(F.col("x")), "pb": F.col("kb").bitwiseXOR(F.col("y"))}
    return rows.withColumns(parent).select("conv_id", *NODE, "pa", "pb", "chars", "left", "length")


def _parents(nodes: DataFrame) -> list[Column]:
    return [(F.col("depth") - 1).alias("depth"), F.col("pa").alias("ka"), F.col("pb").alias("kb")]


def prefix_trie(steps: DataFrame, convs: DataFrame) -> DataFrame:
    """One row for each node of the trie of ``steps(conv_id, depth, digest, chars)``, depths counting from 1 in each conversation.

    ``convs(conv_id)`` lists every conversation, those without steps too, which end at the root. Columns:
    ``conv_id`` (smallest member), ``depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens`` (over the
    subtree: characters of each node's last turn times its members but one) and ``ends_sha256`` (of the ids that end at the node).

    A turn that half of all conversations start with is one hot node: members meet in partial aggregates, the
    owner comes from a limited window that leaves one row a node and task, parents with many children are
    joined by broadcast, and ends are hashed from sorted pieces, so no task gathers a node's members. Turns of equal
    digest are the same; two nodes agree only if 128 bits do. Empty tables give no rows (not even a root).
    """
    paths = written(_paths(steps, convs), "trie-paths")
    rank = F.row_number().over(Window.partitionBy(*NODE).orderBy("conv_id"))
    owned = written(paths.withColumn("rank", rank).where("rank = 1").drop("rank", "left"), "trie-owned")
    inner = owned.where("depth > 0").select(*_parents(owned)).distinct()
    leaves = owned.where("depth = length").join(inner, NODE, "left_anti").select("conv_id", F.lit(None).cast("long").alias("depth"), F.lit(0).cast("long").alias("chars"), F.lit(1).alias("leaf"))
    each = owned.select("conv_id", "depth", "chars", F.lit(0).alias("leaf")).unionByName(leaves)
    owners = each.groupBy("conv_id").agg(F.min("depth").alias("start"), F.sum("chars").alias("owned"), F.max("leaf").alias("leaf"))
    marked = paths.join(owners, "conv_id", "left")
    no = F.lit(0).cast("long")
    saved = F.when(F.col("start") <= F.col("depth"), no).otherwise(F.col("left") - F.coalesce("owned", no))
    child = ((F.col("start") <= F.col("depth") + 1) & (F.col("depth") < F.col("length"))).cast("long")
    nodes = marked.groupBy(*NODE).agg(
        F.min(F.struct("conv_id", "start", "pa", "pb")).alias("owner"),
        F.count(F.lit(1)).alias("n_convs"),
        F.sum(F.coalesce(child, no)).alias("n_children"),
        F.sum(F.coalesce(F.col("leaf").cast("long"), no)).alias("n_leaves"),
        F.sum(saved).alias("saved_tokens"),
    )
    nodes = written(nodes.select(*NODE, "owner.*", "n_convs", "n_children", "n_leaves", "saved_tokens"), "trie-nodes")
    joined = _with_parent(nodes).join(_ends(paths.where("depth = length").select(*NODE, "conv_id")), NODE, "left")
    ends = F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256")
    return joined.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", ends)


def _with_parent(nodes: DataFrame) -> DataFrame:
    """Attach the owner of each node's parent: the node's own owner, but where its owned suffix starts."""
    starts = written(nodes.where("depth > 0 and start = depth").select("conv_id", *_parents(nodes)), "trie-starts")
    parents = nodes.where("n_children > 0").select(*NODE, "n_children", F.col("conv_id").alias("parent_conv_id"))
    found = join_groups(starts, parents, NODE, "n_children", starts.count(), "inner")
    found = found.select((F.col("depth") + 1).alias("depth"), "conv_id", F.col("parent_conv_id").alias("found"))
    own = F.when((F.col("depth") > 0) & (F.col("start") < F.col("depth")), F.col("conv_id"))
    return nodes.join(found, ["conv_id", "depth"], "left").withColumn("parent_conv_id", F.coalesce("found", own)).drop("found")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighbouring ids of one node as comma-joined pieces, each with its first id."""
    node, ids, size, out = None, [], 0, []

    def cut() -> None:
        nonlocal ids, size
        if ids:
            out.append((*node, ids[0], ",".join(map(str, ids))))
        ids, size = [], 0

    names = [*NODE, "conv_id", "piece"]
    for batch in batches:
        for *key, conv in zip(*(c.to_pylist() for c in batch.columns)):
            if key != node or size >= PIECE_BYTES:
                cut()
                node = key
            ids.append(conv)
            size += len(str(conv)) + 1
        if len(out) > 10_000 or sum(len(o[-1]) for o in out) > PIECE_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names)
            out.clear()
    cut()
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's pieces, which come in order."""
    node, state, out = None, None, []
    names = [*NODE, "ends_sha256"]
    for batch in batches:
        for *key, piece in zip(*(batch.column(c).to_pylist() for c in (*NODE, "piece"))):
            if key == node:
                state.update(b"," + piece.encode())
                continue
            if node:
                out.append((*node, state.hexdigest()))
            node, state = key, hashlib.sha256(piece.encode())
        if len(out) > 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names)
            out.clear()
    if node:
        out.append((*node, state.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names)


def _ends(ends: DataFrame) -> DataFrame:
    """``NODE, ends_sha256``: the ids of each node in order, hashed without gathering them.

    Ids are sorted over all tasks, joined to pieces where they lie, and a node's few pieces
    stream through one digest.
    """
    ship(ends.sparkSession)
    key = "depth long, ka long, kb long"
    order = ["ka", "kb", "depth", "conv_id"]
    spread = ends.repartitionByRange(*order).sortWithinPartitions(*order)
    pieces = spread.mapInArrow(_pieces, f"{key}, conv_id long, piece string")
    return pieces.repartition(*NODE).sortWithinPartitions(*order).mapInArrow(_digests, f"{key}, ends_sha256 string")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = written(ordered_turns(read(spark, sf_dir, "conversations")), "trie-turns")
    return prefix_trie(*shared_heads(own))


OP11_SQL = r"""
WITH ids AS (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL),
sums AS (
  SELECT conv_id, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, [ascii(x)::BIGINT FOR x IN string_split(conv_id::VARCHAR, '')]),
    lambda c, b: list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda v, z: xor(v >> 1, 3988292384 * (v & 1))))) % 6 AS h
  FROM ids
), t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos, length(coalesce(text, '')) AS chars,
         sha256(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS d
  FROM conversations
), r AS (
  SELECT s.conv_id, 0 AS part, pos, d, chars FROM sums s JOIN t ON t.conv_id = s.conv_id - s.conv_id % 100 AND pos <= h
  UNION ALL SELECT s.conv_id, 1, pos, d, chars FROM sums s JOIN t ON t.conv_id = s.conv_id AND pos > h
), w AS (
  SELECT i.conv_id, coalesce(list(d ORDER BY part, pos) FILTER (d IS NOT NULL), []) AS ds, coalesce(list(chars ORDER BY part, pos) FILTER (d IS NOT NULL), []) AS cs
  FROM ids i LEFT JOIN r USING (conv_id) GROUP BY i.conv_id
), o AS (
  SELECT conv_id AS c, k AS depth, array_to_string(ds[1:k], '/') AS node, CASE WHEN k > 0 THEN array_to_string(ds[1:k - 1], '/') END AS up,
         CASE WHEN k > 0 THEN cs[k] ELSE 0 END AS chars, k = len(ds) AS ends
  FROM w, unnest(range(0, len(ds) + 1)) AS u(k)
), n AS (
  SELECT depth, node, any_value(up) AS up, min(c) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars,
         sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256
  FROM o GROUP BY depth, node
), k AS (SELECT depth - 1 AS depth, up AS node, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
below AS (
  SELECT a.depth, a.node, sum((b.n_convs - 1) * b.chars) AS saved_tokens, count(*) FILTER (k.node IS NULL) AS n_leaves
  FROM n b JOIN o ON o.c = b.conv_id AND o.depth <= b.depth JOIN n a ON a.depth = o.depth AND a.node = o.node
  LEFT JOIN k ON k.depth = b.depth AND k.node = b.node GROUP BY ALL
)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children, n_leaves, saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM n LEFT JOIN n p ON p.depth = n.depth - 1 AND p.node = n.up LEFT JOIN k ON k.depth = n.depth AND k.node = n.node JOIN below ON below.depth = n.depth AND below.node = n.node
"""
