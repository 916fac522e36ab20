"""Exact removal of repeated byte strings by a distributed difference cover.

Two equal strings of LENGTH bytes may start anywhere. Of the places ``p`` of a document those are sampled
whose remainder modulo PERIOD lies in COVER, a difference cover: for any two places there is a shift below PERIOD that
takes both to sampled places. So equal strings hold, at the same shift, a pair of samples whose
tuples of LENGTH - PERIOD + 1 bytes agree. The rounds are those of difference-cover suffix sorting, stopped at LENGTH bytes
and with tuples that are alone left out:

1. sampled tuples are sorted and named; a tuple that occurs once belongs to no repeated string;
2. recursion on names: samples of one name are sorted by their context, all that the strings through the
   sample can touch. Of equal contexts every one but the first is settled whole, its strings are repeats;
   a name with a single context is settled, too;
3. the remaining places, those in reach of a sample whose name has several contexts, are merged: their LENGTH bytes
   are sorted, and each is compared with its neighbour before it.

Sorting is by hashes, in buckets of hash values that Spark shuffles: equality is all that is asked, so the
order need not be that of bytes. Tasks send packed columns without positions, for their order tells it; codes
come back the same way.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shipping import ship
from .common import read, text_or_empty, written

LENGTH = 100
PERIOD = 31
#: A perfect difference cover: each remainder but 0 is the difference of exactly one pair.
COVER = (1, 5, 11, 24, 25, 27)
#: Documents are packed until they have so many bytes.
BLOCK_BYTES = 8_000_000
#: Sampled tuples that one bucket holds on average, at most.
BUCKET_ITEMS = 2_000_000
_PAD = 256
_U = np.uint64
#: Seeds and odd multipliers of two independent hashes.
_HASHES = ((_U(0x9E3779B97F4A7C15), _U(0xFF51AFD7ED558CCD)), (_U(0xD6E8FEB86659FD93), _U(0xC4CEB9FE1A85EC53)))
_STARTS = np.dtype([("a", "<u8"), ("b", "<u4")])
_CONTEXTS = np.dtype([("name", "<u4"), ("context", "<u8")])
_NAMES = np.dtype("<u4")


def hashed(words: np.ndarray, at: np.ndarray, length: int, which: int = 0) -> np.ndarray:
    """64-bit hashes of the ``length`` bytes from each place; ``words`` has the 8 bytes from every place."""
    seed, factor = _HASHES[which]
    h = np.full(len(at), seed + _U(length))
    for o in [*range(0, length - 8, 8), length - 8]:
        h ^= words[at + o]
        h *= factor
        h ^= h >> _U(32)
    h *= _HASHES[1 - which][1]
    return h ^ (h >> _U(29))


def _ragged(counts: np.ndarray) -> np.ndarray:
    """0, 1, .. for each count in turn."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


class Block:
    """Texts laid end to end, with what the rounds derive from them."""

    def __init__(self, texts: list[bytes], n_buckets: int, length: int) -> None:
        self.buffer = b"".join(texts) + bytes(_PAD + length)
        self.lens = np.array([len(t) for t in texts], np.int64)
        self.first = np.cumsum(self.lens) - self.lens
        self.words = np.ndarray((len(self.buffer) - 7,), "<u8", self.buffer, strides=(1,))
        self.n_buckets, self.length, self.tuple = n_buckets, length, length - PERIOD + 1

    def _bucket(self, h: np.ndarray) -> np.ndarray:
        return (h >> _U(34)) % _U(self.n_buckets)

    def samples(self) -> None:
        """Sampled places whose tuple lies in the document, their document, name and bucket."""
        longest = int(self.lens.max(initial=0))
        cover = (np.arange(longest // PERIOD + 1)[:, None] * PERIOD + np.array(COVER)).ravel()
        n = np.searchsorted(cover, self.lens - self.tuple, "right")
        self.doc = np.repeat(np.arange(len(n)), n)
        self.at = cover[_ragged(n)] + self.first[self.doc]
        name = hashed(self.words, self.at, self.tuple)
        self.bucket, self.name = self._bucket(name), name.astype(np.uint32)

    def contexts(self, codes: list[bytes]) -> None:
        """Keep samples of repeated names; their contexts, which are unlike all others if the document ends within one."""
        self.samples()
        keep = unpacked(codes, self.doc, self.bucket) > 0
        self.doc, self.at, self.name, self.bucket = (x[keep] for x in (self.doc, self.at, self.name, self.bucket))
        low, end = self.at - (PERIOD - 1), self.first[self.doc] + self.lens[self.doc]
        self.whole = (low >= self.first[self.doc]) & (self.at + self.length <= end)
        self.context = hashed(self.words, np.where(self.whole, low, 0), self.length + PERIOD - 1)

    def starts(self, names: list[bytes], contexts: list[bytes]) -> np.ndarray:
        """Places known to be repeats; sets ``open``, the places that are left to compare, and their document."""
        self.contexts(names)
        code = unpacked(contexts, self.doc, self.bucket)
        settled, open_ = self._reach(code == 1), self._reach(code == 2)
        self.open = np.flatnonzero(open_ & ~settled)
        self.open_doc = np.searchsorted(self.first, self.open, "right") - 1
        return settled

    def _reach(self, which: np.ndarray) -> np.ndarray:
        """The places at which a string through one of the samples may start."""
        at, doc = self.at[which], self.doc[which]
        low = np.maximum(at - (PERIOD - 1), self.first[doc])
        high = np.minimum(at, self.first[doc] + self.lens[doc] - self.length)
        low, high = low[high >= low], high[high >= low]
        size = int(self.lens.sum()) + 1
        return np.cumsum(np.bincount(low, minlength=size + 1) - np.bincount(high + 1, minlength=size + 1))[: size - 1] > 0

    def open_hashes(self) -> tuple[np.ndarray, np.ndarray]:
        a, b = hashed(self.words, self.open, self.length), hashed(self.words, self.open, self.length, 1)
        out = np.empty(len(a), _STARTS)
        out["a"], out["b"] = a, b.astype(np.uint32)
        return self._bucket(b), out


def unpacked(codes: list[bytes], doc: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """Codes that came back by document and bucket, in the order of places; a document without any has zeros."""
    n = np.bincount(doc, minlength=len(codes))
    sent = np.concatenate([np.zeros(n[i], np.uint8) if c is None else np.frombuffer(c, np.uint8) for i, c in enumerate(codes)] or [np.zeros(0, np.uint8)])
    out = np.zeros(len(doc), np.uint8)
    out[np.lexsort((bucket, doc))] = sent
    return out


def repeated_names(items: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """1 for each name that occurs more than once."""
    order = np.argsort(items, kind="stable")
    same = np.diff(items[order]) == 0
    out = np.zeros(len(items), np.uint8)
    out[order[1:][same]] = out[order[:-1][same]] = 1
    return out


def judged_contexts(items: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """1 for each context but the first of its kind, 2 for first ones of a name with several, 0 for a single one."""
    order = np.lexsort((np.arange(len(items)), keys, items["context"], items["name"]))
    name, context = items["name"][order], items["context"][order]
    new_name = np.append(True, name[1:] != name[:-1])[: len(items)]
    new = new_name | np.append(True, context[1:] != context[:-1])[: len(items)]
    group = np.cumsum(new_name) - 1
    several = np.bincount(group, weights=new)[group] > 1 if len(items) else new
    out = np.zeros(len(items), np.uint8)
    out[order] = np.where(new, 2 * several, 1)
    return out


def later_strings(items: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """1 for each string that its neighbour in sorted order equals, which starts earlier."""
    order = np.lexsort((np.arange(len(items)), keys, items["b"], items["a"]))
    same = (items["a"][order][1:] == items["a"][order][:-1]) & (items["b"][order][1:] == items["b"][order][:-1])
    out = np.zeros(len(items), np.uint8)
    out[order[1:][same]] = 1
    return out


Rows = list[tuple]
#: Of rows, their items: document (ascending), bucket and value.
Maker = Callable[[Rows], tuple[np.ndarray, np.ndarray, np.ndarray]]


def _blocks(batches: Iterator[pa.RecordBatch], size_of: Callable[[tuple], int]) -> Iterator[Rows]:
    rows, size = [], 0
    for batch in batches:
        for row in zip(*(c if pa.types.is_integer(c.type) else (x.as_py() for x in c) for c in batch.columns)):
            rows.append((row[0].as_py(), *row[1:]))
            size += size_of(row)
            if size >= BLOCK_BYTES:
                yield rows
                rows, size = [], 0
    if rows:
        yield rows


def exchange(rows: DataFrame, make: Maker, judge: Callable[[np.ndarray, np.ndarray], np.ndarray], dtype: np.dtype, label: str) -> DataFrame:
    """``key, codes``: what ``judge`` says of the items that ``make`` finds in ``rows(key, ..)``, for keys with a code above 0.

    Items of one bucket meet in one task, as arrays; documents are in ascending places, so the order of items and the
    keys tell which comes first. Codes return to the sending block and from there to its documents, bucket by bucket.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        for block, part in enumerate(_blocks(batches, lambda r: 4 * len(r[1].as_py() if hasattr(r[1], "as_py") else r[1])), block):
            doc, bucket, items = make(part)
            order = np.argsort(bucket, kind="stable")
            keys, doc, bucket, items = np.array([r[0] for r in part], np.int64), doc[order], bucket[order], items[order]
            edges = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else []
            out = []
            for a, b in zip(edges, [*edges[1:], len(bucket)]):
                held, n = np.unique(doc[a:b], return_counts=True)
                out.append((int(bucket[a]), block, keys[held].tobytes(), n.astype(np.int32).tobytes(), items[a:b].tobytes()))
            for a in range(0, len(out), 64):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[a : a + 64]), (pa.int64(), pa.int64(), *[pa.binary()] * 3))], ["bucket", "block", "keys", "counts", "items"])

    def spread(rows: pa.Table) -> tuple[list[np.ndarray], list[np.ndarray]]:
        keys = [np.frombuffer(x, np.int64) for x in rows["keys"].to_pylist()]
        counts = [np.frombuffer(x, np.int32) for x in rows["counts"].to_pylist()]
        return keys, counts

    def meet(rows: pa.Table) -> pa.Table:
        keys, counts = spread(rows)
        items = np.frombuffer(b"".join(rows["items"].to_pylist()), dtype)
        codes = judge(items, np.repeat(np.concatenate(keys), np.concatenate(counts)))
        ends = np.cumsum([c.sum() for c in counts])
        parts = [x.tobytes() for x in np.split(codes, ends[:-1])]
        return rows.drop_columns(["items"]).append_column("codes", pa.array(parts, pa.binary()))

    def home(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("bucket")
        keys, counts = spread(rows)
        key = np.repeat(np.concatenate(keys), np.concatenate(counts))
        order = np.argsort(key, kind="stable")
        key, codes = key[order], np.frombuffer(b"".join(rows["codes"].to_pylist()), np.uint8)[order]
        edges = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        some = np.maximum.reduceat(codes, edges) > 0
        ends = np.append(edges[1:], len(key))
        return pa.table({"key": pa.array(key[edges[some]]), "codes": pa.array([codes[a:b].tobytes() for a, b in zip(edges[some], ends[some])], pa.binary())})

    kinds = "bucket long, block long, keys binary, counts binary"
    sent = rows.mapInArrow(send, f"{kinds}, items binary")
    met = sent.groupBy("bucket").applyInArrow(meet, f"{kinds}, codes binary")
    return written(met.groupBy("block").applyInArrow(home, "key long, codes binary"), label)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``_key, _id, _text`` with a distinct number for each row, ascending as the ids do.

    Distinct whole numbers are their own keys. Other rows are written and ranked by id, null last, and
    the digest of the text: range partitions, whose sizes give the first rank of each.
    """
    rows = docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text"))
    whole = rows.schema["_id"].dataType.typeName() in ("byte", "short", "integer", "long")
    if whole and rows.where("_id is null").isEmpty() and rows.groupBy("_id").count().where("count > 1").isEmpty():
        return rows.withColumn("_key", F.col("_id").cast("long"))
    rows = written(rows.withColumn("_row", F.monotonically_increasing_id()), "strings-rows")
    order = [F.col("_id").asc_nulls_last(), F.col("_sha").asc(), F.col("_row").asc()]
    ranged = rows.select("_id", F.sha2("_text", 256).alias("_sha"), "_row").repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    ranged = written(ranged, "strings-order")
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))  # a row for each partition
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    ranks = ranged.withColumn("_place", place).join(F.broadcast(before), "_part").select("_row", (F.col("_before") + F.col("_place")).alias("_key"))
    return written(rows.join(ranks, "_row").select("_key", "_id", "_text"), "strings-keyed")


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed before they are moved."""
    press = zstandard.ZstdCompressor(3).compress
    for batch in batches:
        texts = pa.array([press(t.as_py()) for t in batch.column(1).cast(pa.binary())], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), texts], ["key", "packed"])


def repeated_strings(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", with_kept: bool = False) -> DataFrame:
    """One row for each row of ``docs``: id, ``n_bytes, spans, kept_sha256`` and, on demand, ``kept``.

    A byte goes if a string of ``length`` bytes covers it that also starts earlier: in a document of smaller id, or in the same
    one further ahead. Strings do not cross documents. ``spans`` are the maximal runs of bytes that go, ``start`` and
    ``end`` (exclusive) from 0; ``kept_sha256`` digests the bytes that stay, and ``kept`` holds them (they may split a character).

    * A null text is empty; texts shorter than ``length`` keep all. A very long text is a block of its own.
    * Rows that share an id follow each other by the digest of their texts; a null id comes last.
    * An empty table gives an empty result; other columns are ignored, whatever their names.
    * Strings count as equal if 96 bits of hashes are (contexts: the bucket, 32 and 64 bits).
    """
    if length < PERIOD + 7:
        raise ValueError(f"strings have at least {PERIOD + 7} bytes")
    spark = docs.sparkSession
    ship(spark)
    rows = _keyed(docs, id_col, text_col)
    n_bytes = rows.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    n_buckets = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), n_bytes * len(COVER) // PERIOD // BUCKET_ITEMS)
    long = rows.where(F.octet_length("_text") >= length).select("_key", "_text")
    texts = lambda part: [zstandard.decompress(r[1]) for r in part]

    def names(part: Rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        block = Block([r[1] for r in part], n_buckets, length)
        block.samples()
        return block.doc, block.bucket, block.name

    def contexts(part: Rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        block = Block(texts(part), n_buckets, length)
        block.contexts([r[2] for r in part])
        out = np.empty(len(block.at), _CONTEXTS)
        keys = np.array([r[0] for r in part], np.int64)[block.doc].astype(np.uint64)
        alone = (keys * _HASHES[0][0] + (block.at - block.first[block.doc]).astype(np.uint64)) * _HASHES[1][0]
        out["name"], out["context"] = block.name, np.where(block.whole, block.context, alone)
        return block.doc, block.bucket, out

    def starts(part: Rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        block = Block(texts(part), n_buckets, length)
        block.starts([r[2] for r in part], [r[3] for r in part])
        bucket, items = block.open_hashes()
        return block.open_doc, bucket, items

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _blocks(batches, lambda r: 4 * len(r[1])):
            block = Block(texts(part), n_buckets, length)
            start = block.starts([r[2] for r in part], [r[3] for r in part])
            bucket, _ = block.open_hashes()
            start[block.open[unpacked([r[4] for r in part], block.open_doc, bucket) > 0]] = True
            yield _spans(block, start, [r[0] for r in part], with_kept)

    binary = long.withColumn("_text", F.col("_text").cast("binary"))
    named = exchange(binary, names, repeated_names, _NAMES, "strings-names")
    packed = written(binary.mapInArrow(_packed, "key long, packed binary").join(named, "key").withColumnRenamed("codes", "names"), "strings-texts")
    judged = exchange(packed, contexts, judged_contexts, _CONTEXTS, "strings-contexts").withColumnRenamed("codes", "contexts")
    compared = exchange(packed.join(judged, "key"), starts, later_strings, _STARTS, "strings-starts").withColumnRenamed("codes", "starts")
    kept = ", kept binary" if with_kept else ""
    spans = packed.join(judged.join(compared, "key", "left"), "key").mapInArrow(cut, f"key long, spans array<struct<start:int,end:int>>, kept_sha256 string{kept}")
    found = written(spans, "strings-spans")
    narrow = rows.select("_key", "_id", F.octet_length("_text").cast("long").alias("n_bytes"), F.sha2("_text", 256).alias("_sha"), *["_text"] * with_kept)
    out = narrow.join(found, F.col("_key") == F.col("key"), "left")
    none = F.array().cast("array<struct<start:int,end:int>>")
    cols: list[Column] = [F.col("_id").alias(id_col), "n_bytes", F.coalesce("spans", none).alias("spans"), F.coalesce("kept_sha256", "_sha").alias("kept_sha256")]
    return out.select(*cols, *[F.coalesce("kept", F.col("_text").cast("binary")).alias("kept")] * with_kept)


def _spans(block: Block, start: np.ndarray, keys: list[int], with_kept: bool) -> pa.RecordBatch:
    """What goes of each document that loses something."""
    size, at = len(start) + 1, np.flatnonzero(start)
    step = np.zeros(size + block.length, np.int32)
    step[at] += 1
    step[at + block.length] -= 1
    gone = np.cumsum(step)[: size - 1] > 0
    data = np.frombuffer(block.buffer, np.uint8, size - 1)
    out = []
    for key, a, n in zip(keys, block.first, block.lens):
        one = gone[a : a + n]
        if one.any():
            edges = np.flatnonzero(np.diff(np.concatenate([[False], one, [False]]).astype(np.int8))).tolist()
            kept = data[a : a + n][~one].tobytes()
            spans = [{"start": s, "end": e} for s, e in zip(edges[::2], edges[1::2])]
            out.append((key, spans, hashlib.sha256(kept).hexdigest(), *[kept] * with_kept))
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    types = [pa.int64(), kind, pa.string(), *[pa.binary()] * with_kept]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out) if out else [()] * len(types), types)], ["key", "spans", "kept_sha256", *["kept"] * with_kept])


def op13_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_strings(read(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id) AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
c AS (SELECT r, p, substr(x, (2 * p + 1)::BIGINT, 710) AS y FROM d, unnest(range(0, length(x) // 2 - 99, 256)) AS u(p)),
w AS (SELECT r, p + j AS i, md5_number(substr(y, (2 * j + 1)::BIGINT, 200)) AS s FROM c, unnest(range(0, least(256, length(y) // 2 - 99))) AS u(j)),
f AS (SELECT r, i FROM (SELECT r, i, row_number() OVER (PARTITION BY s ORDER BY r, i) AS n FROM w) WHERE n > 1),
g AS (SELECT r, i, CASE WHEN lag(i) OVER (PARTITION BY r ORDER BY i) >= i - 100 THEN 0 ELSE 1 END AS new FROM f),
h AS (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS k FROM g),
s AS (SELECT r, k, min(i) AS a, max(i) + 100 AS b FROM h GROUP BY r, k),
e AS (
  SELECT r, count(*) AS n_spans, sum(b - a)::BIGINT AS n_removed, string_agg(substr(x, (2 * p + 1)::BIGINT, (2 * (a - p))::BIGINT), '' ORDER BY a) || substr(any_value(x), (2 * max(b) + 1)::BIGINT) AS kept
  FROM (SELECT s.*, x, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS p FROM s JOIN d USING (r)) GROUP BY r
)
SELECT doc_id, length(x) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, x))) AS kept_sha256 FROM d LEFT JOIN e USING (r)
"""
