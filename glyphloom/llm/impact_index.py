"""Ranked lexical search over a bit-sliced impact index.

The index cuts the documents into blocks. For each block and term it keeps the documents
that hold the term and one bitmap for each bit of their impacts, where an impact is the
term's saturated frequency in the document. A search expands the bitmaps of the query's
terms to the block, multiplies by the term's weight with shifts and adds, adds all terms of
a query with bitwise carries, so every operation works on all documents of the block, and
reads the best k off the sum from its most significant bitmap down.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shipping import ship
from .common import ascii_lower, read, text_or_empty, written

#: A block ends at so many documents or so many bytes of text, whichever comes first.
BLOCK_DOCS = 16_384
BLOCK_BYTES = 16_000_000
#: Impacts are below a million.
IMPACT_BITS = 20
#: Queries are searched in chunks of about so many terms, which every task holds.
CHUNK_TERMS = 500_000
#: Up to so many distinct query terms are broadcast with their weights.
FEW_TERMS = 500_000
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Bytes of terms in lower case, every other byte as a blank.
_FOLD = bytes(b if chr(b).isalnum() and b < 128 or b >= 128 else 32 for b in range(256)).lower()


def terms_of(data: bytes) -> list[bytes]:
    """The terms of a text given as UTF-8, in order and with repeats."""
    return data.translate(_FOLD).split()


@dataclass(frozen=True)
class ImpactIndex:
    """``table(block, term, n, docs, bits, ids)``: one row for each block and term, and one without a term that lists the block's ids.

    ``docs`` are places in the block; ``bits`` holds IMPACT_BITS bitmaps over these, the least bit first.
    """

    table: DataFrame
    n_docs: int
    n_terms: int


class _Block:
    """Documents gathered until the block is full."""

    def __init__(self, most: int) -> None:
        self.docs: list[tuple[object, bytes]] = []
        self.size, self.most = 0, most

    def add(self, key: object, data: bytes) -> bool:
        self.docs.append((key, data))
        self.size += len(data)
        return len(self.docs) >= self.most or self.size >= BLOCK_BYTES

    def batches(self, n_docs: int, n_terms: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        self.docs.sort(key=lambda d: (d[0] is None, d[0]))  # then lower places are smaller ids
        known: dict[bytes, int] = {}
        ids, counts, held, norm = [], [], [], []
        for _, data in self.docs:
            found = terms_of(data)
            tally = Counter(found)
            ids += [known.setdefault(w, len(known)) for w in tally]
            counts += tally.values()
            held.append(len(tally))
            norm.append(50 + 50 * len(found) * n_docs // n_terms)
        keys = pa.array([[key for key, _ in self.docs]], schema.field("ids").type)
        none = lambda name: pa.nulls(1, schema.field(name).type)
        block = lambda n: pa.array([0] * n, pa.int64())  # noqa: E731  the caller numbers blocks
        yield pa.RecordBatch.from_arrays([block(1), none("term"), pa.array([len(self.docs)], pa.int32()), none("docs"), none("bits"), keys], schema=schema)
        if not known:
            return
        term, tf = np.array(ids, np.int64), np.array(counts, np.int64)
        place, m = np.repeat(np.arange(len(held)), held), np.repeat(np.array(norm, np.int64), held)
        impact = 1_000_000_000 * tf // (1_000 * tf + 20 * m)
        order = np.argsort(term, kind="stable")
        term, place, impact = term[order], place[order].astype(np.int32), impact[order]
        n = np.bincount(term)
        width = (n + 7) // 8
        first, at = np.cumsum(n) - n, np.cumsum(width) - width  # in rows, in bytes of a bitmap
        spot = 8 * at[term] + np.arange(len(term)) - first[term]
        planes = np.zeros((IMPACT_BITS, 8 * int(width.sum())), np.uint8)
        for bit in range(IMPACT_BITS):
            planes[bit, spot] = (impact >> bit) & 1
        packed = np.packbits(planes, axis=1, bitorder="little")
        words, ends = list(known), at + width
        for a in range(0, len(words), 10_000):
            b = min(a + 10_000, len(words))
            lists = pa.ListArray.from_arrays(pa.array(np.append(first[a:b], first[b - 1] + n[b - 1]) - first[a], pa.int32()), pa.array(place[first[a] : first[b - 1] + n[b - 1]]))
            bits = pa.array([packed[:, at[i] : ends[i]].tobytes() for i in range(a, b)], pa.binary())
            yield pa.RecordBatch.from_arrays([block(b - a), pa.array(words[a:b], pa.binary()), pa.array(n[a:b], pa.int32()), lists, bits, pa.nulls(b - a, schema.field("ids").type)], schema=schema)


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_docs: int = BLOCK_DOCS) -> ImpactIndex:
    """Index every row and every term of ``docs``.

    One scan counts terms, for impacts depend on the average length; a second one writes each block where its
    documents lie, so no text or posting is shuffled. Documents without a term, null texts among them, take a
    place but hold nothing. A very long text is a block of its own. An empty table gives an empty index.
    """
    ship(docs.sparkSession)
    n = F.regexp_count(text_or_empty(text_col), F.lit(TERM))
    total = docs.select(n.alias("n")).agg(F.count_if(F.col("n") > 0).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    n_docs, n_terms = total["docs"], max(1, total["terms"])
    from pyspark.sql.pandas.types import to_arrow_type

    key = to_arrow_type(docs.schema[id_col].dataType)
    schema = pa.schema([("block", pa.int64()), ("term", pa.binary()), ("n", pa.int32()), ("docs", pa.list_(pa.int32())), ("bits", pa.binary()), ("ids", pa.list_(key))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, made, block = TaskContext.get().partitionId() << 32, 0, _Block(block_docs)

        def flush() -> Iterator[pa.RecordBatch]:
            for batch in block.batches(n_docs, n_terms, schema):
                yield batch.set_column(0, "block", pa.array([part + made] * batch.num_rows, pa.int64()))

        for batch in batches:
            for k, data in zip(batch.column(0), batch.column(1).cast(pa.binary())):
                if block.add(k.as_py(), data.as_py()):
                    yield from flush()
                    made, block = made + 1, _Block(block_docs)
        if block.docs:
            yield from flush()

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text"))
    table = rows.mapInArrow(run, f"block long, term binary, n int, docs array<int>, bits binary, ids array<{kind}>")
    return ImpactIndex(written(table, "impact-index"), n_docs, n_terms)


def add_planes(total: list[int], planes: list[int], shift: int = 0) -> None:
    """Add a number given by bitmaps, times two to the ``shift``, to another, for all documents at once."""
    total.extend([0] * (len(planes) + shift + 1 - len(total)))
    carry, at = 0, shift
    for plane in planes:
        old = total[at]
        odd = old ^ plane
        total[at], carry = odd ^ carry, (old & plane) | (carry & odd)
        at += 1
    while carry:
        if at == len(total):
            total.append(0)
        total[at], carry = total[at] ^ carry, total[at] & carry
        at += 1


def best(planes: list[int], k: int) -> int:
    """The bitmap of the ``k`` documents with the largest sums above 0; of equal ones the lowest places."""
    sure, open_, n = 0, 0, 0
    for plane in planes:
        open_ |= plane
    for plane in reversed(planes):
        more = sure | (open_ & plane)
        n = more.bit_count()
        if n > k:
            open_ &= plane
        else:
            sure, open_ = more, open_ & ~plane
            if n == k:
                return sure
    for _ in range(k - sure.bit_count()):
        sure |= open_ & -open_
        open_ &= open_ - 1
    return sure


def _expanded(places: np.ndarray, bits: bytes, size: int) -> list[int]:
    """Bitmaps over a term's documents as bitmaps over the block."""
    packed = np.frombuffer(bits, np.uint8).reshape(IMPACT_BITS, -1)
    wide = np.zeros((IMPACT_BITS, size), np.uint8)
    wide[:, places] = np.unpackbits(packed, axis=1, count=len(places), bitorder="little")
    return [int.from_bytes(row.tobytes(), "little") for row in np.packbits(wide, axis=1, bitorder="little")]


def search_block(ids: list, postings: list[tuple[bytes, int, np.ndarray, bytes]], items: list[tuple[int, list[bytes]]], k: int) -> Iterator[tuple[int, object, int]]:
    """The ``k`` best documents of one block for each item, as ``(item, id, score)``; ``postings`` are term, weight, places and bits."""
    weighted: dict[bytes, list[int]] = {}
    for term, weight, places, bits in postings:
        planes, product = _expanded(places, bits, len(ids)), []
        for shift in range(weight.bit_length()):
            if weight >> shift & 1:
                add_planes(product, planes, shift)
        weighted[term] = product
    for item, terms in items:
        total: list[int] = []
        for term in terms:
            if term in weighted:
                add_planes(total, weighted[term])
        found = best(total, k)
        while found:
            place = (found & -found).bit_length() - 1
            found &= found - 1
            yield item, ids[place], sum((plane >> place & 1) << i for i, plane in enumerate(total))


def search(index: ImpactIndex, items: DataFrame, k: int = 50, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``item, rank, id, score``: the ``k`` best documents for each item, equal scores by ascending id, null last.

    Items are taken in chunks of CHUNK_TERMS terms against all blocks. Blocks give ``k`` rows an item at
    most, and these are cut again in each task before they meet. An item without a term, or whose
    terms no document holds, has no rows. Repeated rows of ``items`` are one item; texts that share an id are ranked
    apart. Repeated documents are ranked each. Other columns are ignored, whatever their names.
    """
    spark = items.sparkSession
    found = F.array_distinct(F.regexp_extract_all(ascii_lower(text_or_empty(text_col)), F.lit(TERM), F.lit(0)))
    asked = items.select(F.col(item_col).alias("item"), found.alias("terms")).distinct().withColumn("q", F.monotonically_increasing_id())
    asked = written(asked, "impact-items")
    wanted = asked.select(F.explode("terms").alias("t")).select(F.encode("t", "UTF-8").alias("term")).distinct()
    n_terms = asked.agg(F.sum(F.size("terms"))).first()[0] or 0
    near = lambda df: F.broadcast(df) if n_terms <= FEW_TERMS else df
    df = index.table.where("term is not null").join(near(wanted), "term", "left_semi").groupBy("term").agg(F.sum("n").alias("df"))
    # both numbers are doubles before they are divided
    ratio = F.lit(float(2 * index.n_docs + 2)) / (2 * F.col("df") + 1).cast("double")
    weights = written(df.select("term", F.floor(1000 * F.log(ratio)).cast("long").alias("w")).where("w > 0"), "impact-weights")
    postings = index.table.join(near(weights), "term", "left").where("w is not null or term is null")
    chunks = max(1, -(-n_terms // CHUNK_TERMS))
    kind = index.table.schema["ids"].dataType.elementType.simpleString()
    out = None
    for chunk in range(chunks):
        part = asked.where(F.pmod("q", F.lit(chunks)) == chunk).select("q", "terms")
        some = [(r["q"], [t.encode() for t in r["terms"]]) for r in part.toLocalIterator()]
        rows = postings.groupBy("block").applyInArrow(_searcher(some, k), f"q long, id {kind}, score long")
        out = rows if out is None else out.unionByName(rows)
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last()))
    top = out.withColumn("rank", place).where(F.col("rank") <= k)
    return top.join(asked.select("q", "item"), "q").select(F.col("item").alias(item_col), "rank", F.col("id").alias(id_col), "score")


def _searcher(items: list[tuple[int, list[bytes]]], k: int):
    def run(group: pa.Table) -> pa.Table:
        ids, postings = [], []
        for row in group.select(["term", "w", "docs", "bits", "ids"]).to_batches():
            term, w, docs, bits, keys = row.columns
            for i in range(row.num_rows):
                if term[i].is_valid:
                    postings.append((term[i].as_py(), w[i].as_py(), docs[i].values.to_numpy(), bits[i].as_py()))
                else:
                    ids = keys[i].as_py()
        hits = list(search_block(ids, postings, items, k))
        kind = group.schema.field("ids").type.value_type
        cols = zip(*hits) if hits else ((), (), ())
        return pa.table({n: pa.array(list(c), t) for n, t, c in zip(("q", "id", "score"), (pa.int64(), kind, pa.int64()), cols)})

    return run


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = build_index(read(spark, sf_dir, "documents"))
    return search(index, read(spark, sf_dir, "benchmark"))


_TERMS_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP12_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS_SQL} AS ts FROM documents),
s AS (SELECT count(*) FILTER (len(ts) > 0) AS n, sum(len(ts))::BIGINT AS l FROM d),
p AS (SELECT r, any_value(doc_id) AS doc_id, t, count(*) AS tf, any_value(len(ts)) AS size FROM d, unnest(ts) AS u(t) GROUP BY r, t),
w AS (SELECT t, floor(1000 * ln((2 * n + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, s GROUP BY t, n),
i AS (SELECT DISTINCT item_id, unnest({_TERMS_SQL}) AS t FROM benchmark),
f AS (
  SELECT item_id, r, any_value(doc_id) AS doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * size * n) // l))))::BIGINT AS score
  FROM i JOIN p USING (t) JOIN w USING (t), s GROUP BY item_id, r
), k AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM f WHERE score > 0)
SELECT * FROM k WHERE rank <= 50
"""
