"""UTF-8 decoding of documents that arrive as byte chunks, cut anywhere.

A chunk is summarised by itself, in Spark's expressions: how many continuation bytes it starts with,
the first fault after them, and the unfinished sequence at its end. A document's state is the
unfinished sequence so far and the offset, so summaries fold in order with at most three bytes carried from
chunk to chunk; streams keep that state by key, tables get it from the chunks before.

Verdicts are a tagged struct: ``status`` is ok, rejected or incomplete. Rejected ones carry ``reason``
with its kind, offset in the whole document, and the byte or code point at fault; incomplete ones carry
``needed``, the bytes that the last sequence still lacks.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.codec import first_invalid_utf8, let
from ..shipping import ship

#: Names of the reject kinds by the faults of ``functions.codec``.
REASONS = {
    "InvalidStartByte": "utf8InvalidStartByte", "Truncated": "utf8TruncatedSequence", "InvalidContinuation": "utf8InvalidContinuation",
    "Overlong": "utf8OverlongEncoding", "Cesu8": "utf8Surrogate", "CodepointBeyondMax": "utf8BeyondMaxCodepoint",
}
REASON = "kind string, offset long, byte int, cp int"
VERDICT = f"status string, reason struct<{REASON.replace(' ', ':').replace(',:', ',')}>, needed int, n_bytes long"
#: An unfinished sequence at the end of bytes spelt as U+0000 to U+00FF.
_TAIL = r"(?:[\xC2-\xF4]|[\xE0-\xF4][\x80-\xBF]|[\xF0-\xF4][\x80-\xBF]{2})\z"


def _latin(data: Column) -> Column:
    return F.decode(data, "ISO-8859-1")


def _code_point(s: Column, at: Column, size: int) -> Column:
    """The code point that ``size`` bytes from ``at`` spell, whatever it is."""
    byte = lambda i: F.ascii(F.substring(s, at + 1 + i, F.lit(1)))
    value = byte(0) % (1 << (7 - size))
    for i in range(1, size):
        value = value * 64 + byte(i) % 64
    return value.cast("int")


def reject_reason(data: Column) -> Column:
    """The first fault of a binary column as a tagged reason, null where it is valid UTF-8.

    ``byte`` is given for bytes that cannot start or go on, ``cp`` for surrogates and code points beyond the last.
    """

    def named(x: Column) -> Column:
        s, at = _latin(data), x["offset"]
        kind = x["kind"]
        here = F.ascii(F.substring(s, at + 1, F.lit(1)))
        byte = F.when(kind.isin("InvalidStartByte", "InvalidContinuation"), here)
        cp = F.when(kind == "Cesu8", _code_point(s, at - 2, 3)).when(kind == "CodepointBeyondMax", _code_point(s, at - 3, 4))
        name = F.element_at(F.create_map(*[F.lit(v) for kv in REASONS.items() for v in kv]), kind)
        return F.when(kind.isNotNull(), F.struct(name.alias("kind"), at.cast("long").alias("offset"), byte.cast("int").alias("byte"), cp.alias("cp")))

    return let(first_invalid_utf8(data), named)


def needed_bytes(tail: Column) -> Column:
    """Bytes that an unfinished sequence, spelt as U+0000 to U+00FF, still lacks."""
    size = F.when(tail.rlike(r"^[\xC2-\xDF]"), 2).when(tail.rlike(r"^[\xE0-\xEF]"), 3).when(tail.rlike(r"^[\xF0-\xF4]"), 4).otherwise(0)
    return (size - F.length(tail)).cast("int")


def strict_result(data: Column, complete: bool | Column = True) -> Column:
    """The verdict of whole bytes: an unfinished last sequence is a fault of ``complete`` data and incomplete otherwise."""
    done = complete if isinstance(complete, Column) else F.lit(complete)

    def verdict(reason: Column) -> Column:
        open_ = (reason["kind"] == "utf8TruncatedSequence") & ~done
        status = F.when(reason.isNull(), "ok").when(open_, "incomplete").otherwise("rejected")
        lacks = F.when(open_, needed_bytes(F.regexp_extract(_latin(data), _TAIL, 0)))
        return F.struct(status.alias("status"), F.when(~open_, reason).alias("reason"), lacks.alias("needed"), F.length(data).cast("long").alias("n_bytes"))

    return F.when(data.isNotNull(), let(reject_reason(data), verdict))


def chunks(data: Column, size: Column) -> Column:
    """Bytes cut into pieces of ``size``, as ``(seq, data, last)`` from 0; empty bytes are one empty piece."""
    n = F.greatest(F.ceil(F.length(data) / size), F.lit(1)).cast("int")
    piece = lambda i: F.struct(i.alias("seq"), F.substring(data, i * size + 1, size).alias("data"), (i == n - 1).alias("last"))
    return F.transform(F.sequence(F.lit(0), n - 1), piece)


def verdicts(pieces: DataFrame, key: str, seq: str = "seq", data: str = "data", last: str = "last") -> DataFrame:
    """``key, verdict`` of the documents that ``pieces(key, seq, data, last)`` hold, the same as of their whole bytes.

    Each piece is summarised where it lies, and only summaries meet by document. A piece sees the last three bytes
    before it, for no unfinished sequence is longer, whatever the cuts; the earliest fault of all pieces counts, of
    two at one offset that of the earlier piece. A document without a last piece may go on. Null data counts as
    empty; pieces with a null key or number are left out; a piece that repeats counts once.
    """
    order = Window.partitionBy("key").orderBy("seq")
    rows = summaries(pieces, key, seq, data, last).withColumn("again", F.coalesce(F.lag("seq").over(order) == F.col("seq"), F.lit(False)))
    rows = rows.where("not again").withColumn("base", F.sum("n").over(order) - F.col("n"))
    # the last bytes of three pieces before are three bytes if there are so many: an empty piece hands on what it got
    ends = F.concat(*[F.coalesce(F.lag("end", i).over(order), F.lit(b"")) for i in (3, 2, 1)])
    full = rows.where("n > 0").withColumn("before", F.right(_latin(ends), F.lit(3)))
    pending = F.regexp_extract("before", _TAIL, 0)
    seam = F.concat(F.encode(pending, "ISO-8859-1"), "head", "after")
    seen = full.withColumn("from", F.col("base") - F.length(pending)).withColumn("seam", seam).withColumn("at_seam", reject_reason(F.col("seam")))
    open_ = F.coalesce(F.col("at_seam.kind") == "utf8TruncatedSequence", F.lit(False))
    early = F.struct((F.col("at_seam.offset") + F.col("from")).alias("offset"), "seq", "at_seam.kind", "at_seam.byte", "at_seam.cp")
    own = F.when(F.col("kind").isNotNull(), F.struct((F.col("offset") + F.col("base")).alias("offset"), "seq", "kind", "byte", "cp"))
    fault = F.when(F.col("at_seam").isNotNull() & ~open_, early).otherwise(own)
    carried = F.when((F.length("after") == 0) & open_, F.regexp_extract(_latin(F.col("seam")), _TAIL, 0)).otherwise(_latin(F.col("tail")))
    found = seen.groupBy("key").agg(F.min(fault).alias("fault"), F.max_by(carried, "seq").alias("carried"))
    sizes = rows.groupBy("key").agg(F.sum("n").alias("n_bytes"), F.max("last").alias("last"))
    both = sizes.join(found, "key", "left")
    left = F.coalesce(F.col("carried") != "", F.lit(False))
    at_end = F.struct(F.lit("utf8TruncatedSequence").alias("kind"), F.col("n_bytes").alias("offset"), F.lit(None).cast("int").alias("byte"), F.lit(None).cast("int").alias("cp"))
    reason = F.when(F.col("fault").isNotNull(), F.struct("fault.kind", "fault.offset", "fault.byte", "fault.cp")).when(left & F.col("last"), at_end)
    status = F.when(reason.isNotNull(), "rejected").when(F.col("last"), "ok").otherwise("incomplete")
    lacks = F.when(status == "incomplete", F.when(left, needed_bytes(F.col("carried"))).otherwise(0))
    verdict = F.struct(status.alias("status"), reason.alias("reason"), lacks.alias("needed"), "n_bytes")
    return both.select(F.col("key").alias(key), verdict.alias("verdict"))


def summaries(stream: DataFrame, key: str, seq: str = "seq", data: str = "data", last: str = "last") -> DataFrame:
    """What the state of a document has to know of each piece, in place of its bytes.

    ``head`` are its first continuation bytes, four at most, ``after`` the byte after them, ``kind`` and the like the
    first fault from there, ``tail`` the unfinished sequence at the end and ``end`` the last three bytes.
    """
    bits = F.coalesce(F.col(data), F.lit(b""))
    head = F.regexp_extract(_latin(bits), r"^[\x80-\xBF]{0,4}", 0)
    rows = stream.select(F.col(key).alias("key"), F.col(seq).cast("long").alias("seq"), bits.alias("data"), F.coalesce(last, F.lit(False)).alias("last"), head.alias("h"))
    body = F.substring("data", F.length("h") + 1, F.length("data"))
    rows = rows.withColumn("reason", reject_reason(body)).withColumn("body", body)
    cut = F.coalesce(F.col("reason.kind") == "utf8TruncatedSequence", F.lit(False))
    return rows.where("key is not null and seq is not null").select(
        "key", "seq", "last", F.length("data").cast("long").alias("n"), F.encode("h", "ISO-8859-1").alias("head"),
        F.substring("body", F.lit(1), F.lit(1)).alias("after"), F.encode(F.right(_latin(F.col("data")), F.lit(3)), "ISO-8859-1").alias("end"),
        F.when(~cut, F.col("reason.kind")).alias("kind"), F.when(~cut, F.col("reason.offset") + F.length("h")).alias("offset"), F.col("reason.byte").alias("byte"), F.col("reason.cp").alias("cp"),
        F.encode(F.when(cut, F.regexp_extract(_latin(F.col("body")), _TAIL, 0)).otherwise(""), "ISO-8859-1").alias("tail"),
    )


def sequence_size(lead: int) -> int:
    return 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4


def _sequence_fault(s: bytes, start: int) -> tuple | None:
    """What is wrong with a finished sequence at offset ``start``: kind, offset, byte and code point."""
    cp = s[0] & (0x7F >> len(s))
    for b in s[1:]:
        cp = cp << 6 | b & 0x3F
    if cp < {2: 0x80, 3: 0x800, 4: 0x10000}[len(s)]:
        return "utf8OverlongEncoding", start, None, None
    if 0xD800 <= cp <= 0xDFFF:
        return "utf8Surrogate", start + 2, None, cp
    return ("utf8BeyondMaxCodepoint", start + 3, None, cp) if cp > 0x10FFFF else None


def fold(pending: bytes, base: int, piece: tuple) -> tuple[bytes, tuple | None]:
    """The unfinished sequence after a piece that starts at ``base``, and the first fault, if any.

    ``piece`` is ``(n, head, after, kind, offset, byte, cp, tail)`` of ``summaries``.
    """
    n, head, after, kind, offset, byte, cp, tail = piece
    need = sequence_size(pending[0]) - len(pending) if pending else 0
    if len(head) < need:
        if n == len(head):  # nothing but continuation bytes
            return pending + head, None
        return b"", ("utf8InvalidContinuation", base + len(head), after[0], None)
    if need and (fault := _sequence_fault(pending + head[:need], base - len(pending))):
        return b"", fault
    if len(head) > need:
        return b"", ("utf8InvalidStartByte", base + need, head[need], None)
    return tail, None if kind is None else (kind, base + offset, byte, cp)


class _Decoder(StatefulProcessor):
    """Keeps a document's place: next number, offset, unfinished sequence, whether it is settled and how many pieces wait; and pieces that came too early.

    Pieces of a batch are taken in order from memory. Only those that have to wait for others are put into the state, and it is
    looked into only where some wait, so a document that comes whole costs one read and one write.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.place = handle.getValueState("place", "next long, base long, pending binary, settled boolean, ended long, waiting long")
        self.early = handle.getMapState("early", "seq long", "n long, head binary, after binary, kind string, offset long, byte int, cp int, tail binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        after, base, pending, settled, ended, waiting = self.place.get() or (0, 0, b"", False, None, 0)
        if settled:
            return
        come: dict[int, tuple] = {}
        for row in rows:
            if row.last:
                ended = row.seq
            if row.seq >= after:
                come.setdefault(row.seq, (row.n, row.head, row.after, row.kind, row.offset, row.byte, row.cp, row.tail))
        fault = None
        while fault is None:
            piece = None
            if waiting and self.early.containsKey((after,)):  # the piece that came first stands
                piece = tuple(self.early.getValue((after,)))
                self.early.removeKey((after,))
                waiting -= 1
                come.pop(after, None)
            elif (piece := come.pop(after, None)) is None:
                break
            pending, fault = fold(bytes(pending), base, piece)
            base, after = base + piece[0], after + 1
        done = ended is not None and after > ended
        if fault is None and done and pending:
            fault = ("utf8TruncatedSequence", base, None, None)
        settled = done or fault is not None
        if settled and waiting:
            self.early.clear()
            waiting = 0
        for seq, piece in () if settled else come.items():
            if not waiting or not self.early.containsKey((seq,)):
                self.early.updateValue((seq,), piece)
                waiting += 1
        self.place.update((after, base, bytes(pending), settled, ended, waiting))
        status = "rejected" if fault else "ok" if settled else "incomplete"
        lacks = sequence_size(pending[0]) - len(pending) if pending else 0
        kind, offset, byte, cp = fault or (None,) * 4
        yield Row(key=key[0], status=status, kind=kind, offset=offset, byte=byte, cp=cp, needed=None if settled else lacks, n_bytes=base)

    def close(self) -> None:
        pass


def stream_verdicts(stream: DataFrame, key: str, seq: str = "seq", data: str = "data", last: str = "last") -> DataFrame:
    """Verdicts of documents whose pieces arrive in a stream, in any order, once or more often: ``key, verdict``.

    A document gives a row in each batch that brings pieces of it, until it is ok or rejected. ``n_bytes`` counts the
    bytes decoded without a gap so far. State is a few bytes for each document, and a summary for each piece
    that came before its turn; it survives restarts with the query's checkpoint. Needs the RocksDB state store.
    """
    ship(stream.sparkSession)
    found = summaries(stream, key, seq, data, last)
    kind = found.schema["key"].dataType.simpleString()
    out = found.groupBy("key").transformWithState(
        statefulProcessor=_Decoder(), outputStructType=f"key {kind}, status string, kind string, offset long, byte int, cp int, needed int, n_bytes long", outputMode="Update", timeMode="None",
    )
    reason = F.when(F.col("kind").isNotNull(), F.struct("kind", "offset", "byte", "cp"))
    return out.select(F.col("key").alias(key), F.struct("status", reason.alias("reason"), "needed", "n_bytes").alias("verdict"))
