"""Strict parses of binary columns: ok, or rejected with the first reason as a tagged struct.

Gates stand in a fixed order, size before encoding before characters before form, and the first that fails
names the reason with its byte offset and the fields that belong to it; the others are null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..streaming.utf8_chunks import reject_reason
from .codec import first_control, first_forbidden, let
from .normalize import nfc

FIELDS = {"offset": "long", "byte": "int", "cp": "int", "category": "string", "actual": "long", "limit": "long"}


def reason(kind: str | Column, **fields: Column) -> Column:
    """A tagged reason with the given fields."""
    name = F.lit(kind) if isinstance(kind, str) else kind
    return F.struct(name.alias("kind"), *[fields.get(f, F.lit(None)).cast(t).alias(f) for f, t in FIELDS.items()])


def result(data: Column, why: Column) -> Column:
    """``(status, reason)`` of a value: ok or rejected, null for null."""
    return F.when(data.isNotNull(), let(why, lambda r: F.struct(F.when(r.isNull(), "ok").otherwise("rejected").alias("status"), r.alias("reason"))))


def _size(data: Column, limit: int | None) -> Column:
    n = F.octet_length(data)
    return F.when(F.lit(False) if limit is None else n > limit, reason("sizeExceeded", actual=n, limit=F.lit(limit)))


def _encoding(data: Column) -> Column:
    why = let(reject_reason(data), lambda r: F.when(r.isNotNull(), reason(r["kind"], offset=r["offset"], byte=r["byte"], cp=r["cp"])))
    return F.when(~F.is_valid_utf8(data.cast("string")), why)  # where the fault is, is asked of faulty bytes alone


def blob_result(data: Column, limit: int | None = None) -> Column:
    """Text of a size, in UTF-8."""
    return result(data, F.coalesce(_size(data, limit), _encoding(data)))


def _hidden(f: Column) -> Column:
    narrow = reason("forbiddenCodepoint", offset=f["offset"], cp=f["cp"], category=f["kind"])
    return F.when(f["kind"] == "default_ignorable", reason("defaultIgnorable", offset=f["offset"], cp=f["cp"])).when(f.isNotNull(), narrow)


def printable_result(data: Column, limit: int | None = None) -> Column:
    """Text to be shown: in UTF-8, without controls but tab and line feed, without forbidden characters, in NFC."""
    s = F.try_validate_utf8(data.cast("string"))
    control = let(first_control(s), lambda c: F.when(c.isNotNull(), reason("nonPrintableAsciiByte", offset=c["offset"], byte=c["byte"])))
    form = let(nfc(s), lambda n: F.when(n != s, reason("notNfcNormalized", offset=_parting(s, n))))
    return result(data, F.coalesce(_size(data, limit), _encoding(data), control, let(first_forbidden(s), _hidden), form))


def _parting(a: Column, b: Column) -> Column:
    """Byte offset of the first character in which two texts differ."""
    from ..operators.detectors import first_difference

    return F.octet_length(F.substring(a, F.lit(1), first_difference(a, b)))


def _byte(s: Column, at: Column) -> Column:
    return F.ascii(F.substring(s, at + 1, F.lit(1)))


def _after(s: Column, pattern: str, kind: str) -> Column:
    """The byte after what a pattern takes from the start, if there is one."""
    return let(F.length(F.regexp_extract(s, pattern, 0)), lambda at: F.when(at < F.length(s), reason(kind, offset=at, byte=_byte(s, at))))


def identifier_result(data: Column, limit: int | None = None) -> Column:
    """An ASCII identifier: a letter or underscore, then these and digits."""
    s = F.decode(data, "ISO-8859-1")
    empty = F.when(s == "", reason("identifierEmpty"))
    start = F.when(~s.rlike("^[A-Za-z_]"), reason("nonIdentifierStartByte", offset=F.lit(0), byte=_byte(s, F.lit(0))))
    return result(data, F.coalesce(empty, _size(data, limit), start, _after(s, "^[A-Za-z_][A-Za-z0-9_]*+", "nonIdentifierContinueByte")))


def ascii_result(data: Column, limit: int | None = None) -> Column:
    """Printable ASCII: no byte of 128 or more, none below 32 and no DEL."""
    s = F.decode(data, "ISO-8859-1")
    return result(data, F.coalesce(_size(data, limit), _after(s, r"^[\x00-\x7F]*+", "nonAsciiByte"), _after(s, r"^[^\x00-\x1F\x7F]*+", "nonPrintableAsciiByte")))


def in_container(inner: Column, at: Column) -> Column:
    """The result of a container's element that starts at byte ``at``: its reason's offset counts from the container's start."""
    r = inner["reason"]
    moved = F.when(r.isNotNull(), reason(r["kind"], **{f: (r[f] + at if f == "offset" else r[f]) for f in FIELDS}))
    return F.when(inner.isNotNull(), F.struct(inner["status"].alias("status"), moved.alias("reason")))
