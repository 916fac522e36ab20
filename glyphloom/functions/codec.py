"""Code points, encodings, byte order marks and forbidden characters, as expressions.

Every function takes and returns columns; a null input gives null. Positions are 0-based.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..tables import icu

NONCHARACTER = icu.char_class((0xFDD0, 0xFDEF), *[(p << 16 | 0xFFFE, p << 16 | 0xFFFF) for p in range(17)])
#: Forbidden categories in order of precedence, with the code points of each.
FORBIDDEN = (
    ("bidi_override", ((0x202A, 0x202E),)),
    ("bidi_isolate", ((0x2066, 0x2069),)),
    ("zero_width", ((0x200B, 0x200F),)),
    ("bom", (0xFEFF,)),
    ("tag", ((0xE0000, 0xE007F),)),
    ("variation_selector", ((0xFE00, 0xFE0F), (0xE0100, 0xE01EF))),
    ("hangul_filler", (0xFFA0, 0x3164)),
    ("soft_hyphen", (0xAD,)),
    ("interlinear", ((0xFFF9, 0xFFFB),)),
    ("mongolian_vowel_separator", (0x180E,)),
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def chars(s: Column) -> Column:
    """The characters of a string."""
    return F.when(s == "", F.array().cast("array<string>")).otherwise(F.split(s, ""))


def codepoints(s: Column) -> Column:
    return F.transform(chars(s), lambda c: F.ascii(c))


def from_codepoints(cps: Column) -> Column:
    """A string from scalar values; null where one is a surrogate or out of range."""
    ok = F.forall(cps, lambda c: ((c >= 0) & (c < 0xD800)) | ((c > 0xDFFF) & (c <= 0x10FFFF)))
    hexed = F.array_join(F.transform(cps, lambda c: F.lpad(F.hex(c), 8, "0")), "")
    return F.when(ok, F.decode(F.unhex(hexed), "UTF-32"))


def utf8_valid(data: Column) -> Column:
    return F.is_valid_utf8(data.cast("string"))


_UTF8 = (
    r"(?:[\x00-\x7F]++|(?:[\xC2-\xDF][\x80-\xBF])++|\xE0[\xA0-\xBF][\x80-\xBF]|[\xE1-\xEC\xEE\xEF][\x80-\xBF]{2}|\xED[\x80-\x9F][\x80-\xBF]"
    r"|\xF0[\x90-\xBF][\x80-\xBF]{2}|[\xF1-\xF3][\x80-\xBF]{3}|\xF4[\x80-\x8F][\x80-\xBF]{2})"
)


def byte_fault(s: Column) -> Column:
    """``(kind, offset)`` of the first byte that breaks UTF-8 in bytes spelt as U+0000 to U+00FF; nulls without one."""
    return let(F.length(F.regexp_extract(s, f"^{_UTF8}*+", 0)), lambda at: _fault_at(s, at))


def _fault_at(s: Column, at: Column) -> Column:
    rest = F.substring(s, at + 1, F.lit(4))
    need = F.when(rest.rlike(r"^[\xC2-\xDF]"), 1).when(rest.rlike(r"^[\xE0-\xEF]"), 2).otherwise(3)
    have = F.least(need, F.length(F.regexp_extract(rest, r"^(?s:.)([\x80-\xBF]*)", 1)))
    stop = at + 1 + have
    rules = (
        (at == F.length(s), F.lit(None).cast("string"), F.lit(None).cast("int")),
        (rest.rlike(r"^[\x80-\xC1\xF5-\xFF]"), F.lit("InvalidStartByte"), at),
        ((have < need) & (stop == F.length(s)), F.lit("Truncated"), stop),
        (have < need, F.lit("InvalidContinuation"), stop),
        (rest.rlike(r"^\xED"), F.lit("Cesu8"), at + 2),
        (rest.rlike(r"^\xF4"), F.lit("CodepointBeyondMax"), at + 3),
        (F.lit(True), F.lit("Overlong"), at),
    )
    found = None
    for condition, kind, offset in rules:
        one = F.struct(kind.alias("kind"), offset.cast("int").alias("offset"))
        found = F.when(condition, one) if found is None else found.when(condition, one)
    return found


def first_invalid_utf8(data: Column) -> Column:
    """``(kind, offset)`` of the first invalid byte of a binary column, nulls where it is valid."""
    return byte_fault(F.decode(data, "ISO-8859-1"))


def utf16(s: Column, little: bool = False) -> Column:
    return F.encode(s, "UTF-16LE" if little else "UTF-16BE")


def utf32(s: Column, little: bool = False) -> Column:
    return _turned(F.encode(F.reverse(s), "UTF-32")) if little else F.encode(s, "UTF-32")


#: Four bytes that tell or look like the order of the others.
_ORDER_MARKS = (b"\xff\xfe\x00\x00", b"\x00\x00\xfe\xff")


def _turned(data: Column) -> Column:
    """Bytes in reverse order; those of a reversed text keep its order and turn round in each word."""
    return F.encode(F.reverse(F.decode(data, "ISO-8859-1")), "ISO-8859-1")


def decode_utf16(data: Column, little: bool = False) -> Column:
    return F.decode(data, "UTF-16LE" if little else "UTF-16BE")


def decode_utf32(data: Column, little: bool = False) -> Column:
    if not little:
        return F.decode(data, "UTF-32")
    words = F.decode(F.unhex(F.regexp_replace(F.hex(data), "(..)(..)(..)(..)", "$4$3$2$1")), "UTF-32")
    # a mark at either end and odd lengths are left to the words one by one
    ends = (F.substring(data, F.lit(1), F.lit(4)), F.substring(data, F.octet_length(data) - 3, F.lit(4)))
    marked = ends[0].isin(*_ORDER_MARKS) | ends[1].isin(*_ORDER_MARKS)
    return F.when((F.octet_length(data) % 4 != 0) | marked, words).otherwise(F.reverse(F.decode(_turned(data), "UTF-32")))


def bom_kind(data: Column) -> Column:
    """Kind of the byte order mark, four-byte marks first; null without one."""
    h = F.hex(data)
    return (
        F.when(h.startswith("0000FEFF"), "UTF-32BE").when(h.startswith("FFFE0000"), "UTF-32LE").when(h.startswith("EFBBBF"), "UTF-8")
        .when(h.startswith("FEFF"), "UTF-16BE").when(h.startswith("FFFE"), "UTF-16LE")
    )


def bom_length(data: Column) -> Column:
    kind = bom_kind(data)
    return F.when(kind.startswith("UTF-32"), 4).when(kind == "UTF-8", 3).when(kind.isNotNull(), 2).otherwise(0)


def strip_bom(data: Column) -> Column:
    return F.unhex(F.substring(F.hex(data), bom_length(data) * 2 + 1, F.length(data) * 2))


#: Characters of a block that is searched for positions.
_BLOCK = 256


def positions(s: Column, char_class: str) -> Column:
    """0-based positions of the characters in a class; the scan is skipped without any.

    Only blocks with a hit are looked into, and there only the gaps between hits are counted.
    """
    cls, none = char_class if char_class.startswith("[") else f"[{char_class}]", F.array().cast("array<int>")

    def within(block: Column, first: Column) -> Column:
        gaps = F.regexp_extract_all(block, F.lit(f"({_others(cls)}*+){cls}"), F.lit(1))
        start = F.struct(first.cast("int").alias("at"), none.alias("out"))

        def step(a: Column, gap: Column) -> Column:
            hit = a["at"] + F.length(gap)
            return F.struct((hit + 1).alias("at"), F.array_append(a["out"], hit).alias("out"))

        return F.aggregate(gaps, start, step, lambda a: a["out"])

    blocks = F.regexp_extract_all(s, F.lit(f"((?s:.){{1,{_BLOCK}}})"), F.lit(1))
    found = F.flatten(F.transform(blocks, lambda b, k: F.when(b.rlike(cls), within(b, k * _BLOCK)).otherwise(none)))
    return F.when(s.isNull(), None).when(s.rlike(cls), found).otherwise(none)


def _others(char_class: str) -> str:
    return f"[^{char_class[1:]}" if not char_class.startswith("[^") else f"[{char_class[2:]}"


def before_first(s: Column, char_class: str) -> Column:
    """The text before the first character of a class, all of it without one."""
    return F.regexp_extract(s, f"^{_others(char_class)}*+", 0)


def first_position(s: Column, char_class: str) -> Column:
    """0-based position of the first character in a class, or null."""
    return F.when(s.rlike(char_class), F.length(before_first(s, char_class)))


def noncharacters(s: Column) -> Column:
    return positions(s, NONCHARACTER)


def forbidden_kind(cp: Column) -> Column:
    """The first forbidden category of a code point, or null."""
    kind = None
    for name, spans in FORBIDDEN:
        hit = F.lit(False)
        for x in spans:
            a, b = (x, x) if isinstance(x, int) else x
            hit = hit | cp.between(a, b)
        kind = F.when(hit, name) if kind is None else kind.when(hit, name)
    for a, b in icu.ranges("[:DI:]"):
        kind = kind.when(cp.between(a, b), "default_ignorable")
    return kind


def forbidden_class() -> str:
    spans = [x for _, group in FORBIDDEN for x in group]
    return icu.char_class(*spans, *icu.ranges("[:DI:]"))


def first_forbidden(s: Column) -> Column:
    """Byte offset, code point and category of the first forbidden character, or null."""
    cls = forbidden_class()

    def found(before: Column) -> Column:
        # the category asks for the code point dozens of times
        kind = lambda cp: F.struct(F.octet_length(before).alias("offset"), cp.alias("cp"), forbidden_kind(cp).alias("kind"))
        return let(F.ascii(F.substring(s, F.length(before) + 1, F.lit(1))), kind)

    return F.when(s.rlike(cls), let(before_first(s, cls), found))


def has_forbidden_control(s: Column) -> Column:
    """Control bytes other than tab and line feed, or DEL."""
    return s.rlike(r"[\x00-\x08\x0B-\x1F\x7F]")


def first_control(s: Column) -> Column:
    """``(offset, byte)`` of the first control byte, offsets in UTF-8; nulls without one."""
    before = before_first(s, r"[\x00-\x08\x0B-\x1F\x7F]")
    at = F.when(has_forbidden_control(s), F.struct(F.octet_length(before).alias("offset"), F.ascii(F.substring(s, F.length(before) + 1, F.lit(1))).alias("byte")))
    return at


def printable(data: Column, max_bytes: int | None = None) -> Column:
    """Valid UTF-8 in NFC without controls or forbidden characters, within a size."""
    from .normalize import is_form

    s = F.try_validate_utf8(data.cast("string"))
    ok = s.isNotNull() & ~has_forbidden_control(s) & ~s.rlike(forbidden_class()) & is_form(s, "NFC")
    return F.coalesce(ok if max_bytes is None else ok & (F.octet_length(data) <= max_bytes), F.lit(False))


def utf8_blob(data: Column, max_bytes: int) -> Column:
    return F.coalesce(utf8_valid(data) & (F.octet_length(data) <= max_bytes), F.lit(False))


def ascii_identifier(s: Column, max_bytes: int | None = None) -> Column:
    ok = s.rlike(r"^[A-Za-z_][A-Za-z0-9_]*\z")
    return ok if max_bytes is None else ok & (F.octet_length(s) <= max_bytes)


def nfc_bytes(data: Column) -> Column:
    """UTF-8 bytes in NFC; null where they are no UTF-8."""
    from .normalize import nfc

    return F.encode(nfc(F.try_validate_utf8(data.cast("string"))), "UTF-8")


def is_nfc_bytes(data: Column) -> Column:
    """Whether bytes are UTF-8 in NFC."""
    return F.when(data.isNotNull(), F.coalesce(nfc_bytes(data) == data, F.lit(False)))
