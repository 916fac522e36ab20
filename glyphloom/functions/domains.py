"""Domain labels, IDNA mapping and Punycode."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from ..tables import icu
from .codec import let
from .identifiers import bidi_label, bidi_rule
from .normalize import nfc

# RFC 3492 parameters.
BASE, TMIN, TMAX, SKEW, DAMP, BIAS, FIRST = 36, 1, 26, 38, 700, 72, 128
_DIGITS = "abcdefghijklmnopqrstuvwxyz0123456789"
#: Deviation characters of UTS #46 and their transitional mapping.
DEVIATIONS = {"ß": "ss", "ς": "σ", "‌": "", "‍": ""}


def _adapt(delta: int, points: int, first: bool) -> int:
    delta = delta // DAMP if first else delta // 2
    delta += delta // points
    k = 0
    while delta > (BASE - TMIN) * TMAX // 2:
        delta //= BASE - TMIN
        k += BASE
    return k + (BASE - TMIN + 1) * delta // (delta + SKEW)


def _limit(k: int, bias: int) -> int:
    return min(max(k - bias, TMIN), TMAX)


def punycode_encode(label: str) -> str:
    """RFC 3492 encoding; a label of basic characters only is itself."""
    basic = [c for c in label if ord(c) < FIRST]
    if len(basic) == len(label):
        return label
    out = basic + (["-"] if basic else [])
    n, delta, bias, done = FIRST, 0, BIAS, len(basic)
    while done < len(label):
        m = min(ord(c) for c in label if ord(c) >= n)
        delta += (m - n) * (done + 1)
        n = m
        for c in map(ord, label):
            if c < n:
                delta += 1
            elif c == n:
                q, k = delta, BASE
                while q >= (t := _limit(k, bias)):
                    out.append(_DIGITS[t + (q - t) % (BASE - t)])
                    q, k = (q - t) // (BASE - t), k + BASE
                out.append(_DIGITS[q])
                bias, delta, done = _adapt(delta, done + 1, done == len(basic)), 0, done + 1
        delta, n = delta + 1, n + 1
    return "".join(out)


def punycode_decode(text: str) -> str | None:
    """RFC 3492 decoding; null where the text is none."""
    head, _, tail = text.rpartition("-")
    out = list(head)
    if any(ord(c) >= FIRST for c in text):
        return None
    n, i, bias, at = FIRST, 0, BIAS, 0
    while at < len(tail):
        start, weight, k = i, 1, BASE
        while True:
            digit = _DIGITS.find(tail[at].lower()) if at < len(tail) else -1
            if digit < 0:
                return None
            at, i = at + 1, i + digit * weight
            if digit < (t := _limit(k, bias)):
                break
            weight, k = weight * (BASE - t), k + BASE
        bias = _adapt(i - start, len(out) + 1, start == 0)
        n, i = n + i // (len(out) + 1), i % (len(out) + 1)
        if n > 0x10FFFF or 0xD800 <= n < 0xE000:
            return None
        out.insert(i, chr(n))
        i += 1
    return "".join(out)


def _series(f) -> Column:
    @F.pandas_udf("string")
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(f, na_action="ignore")

    ship()
    return apply


def punycode(s: Column, decode: bool = False) -> Column:
    return _series(punycode_decode if decode else punycode_encode)(s)


@lru_cache(maxsize=1)
def _mapping() -> tuple[dict[int, str], str]:
    """UTS #46 mappings by code point, and a class of disallowed code points."""
    normalizer = SparkSession.active()._jvm.com.ibm.icu.text.Normalizer2.getInstance(None, "uts46", SparkSession.active()._jvm.com.ibm.icu.text.Normalizer2.Mode.COMPOSE)
    todo = [cp for a, b in icu.ranges(r"[[:CWKCF:][:DI:][:NFKC_QC=N:][[:C:]-[:Cn:]][:Z:]]") for cp in range(a, b + 1) if not 0xD800 <= cp < 0xE000 and not 0xE000 <= cp < 0xF900 and cp < 0xF0000]
    done = normalizer.normalize("\u0001".join(map(chr, (c for c in todo if c > 1)))).split("\u0001")
    pairs = list(zip((c for c in todo if c > 1), done))
    mapped = {cp: t for cp, t in pairs if t != chr(cp) and "�" not in t and chr(cp) not in DEVIATIONS}
    barred = [cp for cp, t in pairs if "�" in t]
    return mapped, icu.char_class(*barred, (0xD800, 0xDFFF))


def idna_map(s: Column, transitional: bool = False) -> Column:
    """Map, drop and normalize characters as UTS #46 says; deviations stay unless transitional."""
    table = dict(_mapping()[0])
    if transitional:
        table |= {ord(k): v for k, v in DEVIATIONS.items()}
    single = sorted((cp for cp, t in table.items() if len(t) < 2), key=lambda cp: not table[cp])  # those that are dropped last
    swap = lambda t: F.translate(t, "".join(map(chr, single)), "".join(table[cp] for cp in single))
    longer = {chr(cp): t for cp, t in table.items() if len(t) > 1}
    by_char = F.str_to_map(F.lit("\u0002".join(f"{c}\u0001{t}" for c, t in longer.items())), F.lit("\u0002"), F.lit("\u0001"))
    # what is mapped is not mapped again, so texts with a longer mapping go by character
    mixed = F.array_join(F.transform(F.split(s, ""), lambda c: F.coalesce(F.try_element_at(by_char, c), swap(c))), "")
    return nfc(F.when(s.rlike(icu.char_class(*map(ord, longer))), mixed).otherwise(swap(s)))


def labels(s: Column) -> Column:
    return F.split(s, r"\.")


@dataclass(frozen=True)
class Options:
    """What is checked beyond mapping and Punycode."""

    check_hyphens: bool = True
    check_bidi: bool = True
    check_joiners: bool = True
    std3_rules: bool = True
    transitional: bool = False
    dns_length: bool = True


#: Letters that stand for joining types, and for the joiners themselves: virama, left, right and dual joining, transparent.
JOINING_LETTERS = (("[:ccc=9:]", "V"), ("[:jt=L:]", "L"), ("[:jt=R:]", "R"), ("[:jt=D:]", "D"), ("[:jt=T:]", "T"))
#: A label none of whose joiners is out of place: a non-joiner (n) after a virama or between joining letters with
#: transparent characters in between, a joiner (j) after a virama.
_JOINED = r"^(?:[LD][TV]*+n(?=[TV]*+[RD])|(?<=V)[nj]|[^nj])*+\z"


def joining_letters(s: Column) -> Column:
    """A text as one letter for each character: ``n`` and ``j`` for the joiners, joining types, a dot for all else."""
    marks, taken, out = [], icu.char_class((0x10F000, 0x10F0FF)), F.regexp_replace(s, icu.char_class((0x10F000, 0x10F0FF)), ".")
    for k, (pattern, letter) in enumerate((("[\\u200C]", "n"), ("[\\u200D]", "j"), *JOINING_LETTERS)):
        out = F.regexp_replace(out, icu.regex(pattern), chr(0x10F000 + k))  # what has a letter is no longer in later classes
        marks.append(letter)
    spelt = F.regexp_replace(out, f"[^{taken[1:]}", ".")
    return F.translate(spelt, "".join(chr(0x10F000 + k) for k in range(len(marks))), "".join(marks))


def joiners_in_place(s: Column) -> Column:
    """Whether each zero-width joiner and non-joiner of a label stands where the contextual rules allow one."""
    return F.when(s.rlike("[\u200c\u200d]"), joining_letters(s).rlike(_JOINED)).otherwise(s.isNotNull() | F.lit(None))


def valid_label(label: Column, options: Options = Options()) -> Column:
    """Hyphens, leading mark, STD3 characters, disallowed characters, joiners in their context and the bidi rule."""
    ok = (label != "") & ~label.rlike(f"^{icu.regex('[:M:]')}") & ~label.rlike(_mapping()[1])
    if options.check_hyphens:
        ok = ok & ~label.rlike(r"^-|-\z|^..--")
    if options.std3_rules:
        ok = ok & ~F.regexp_replace(label, r"[^\x00-\x7F]", "").rlike(r"[^a-z0-9-]")
    if options.check_joiners:
        ok = ok & joiners_in_place(label)
    return ok & bidi_rule(label) if options.check_bidi else ok


def host_labels(url: Column) -> Column:
    """Labels of a URL's host, lower case."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return labels(host)


def bidi_domain(s: Column) -> Column:
    """If any label runs right to left, all follow the strict bidi rule."""
    return F.when(bidi_label(s), F.forall(labels(s), lambda x: bidi_rule(x, strict=True))).otherwise(F.lit(True))


def _ascii_domain(domain: str) -> str:
    return ".".join(x if x.isascii() else "xn--" + punycode_encode(x) for x in domain.split("."))


def _unicode_domain(domain: str) -> str:
    """Labels out of Punycode; one that is none, or that needed none, gets a U+FFFD in front."""
    out = []
    for label in domain.split("."):
        if label.startswith("xn--"):
            plain = punycode_decode(label[4:])
            label = "\ufffd" + label if not plain or plain.isascii() else plain
        out.append(label)
    return ".".join(out)


def _decoded_ascii(domain: str) -> str:
    return _ascii_domain(_unicode_domain(domain).replace("\ufffd", ""))


def to_unicode(s: Column, options: Options = Options()) -> Column:
    """``(value, has_errors)``: a domain mapped, with its ``xn--`` labels decoded, and whether a label fails.

    A decoded label has to be in NFC and to map to itself.
    """

    def found(decoded: Column) -> Column:
        fails = ~F.forall(labels(decoded), lambda x: valid_label(x, options)) | decoded.contains("\ufffd") | (idna_map(decoded) != decoded)
        if options.check_bidi:
            fails = fails | ~bidi_domain(decoded)
        return F.struct(F.replace(decoded, F.lit("\ufffd"), F.lit("")).alias("value"), fails.alias("has_errors"))

    # bound once: each place that names a Python function would get its own worker
    return F.when(s.isNotNull(), let(_series(_unicode_domain)(idna_map(s, options.transitional)), found))


def to_ascii_result(s: Column, options: Options = Options()) -> Column:
    """``(value, has_errors)``: a domain in ASCII, given also where a label fails.

    Labels take 1 to 63 bytes and the domain at most 253, a trailing dot counting as an empty label.
    """

    def found(x: Column) -> Column:
        spelt, fails = x["value"], x["has_errors"]
        if options.dns_length:
            fails = fails | (F.length(spelt) > 253) | ~F.forall(labels(spelt), lambda y: F.length(y).between(1, 63))
        return F.struct(spelt.alias("value"), fails.alias("has_errors"))

    # from the text: a second use of the decoded one would decode it again
    spelt = _series(_decoded_ascii)(idna_map(s, options.transitional))
    both = F.struct(spelt.alias("value"), to_unicode(s, options)["has_errors"].alias("has_errors"))
    return F.when(s.isNotNull(), let(both, found))


def to_ascii(s: Column, transitional: bool = False) -> Column:
    """A domain in ASCII: mapped, its labels checked and spelt in Punycode; null where one fails."""
    found = to_ascii_result(s, Options(transitional=transitional))
    return F.when(~found["has_errors"], found["value"])
