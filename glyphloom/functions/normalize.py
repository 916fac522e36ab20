"""Normalization forms, quick checks and stream-safe text, as expressions over ICU."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..tables import icu
from .codec import chars

_ASCII = r"^[\x00-\x7F]*\z"
HANGUL_BASE, HANGUL_COUNT, V_COUNT, T_COUNT = 0xAC00, 11172, 21, 28
L_BASE, V_BASE, T_BASE = 0x1100, 0x1161, 0x11A7
MAX_NONSTARTERS = 30


def normalized(s: Column, form: str) -> Column:
    """``form`` is NFC, NFD, NFKC or NFKD. ASCII text is returned as it is."""
    method = "compose" if form.endswith("C") else "decompose"
    done = F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit(method), s, F.lit("K" in form))
    return F.when(s.isNull(), None).when(s.rlike(_ASCII), s).otherwise(done)


def nfc(s: Column) -> Column:
    return normalized(s, "NFC")


def nfd(s: Column) -> Column:
    return normalized(s, "NFD")


def nfkc(s: Column) -> Column:
    return normalized(s, "NFKC")


def nfkd(s: Column) -> Column:
    return normalized(s, "NFKD")


def is_form(s: Column, form: str) -> Column:
    return s == normalized(s, form)


def quick_check(s: Column, form: str) -> Column:
    """True when every character is certain to be allowed and marks are in order.

    A character that is only maybe allowed counts as a failure.
    """
    never = icu.regex(f"[[:{form}_QC=N:][:{form}_QC=M:]]" if form.endswith("C") else f"[:{form}_QC=N:]")
    return F.when(s.isNull(), None).otherwise(~s.rlike(never) & marks_ordered(s))


def combining_class(c: Column) -> Column:
    """Canonical combining class of a character."""
    return icu.property_value(F.ascii(c), "Canonical_Combining_Class")


def marks_ordered(s: Column) -> Column:
    """Whether combining classes never fall within a run of non-starters."""
    marks = icu.regex("[:^ccc=0:]")
    runs = F.regexp_extract_all(s, F.lit(f"({marks}{{2,}})"), F.lit(1))
    classes = F.transform(runs, lambda r: F.transform(chars(r), combining_class))
    return F.when(s.rlike(f"{marks}{{2}}"), F.forall(classes, lambda k: k == F.array_sort(k))).otherwise(F.lit(True))


def is_stream_safe(s: Column) -> Column:
    return ~s.rlike(icu.regex("[:^ccc=0:]") + f"{{{MAX_NONSTARTERS + 1}}}")


def stream_safe(s: Column) -> Column:
    """Put U+034F before every non-starter that would be the 31st of a run."""
    marks = icu.regex("[:^ccc=0:]")
    return F.regexp_replace(s, f"({marks}{{{MAX_NONSTARTERS}}})(?={marks})", "$1͏")


def hangul_parts(cp: Column) -> Column:
    """The jamo of a precomposed syllable, or null."""
    i = cp - HANGUL_BASE
    lead = F.floor(i / (V_COUNT * T_COUNT)) + L_BASE
    vowel = F.floor(i % (V_COUNT * T_COUNT) / T_COUNT) + V_BASE
    tail = i % T_COUNT
    two = F.array(lead, vowel).cast("array<int>")
    parts = F.when(tail == 0, two).otherwise(F.array_append(two, (tail + T_BASE).cast("int")))
    return F.when(cp.between(HANGUL_BASE, HANGUL_BASE + HANGUL_COUNT - 1), parts)


def hangul_composed(cps: Column) -> Column:
    """Code points with jamo composed to syllables: a lead and a vowel, and a tail after these."""
    lead = lambda c: c.between(L_BASE, L_BASE + HANGUL_COUNT // (V_COUNT * T_COUNT) - 1)
    vowel = lambda c: c.between(V_BASE, V_BASE + V_COUNT - 1)
    tail = lambda c: c.between(T_BASE + 1, T_BASE + T_COUNT - 1)
    at = lambda i: F.coalesce(F.get(cps, i), F.lit(-1))

    def one(c: Column, i: Column) -> Column:
        base = (c - L_BASE) * (V_COUNT * T_COUNT) + (at(i + 1) - V_BASE) * T_COUNT + HANGUL_BASE
        starts = lead(c) & vowel(at(i + 1))
        whole = F.when(tail(at(i + 2)), base + at(i + 2) - T_BASE).otherwise(base)
        taken = (vowel(c) & lead(at(i - 1))) | (tail(c) & vowel(at(i - 1)) & lead(at(i - 2)))
        return F.when(starts, whole).when(~taken, c)

    return F.array_compact(F.transform(cps, one)).cast("array<int>")
