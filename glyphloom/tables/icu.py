"""Unicode property data from the ICU library on Spark's class path (Unicode 16).

Sets come from the driver as patterns for Java regular expressions, so that membership
tests run inside Spark's own expressions. Per-code-point tables are Spark jobs over the
code space.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UCHAR = "com.ibm.icu.lang.UCharacter"
#: Property numbers of ICU's public UProperty interface.
PROPERTY = {
    "Bidi_Class": 0x1000, "Canonical_Combining_Class": 0x1002, "Decomposition_Type": 0x1003, "East_Asian_Width": 0x1004, "General_Category": 0x1005,
    "Joining_Type": 0x1007, "Line_Break": 0x1008, "Script": 0x100A, "Grapheme_Cluster_Break": 0x1012, "Sentence_Break": 0x1013,
    "Word_Break": 0x1014, "Indic_Conjunct_Break": 0x101A, "Vertical_Orientation": 0x1018,
}


@lru_cache(maxsize=None)
def ranges(pattern: str) -> tuple[tuple[int, int], ...]:
    """Inclusive code-point ranges of an ICU set pattern, single code points only."""
    found = SparkSession.active()._jvm.com.ibm.icu.text.UnicodeSet(pattern)
    text = found.removeAllStrings().complement().complement().toPattern(True)
    return tuple(_parse(text)) if not found.isEmpty() else ()


def _parse(text: str):
    """Ranges of an escaped set pattern that is not negated."""
    body = text[1:-1]
    token = re.compile(r"\\U([0-9A-Fa-f]{8})|\\u([0-9A-Fa-f]{4})|\\x([0-9A-Fa-f]{2})|\\(.)|(-)|(.)", re.S)
    if body.startswith("^"):
        last = -1
        for a, b in _parse("[" + body[1:] + "]"):
            if a > last + 1:
                yield last + 1, a - 1
            last = b
        if last < 0x10FFFF:
            yield last + 1, 0x10FFFF
        return
    low, dash = None, False
    for m in token.finditer(body):
        if m[5]:
            dash = True
            continue
        cp = int(m[1] or m[2] or m[3], 16) if (m[1] or m[2] or m[3]) else ord(m[4] or m[6])
        if dash:
            yield low, cp
            low, dash = None, False
        else:
            if low is not None:
                yield low, low
            low = cp
    if low is not None:
        yield low, low


def char_class(*spans: tuple[int, int] | int, negated: bool = False) -> str:
    """A Java regular-expression class of code-point ranges.

    Java tests a class's ranges one after the other, so many ranges become a tree: a group
    of them is looked into only for characters between its ends.
    """
    pairs = [(s, s) if isinstance(s, int) else s for s in spans]
    if not pairs:  # matches nothing, or anything
        return "[\\x{0}-\\x{10FFFF}]" if negated else "[^\\x{0}-\\x{10FFFF}]"
    ordered = sorted(pairs) if len(pairs) > _LEAF else pairs
    return f"[{'^' if negated else ''}{_body(ordered)}]"


#: Ranges that a class tests in a row, and groups that a long list is cut into.
_LEAF, _FAN = 6, 4


def _body(pairs: list[tuple[int, int]]) -> str:
    if len(pairs) <= _LEAF:
        return "".join(f"\\x{{{a:X}}}" if a == b else f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in pairs)
    step = -(-len(pairs) // _FAN)
    groups = [pairs[i : i + step] for i in range(0, len(pairs), step)]
    return "".join(f"[\\x{{{g[0][0]:X}}}-\\x{{{max(b for _, b in g):X}}}&&[{_body(g)}]]" for g in groups)


@lru_cache(maxsize=None)
def regex(pattern: str, negated: bool = False) -> str:
    """A Java regular-expression class equal to an ICU set pattern."""
    return char_class(*ranges(pattern), negated=negated)


@lru_cache(maxsize=None)
def strings(pattern: str) -> tuple[str, ...]:
    """The multi-character strings of an ICU set pattern."""
    jvm = SparkSession.active()._jvm
    found = jvm.com.ibm.icu.text.UnicodeSet(pattern).strings()
    return tuple(jvm.String.join("\u0001", found).split("\u0001")) if found.size() else ()


def _static(cls: str, method: str, *args: Column) -> Column:
    return F.java_method(F.lit(cls), F.lit(method), *args)


def property_value(cp: Column, name: str) -> Column:
    """ICU's number for an enumerated property of a code point; null stays null."""
    value = _static(UCHAR, "getIntPropertyValue", cp.cast("int"), F.lit(PROPERTY[name])).cast("int")
    return F.when(cp.isNotNull(), value)


def simple_upper(cp: Column) -> Column:
    return F.when(cp.isNotNull(), _static(UCHAR, "toUpperCase", cp.cast("int")).cast("int"))


def simple_lower(cp: Column) -> Column:
    return F.when(cp.isNotNull(), _static(UCHAR, "toLowerCase", cp.cast("int")).cast("int"))


def simple_title(cp: Column) -> Column:
    return F.when(cp.isNotNull(), _static(UCHAR, "toTitleCase", cp.cast("int")).cast("int"))


def numeric_value(cp: Column) -> Column:
    """The numeric value of a code point, ideographs among them; null for one without any."""
    value = _static(UCHAR, "getUnicodeNumericValue", cp.cast("int")).cast("double")
    return F.when(value != -123456789.0, value)  # ICU's sign for none


def mirror(cp: Column) -> Column:
    """The code point whose glyph mirrors this one's, itself if there is none."""
    return F.when(cp.isNotNull(), _static(UCHAR, "getMirror", cp.cast("int")).cast("int"))


def paired_bracket(cp: Column) -> Column:
    """The bracket that closes or opens what this one opens or closes, itself if it is none."""
    return F.when(cp.isNotNull(), _static(UCHAR, "getBidiPairedBracket", cp.cast("int")).cast("int"))


def value_aliases(spark: SparkSession, name: str) -> DataFrame:
    """``(short, alias)``: every name of every value of a property, by its short name."""
    jvm = SparkSession.active()._jvm.com.ibm.icu.lang.UCharacter
    number, rows = PROPERTY[name], []
    for value in range(jvm.getIntPropertyMinValue(number), jvm.getIntPropertyMaxValue(number) + 1):
        found: list[str] = []
        for choice in range(16):
            try:
                alias = jvm.getPropertyValueName(number, value, choice)
            except IllegalArgumentException:
                if choice > 1:
                    break
                continue
            if alias:
                found.append(alias)
        rows += [(found[0], alias) for alias in dict.fromkeys(found)]
    return spark.createDataFrame(rows, "short string, alias string").distinct()


def property_aliases(spark: SparkSession) -> DataFrame:
    """``(short, alias)``: every name of every property, by its short name (its long one where it has none).

    Numbers of properties come in ranges by kind; a name is looked up until there is none.
    """
    name = SparkSession.active()._jvm.com.ibm.icu.lang.UCharacter.getPropertyName
    rows = []
    for first, last in ((0, 0x80), (0x1000, 0x1030), (0x2000, 0x2001), (0x3000, 0x3001), (0x4000, 0x4010), (0x7000, 0x7002)):
        for number in range(first, last):
            found: list[str] = []
            for choice in range(16):
                try:
                    alias = name(number, choice)
                except IllegalArgumentException:  # numbers and names that are not there
                    if choice > 1:
                        break
                    continue
                if alias:
                    found.append(alias)
            rows += [(found[0], alias) for alias in dict.fromkeys(found)]
    return spark.createDataFrame(rows, "short string, alias string").distinct()


def value_name(name: str, number: Column, short: bool = True) -> Column:
    """The short (or long) name of a property's value."""
    choice = F.lit(0 if short else 1)
    return F.when(number.isNotNull(), _static(UCHAR, "getPropertyValueName", F.lit(PROPERTY[name]), number.cast("int"), choice))


def property_table(spark: SparkSession, name: str, partitions: int = 8) -> DataFrame:
    """``(cp, value)`` for every code point, as a Spark job over the code space."""
    cps = spark.range(0, 0x110000, 1, partitions).select(F.col("id").cast("int").alias("cp"))
    return cps.withColumn("value", value_name(name, property_value(F.col("cp"), name)))


def range_table(spark: SparkSession, name: str) -> DataFrame:
    """``(lo, hi, value)``: maximal runs of code points with one value of a property."""
    table = property_table(spark, name)
    # a run is a maximal set of code points whose rank among their value's keeps step with them
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("value").orderBy("cp"))
    runs = table.withColumn("run", F.col("cp") - rank)
    return runs.groupBy("value", "run").agg(F.min("cp").alias("lo"), F.max("cp").alias("hi")).select("lo", "hi", "value")


def prototypes(spark: SparkSession) -> dict[int, str]:
    """Confusable prototypes: code point to string, for those that differ from themselves.

    One call skeletonises every candidate. Code points that ICU drops because they are
    default-ignorable have no prototype here.
    """
    jvm = spark._jvm
    checker = jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
    todo = [cp for a, b in ranges(r"[[:^Cn:]&[:^Co:]&[:^Cs:]-[:DI:]-[:NFD_QC=N:]]") for cp in range(a, b + 1) if cp != 1]
    out: dict[int, str] = {}
    for low in range(0, len(todo), 50_000):
        part = todo[low : low + 50_000]
        found = checker.getSkeleton("\u0001".join(map(chr, part))).split("\u0001")
        if len(found) != len(part):
            raise ValueError("ICU's skeletons do not line up with their characters")
        out.update({cp: s for cp, s in zip(part, found) if s and s != chr(cp)})
    return out
