"""Registered emoji in running text: the longest registered sequence from each place, by kind."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import icu

#: Kinds of registered sequences and the properties of ICU that list them.
KINDS = {
    "basic": "[:Basic_Emoji:]", "keycap": "[:Emoji_Keycap_Sequence:]", "flag": "[:RGI_Emoji_Flag_Sequence:]", "modifier": "[:RGI_Emoji_Modifier_Sequence:]",
    "tag": "[:RGI_Emoji_Tag_Sequence:]", "zwj": "[:RGI_Emoji_ZWJ_Sequence:]",
}


@lru_cache(maxsize=1)
def sequences() -> dict[str, str]:
    """Every registered sequence with its kind: some four thousand, fixed by the version of Unicode."""
    out = {}
    for kind, pattern in KINDS.items():
        out |= {s: kind for s in icu.strings(pattern)}
        out |= {chr(cp): kind for a, b in icu.ranges(pattern) for cp in range(a, b + 1)}
    return out


def sequence_table(spark: SparkSession) -> DataFrame:
    """``(sequence, kind)`` of all registered emoji."""
    return spark.createDataFrame(list(sequences().items()), "sequence string, kind string")


def _escaped(chars: list[str]) -> str:
    return icu.char_class(*_spans(sorted(map(ord, chars))))


def _spans(cps: list[int]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for cp in cps:
        if out and out[-1][1] == cp - 1:
            out[-1] = (out[-1][0], cp)
        else:
            out.append((cp, cp))
    return out


def trie_pattern(words: list[str]) -> str:
    """A regular expression that matches the longest of ``words`` from a place.

    The words' trie is written from the leaves up; characters that go on alike share a class, so the
    many bases that take the same modifiers are one branch.
    """
    trie: dict = {}
    for word in words:
        node = trie
        for c in word:
            node = node.setdefault(c, {})
        node[""] = {}

    def spelt(node: dict) -> str:
        alike: dict[str, list[str]] = {}
        for c, child in node.items():
            if c:
                alike.setdefault(spelt(child), []).append(c)
        branches = [_escaped(cs) + rest for rest, cs in alike.items()]
        body = "|".join(branches)
        if not branches:
            return ""
        return f"(?:{body})?" if "" in node else f"(?:{body})"

    return spelt(trie)


@lru_cache(maxsize=1)
def rgi_pattern() -> str:
    known = list(sequences())
    return f"(?={_escaped(sorted({s[0] for s in known}))}){trie_pattern(known)}"


def rgi_emoji(s: Column) -> Column:
    """The registered emoji of a text in order: from each place the longest sequence; what is left over is passed by."""
    return F.regexp_extract_all(s, F.lit(f"({rgi_pattern()})"), F.lit(1))


def is_rgi(s: Column) -> Column:
    """Whether the whole text is one registered emoji."""
    return F.regexp_extract(s, f"^{rgi_pattern()}\\z", 0) != ""


def rgi_kinds(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, kind, n``: registered emoji in each row's text by kind.

    Equal emoji of a row are counted in the task that finds them; the table of sequences is a few
    thousand rows whatever the input. Rows without emoji, null and empty texts have no counts.
    """
    found = df.select(F.col(key).alias("key"), F.explode(rgi_emoji(F.col(text))).alias("sequence")).groupBy("key", "sequence").agg(F.count(F.lit(1)).alias("n"))
    kinds = found.join(F.broadcast(sequence_table(df.sparkSession)), "sequence").groupBy("key", "kind").agg(F.sum("n").alias("n"))
    return kinds.select(F.col("key").alias(key), "kind", "n")
