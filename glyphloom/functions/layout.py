"""Display width, vertical orientation, emoji and bidi controls, as expressions."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..tables import icu
from .codec import codepoints

BIDI_CONTROL = icu.char_class((0x202A, 0x202E), (0x2066, 0x2069))
VARIATION_SELECTOR = icu.char_class((0xFE00, 0xFE0F), (0xE0100, 0xE01EF), (0x180B, 0x180D))
TAG = icu.char_class((0xE0000, 0xE007F))
ZWJ = "‍"


def _count(s: Column, cls: str) -> Column:
    return F.regexp_count(s, F.lit(cls))


def display_width(s: Column, wide_ambiguous: bool = False) -> Column:
    """Columns that a text takes: wide and full-width two, controls and marks none."""
    none = icu.regex(r"[[:Cc:][:Mn:][:Me:]‌‍︀-️]")
    wide = "[[:ea=W:][:ea=F:]" + ("[:ea=A:]" if wide_ambiguous else "") + "]"
    two = icu.regex(f"[{wide}-[[:Cc:][:Mn:][:Me:]\\u200C\\u200D\\uFE00-\\uFE0F]]")
    plain = s.rlike(r"^[\x20-\x7E]*\z")
    latin = F.lit(not wide_ambiguous) & s.rlike(r"^[\x{0}-\x{FF}]*\z")  # only controls have no width there
    return F.when(plain, F.length(s)).when(latin, F.length(s) - _count(s, r"[\x00-\x1F\x7F-\x{9F}]")).otherwise(F.length(s) - _count(s, none) + _count(s, two))


def _emoji_cluster() -> str:
    """What makes a cluster an emoji: a character shown as one, a pictograph, an emoji selector or a regional indicator."""
    return icu.regex(r"[[:Emoji_Presentation:][:ExtPict:]\uFE0F\U0001F1E6-\U0001F1FF]")


def cluster_width(cluster: Column, wide_ambiguous: bool = False) -> Column:
    """Columns that one grapheme cluster takes: two for emoji, else those of its widest character."""
    none = icu.regex(r"[[:Cc:][:Mn:][:Me:]‌‍︀-️]")
    wide = "[[:ea=W:][:ea=F:]" + ("[:ea=A:]" if wide_ambiguous else "") + "]"
    two = icu.regex(f"[{wide}-[[:Cc:][:Mn:][:Me:]\\u200C\\u200D\\uFE00-\\uFE0F]]")
    return F.when(cluster.rlike(_emoji_cluster()), 2).when(cluster.rlike(two), 2).when(cluster.rlike(f"[^{none[1:]}"), 1).otherwise(0)


def display_width_clusters(s: Column, wide_ambiguous: bool = False) -> Column:
    """Columns that a text takes, cluster by cluster: a joined emoji takes two, a letter with its marks those of the letter.

    Latin text has clusters of one character but for line ends, and needs no cutting.
    """
    from . import segments

    emoji = F.regexp_count(s, F.lit("[©®]"))
    latin = F.lit(not wide_ambiguous) & s.rlike(r"^[\x{0}-\x{FF}]*\z")
    short = F.length(s) - _count(s, r"[\x00-\x1F\x7F-\x{9F}]") + emoji
    # a run of simple clusters is one piece: each is a character of two columns or one
    two = icu.regex(r"[[:Emoji_Presentation:][:ExtPict:]" + ("[:ea=A:]" if wide_ambiguous else "") + "]")
    width = lambda c: F.when(c.rlike(f"^{segments.SIMPLE}++\\z"), F.length(c) + _count(c, two)).otherwise(cluster_width(c, wide_ambiguous))
    folded = F.aggregate(segments.pieces(s), F.lit(0), lambda n, c: n + width(c))
    return F.when(latin, short).otherwise(folded)


def orientation(s: Column) -> Column:
    """Vertical orientation of each character: Upright or Rotated."""
    upright = icu.regex("[[:vo=U:][:vo=Tu:]]")
    runs = F.regexp_extract_all(s, F.lit(f"({upright}++|[^{upright[1:]}++)"), F.lit(1))
    return F.flatten(F.transform(runs, lambda r: F.array_repeat(F.when(r.rlike(f"^{upright}"), "Upright").otherwise("Rotated"), F.length(r))))


def unbalanced_bidi(s: Column) -> Column:
    """Embeddings or isolates that are closed too often or not at all."""
    emb, iso = F.lit(0), F.lit(0)
    start = F.struct(emb.alias("e"), iso.alias("i"), F.lit(False).alias("bad"))

    def step(a, c):
        e = a["e"] + F.when(c.isin(0x202A, 0x202B, 0x202D, 0x202E), 1).when(c == 0x202C, -1).otherwise(0)
        i = a["i"] + F.when(c.isin(0x2066, 0x2067, 0x2068), 1).when(c == 0x2069, -1).otherwise(0)
        return F.struct(F.greatest(e, F.lit(0)).alias("e"), F.greatest(i, F.lit(0)).alias("i"), (a["bad"] | (e < 0) | (i < 0)).alias("bad"))

    controls = F.regexp_replace(s, f"[^{BIDI_CONTROL[1:]}", "")
    return F.aggregate(codepoints(controls), start, step, lambda a: a["bad"] | (a["e"] > 0) | (a["i"] > 0))


def has_bidi_control(s: Column) -> Column:
    return s.rlike(BIDI_CONTROL)


@lru_cache(maxsize=None)
def emoji_class(name: str = "Emoji") -> str:
    return icu.regex(f"[:{name}:]")


@lru_cache(maxsize=1)
def zwj_sequences() -> tuple[str, ...]:
    return icu.strings(r"[:RGI_Emoji_ZWJ_Sequence:]")


@lru_cache(maxsize=1)
def zwj_alphabet() -> str:
    """The characters of registered ZWJ sequences, but for the joiner."""
    return icu.char_class(*sorted({ord(c) for s in zwj_sequences() for c in s} - {0x200D}))


def is_rgi_zwj(s: Column) -> Column:
    """Whether the whole text is one registered ZWJ sequence."""
    return s.contains(ZWJ) & s.isin(*zwj_sequences())


def emoji_sequence_kind(s: Column) -> Column:
    """Shape of an emoji sequence, or null."""
    modifier, base = emoji_class("Emoji_Modifier"), emoji_class("Emoji_Modifier_Base")
    return (
        F.when(s.rlike(r"^[\x{1F1E6}-\x{1F1FF}]{2}\z"), "flag").when(s.rlike(r"^[0-9#*]\x{FE0F}?\x{20E3}\z"), "keycap")
        .when(s.rlike(f"^{base}{modifier}\\z"), "modifier").when(s.rlike(f"^{emoji_class()}[\\x{{E0020}}-\\x{{E007E}}]+\\x{{E007F}}\\z"), "tag")
        .when(s.rlike(f"^{emoji_class()}[^\\x{{200D}}]*(\\x{{200D}}{emoji_class()}[^\\x{{200D}}]*)+\\z"), "zwj")
    )


def safe_for_code(s: Column) -> Column:
    """No bidi control and at most a highly restrictive mix of scripts."""
    from .identifiers import LEVELS, restriction_level

    return ~has_bidi_control(s) & restriction_level(s).isin(*LEVELS[:3])
