"""Grapheme, word and sentence boundaries as regular expressions.

Graphemes follow the extended cluster grammar over ICU's sets. For words and sentences a
text is first written as a string of class letters, one for each character, and the rules
are a regular expression over those.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..tables import icu
from .codec import chars, let


#: No character below U+0300 extends another, so most text needs no look at the classes.
SIMPLE = r"[\x{20}-\x{7E}\x{A0}-\x{AC}\x{AE}-\x{2FF}]"
_SINGLE = SIMPLE + r"(?![\x{300}-\x{10FFFF}])"


@lru_cache(maxsize=1)
def cluster_pattern() -> str:
    """One extended grapheme cluster."""
    g = lambda *names: icu.regex("[" + "".join(f"[:GCB={n}:]" for n in names) + "]")
    ri = g("Regional_Indicator")
    hangul = f"(?:{g('L')}*(?:{g('V')}+|{g('LV')}{g('V')}*|{g('LVT')}){g('T')}*|{g('L')}+|{g('T')}+)"
    ext = g("Extend")
    xpicto = f"{icu.regex('[:ExtPict:]')}(?:{ext}*\\x{{200D}}{icu.regex('[:ExtPict:]')})*"
    link, more, cons = icu.regex("[:InCB=Linker:]"), icu.regex("[[:InCB=Linker:][:InCB=Extend:]]"), icu.regex("[:InCB=Consonant:]")
    conjunct = f"{cons}(?:{more}*{link}{more}*{cons})+"
    control = g("Control", "CR", "LF")
    core = f"(?:{hangul}|{ri}{ri}|{xpicto}|{conjunct}|[^{control[1:]})"
    return f"(?:{_SINGLE}|\\r\\n|{control}|{g('Prepend')}*{core}[{g('Extend')[1:-1]}\\x{{200D}}{g('SpacingMark')[1:-1]}]*|{g('Prepend')}+)"


def graphemes(s: Column) -> Column:
    """Extended grapheme clusters."""
    return F.regexp_extract_all(s, F.lit(f"({cluster_pattern()})"), F.lit(1))


def pieces(s: Column) -> Column:
    """Clusters, with those of one simple character each taken together in runs."""
    return F.regexp_extract_all(s, F.lit(f"((?:{_SINGLE})++|{cluster_pattern()})"), F.lit(1))


def breaks(segments: Column) -> Column:
    """Whether there is a boundary before each character and at the end, from segments."""
    inner = F.flatten(F.transform(segments, lambda g: F.transform(F.sequence(F.lit(1), F.length(g)), lambda i: i == 1)))
    return F.concat(inner, F.array(F.lit(True)))


WORD_CLASS = {
    "CR": "r", "LF": "l", "Newline": "b", "Extend": "x", "Format": "x", "ZWJ": "z", "ALetter": "A", "Hebrew_Letter": "H", "Numeric": "N",
    "Katakana": "K", "ExtendNumLet": "E", "MidLetter": "m", "MidNum": "n", "MidNumLet": "q", "Single_Quote": "s", "Double_Quote": "d",
    "Regional_Indicator": "R", "WSegSpace": "w",
}
SENTENCE_CLASS = {
    "CR": "r", "LF": "l", "Sep": "p", "Extend": "x", "Format": "x", "Sp": "w", "Lower": "a", "Upper": "U", "OLetter": "O", "Numeric": "N",
    "ATerm": "t", "STerm": "T", "Close": "c", "SContinue": "s",
}


def class_letters(s: Column, prop: str, letters: dict[str, str]) -> Column:
    """The text with each character replaced by the letter of its class, others by '.'.

    Pictographs of no other word class get 'P'. Text below U+0100 takes one table.
    """
    return F.when(s.rlike(r"^[\x{0}-\x{FF}]*\z"), F.translate(s, _LATIN, _latin_letters(prop))).otherwise(_class_letters(s, prop, letters))


_LATIN = "".join(map(chr, range(256)))


@lru_cache(maxsize=None)
def _latin_letters(prop: str) -> str:
    letters = WORD_CLASS if prop == "WB" else SENTENCE_CLASS
    out = ["."] * 256
    for name, letter in ([("[:ExtPict:]", "P")] if prop == "WB" else []) + [(f"[:{prop}={n}:]", x) for n, x in letters.items()]:
        for a, b in icu.ranges(name):
            for cp in range(a, min(b, 255) + 1):
                out[cp] = letter
    return "".join(out)


def _class_letters(s: Column, prop: str, letters: dict[str, str]) -> Column:
    out = s
    marks: list[tuple[str, str]] = []
    groups: dict[str, list[str]] = {}
    for name, letter in letters.items():
        groups.setdefault(letter, []).append(name)
    used = "".join(f"[:{prop}={n}:]" for n in letters)
    for k, (letter, names) in enumerate(groups.items()):
        cls = icu.regex("[" + "".join(f"[:{prop}={n}:]" for n in names) + "]")
        marks.append((cls, chr(0x10F000 + k) + "|" + letter))
    # private code points stand for classes until every real character is gone
    taken = icu.char_class((0x10F000, 0x10F0FF))
    out = F.regexp_replace(out, taken, "￿")
    for k, (cls, mark) in enumerate(marks):
        out = F.regexp_replace(out, cls, mark[0])
    if prop == "WB":
        out = F.regexp_replace(out, icu.regex(f"[[:ExtPict:]-[{used}]]"), chr(0x10F0FE))
    out = F.regexp_replace(out, f"[^{taken[1:]}", chr(0x10F0FF))
    source = "".join(m[0] for _, m in marks) + chr(0x10F0FE) + chr(0x10F0FF)
    return F.translate(out, source, "".join(m[-1] for _, m in marks) + "P.")


def _word_pattern(hebrew: bool) -> str:
    """One word segment; ``hebrew`` for letters with Hebrew ones among them, whose single quotes end a run and belong to it."""
    x = "[xz]*+"
    # loops over groups are possessive: Java runs those in a loop, and all others one call deeper for each turn;
    # what may follow a group starts with other letters, so nothing is lost by not going back
    letter = f"A++{x}(?:[mqs]{x}(?=[AH]))?+|N++{x}(?:[nqs]{x}(?=N))?+"
    if hebrew:
        letter += f"|H++{x}(?!s{x}(?![AH]))(?:d{x}(?=H)|[mqs]{x}(?=[AH]))?+"
    letters, kana, low = f"(?:{letter})++", f"(?:K++{x})++", f"(?:E{x})++"
    quoted = f"(?:(?:{letters}|{kana}){low}|{low})*+(?:{letters})?+H++{x}s{x}|" if hebrew else ""
    run = f"(?:{quoted}(?:{low})?+(?:{letters}|{kana})(?:{low}(?:{letters}|{kana}))*+(?:{low})?+|{low})"
    pictured = f"(?:(?<=z)P{x})*+"
    return f"(?:rl|[rlb]|R{x}R{x}{pictured}|{run}{pictured}|w++{x}{pictured}|[^rlb]{x}{pictured})"


def _sentence_pattern() -> str:
    x = "x*+"
    para = "(?:rl|[rlp])"
    close, spaces = f"(?:c{x})*+", f"(?:w{x})*+"
    # letters take a full stop between them and an upper-case letter along, whatever marks are in between
    plain = f"[^rlptTaU]++|[aU]++{x}(?:t{x}(?=U))?+"
    a_goes_on = f"t{x}(?=N)|t{x}{close}{spaces}(?=[^OUarlptT]*+a)"
    goes_on = f"(?:{a_goes_on}|[tT]{x}{close}{spaces}(?=[stT]))"
    stop = f"[tT]{x}{close}{spaces}{para}?"
    return f"(?:(?:{plain}|{goes_on})*+(?:{stop}|{para}|\\z)|{para})"


#: Marks cuts in texts that do not contain it: a noncharacter.
_MARK = "\U0010fffe"


def _cut(s: Column, classes: Column, pattern: str) -> Column:
    """Pieces of ``s`` of the lengths of the matches of ``pattern`` in its class letters.

    A mark goes before each piece's first character and the text is split there, one pass over it. A text that has the
    mark itself is cut piece by piece.
    """
    runs = F.filter(F.regexp_extract_all(classes, F.lit(f"({pattern})"), F.lit(1)), lambda r: r != "")
    firsts = F.flatten(F.transform(runs, lambda r: F.concat(F.array(F.lit(_MARK)), F.array_repeat(F.lit(""), F.length(r) - 1))))
    marked = F.array_join(F.zip_with(firsts, chars(s), lambda m, c: F.concat(m, c)), "")
    pieces = F.split(marked, _MARK)
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<string>").alias("out"))
    step = lambda a, r: F.struct((a["at"] + F.length(r)).alias("at"), F.array_append(a["out"], F.substring(s, a["at"], F.length(r))).alias("out"))
    slow = F.aggregate(runs, start, step, lambda a: a["out"])
    return F.when(s == "", F.array().cast("array<string>")).when(s.contains(_MARK), slow).otherwise(F.slice(pieces, 2, F.size(pieces)))


def words(s: Column) -> Column:
    """Segments between word boundaries, white space and punctuation included."""
    return _by_letters(s, lambda c, pattern: _cut(s, c, pattern))


def _by_letters(s: Column, f: Callable[[Column, str], Column]) -> Column:
    return let(class_letters(s, "WB", WORD_CLASS), lambda c: F.when(c.contains("H"), f(c, _word_pattern(True))).otherwise(f(c, _word_pattern(False))))


def sentences(s: Column) -> Column:
    return _cut(s, class_letters(s, "SB", SENTENCE_CLASS), _sentence_pattern())


def word_count(s: Column) -> Column:
    """Segments between word boundaries, counted without cutting the text."""
    return _by_letters(s, lambda c, pattern: F.regexp_count(c, F.lit(pattern)))


def sentence_count(s: Column) -> Column:
    return F.size(F.filter(_runs(class_letters(s, "SB", SENTENCE_CLASS), _sentence_pattern()), lambda r: r != ""))


def _runs(classes: Column, pattern: str) -> Column:
    return F.regexp_extract_all(classes, F.lit(f"({pattern})"), F.lit(1))


def grapheme_count(s: Column) -> Column:
    return F.regexp_count(s, F.lit(cluster_pattern()))


def first_grapheme(s: Column) -> Column:
    return F.regexp_extract(s, f"^({cluster_pattern()})", 1)


def is_single_cluster(s: Column) -> Column:
    return F.size(chars(first_grapheme(s))) == F.length(s)
