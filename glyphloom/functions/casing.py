"""Case folding and full case mappings with locale context, as expressions."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import icu
from .codec import chars, let

#: Unconditional lower-case mapping to more than one character.
DOTTED_I = "İ"


def fold(s: Column) -> Column:
    """Full case folding."""
    done = F.java_method(F.lit(icu.UCHAR), F.lit("foldCase"), s, F.lit(True))
    return F.when(s.isNotNull(), done)


#: The conditional rules of case mapping. Code point, lower, title and upper case, language, condition.
RULES = (
    ("Σ", "ς", "Σ", "Σ", "", "Final_Sigma"),
    ("\u0307", "\u0307", "", "", "lt", "After_Soft_Dotted"),
    ("I", "i\u0307", "I", "I", "lt", "More_Above"),
    ("J", "j\u0307", "J", "J", "lt", "More_Above"),
    ("Į", "į\u0307", "Į", "Į", "lt", "More_Above"),
    ("Ì", "i\u0307\u0300", "Ì", "Ì", "lt", ""),
    ("Í", "i\u0307\u0301", "Í", "Í", "lt", ""),
    ("Ĩ", "i\u0307\u0303", "Ĩ", "Ĩ", "lt", ""),
    ("İ", "i", "İ", "İ", "tr", ""),
    ("\u0307", "", "\u0307", "\u0307", "tr", "After_I"),
    ("I", "ı", "I", "I", "tr", "Not_Before_Dot"),
    ("i", "i", "İ", "İ", "tr", ""),
)
LANGUAGES = {"default": "", "turkish": "tr", "azeri": "tr", "lithuanian": "lt"}
#: Results stand for themselves until every rule has looked at the text as it was.
_HOLD = 0x10F100


def condition_pattern(source: str, condition: str) -> tuple[str, str]:
    """A pattern for ``source`` under a condition, and what of the match stays in front of it.

    Conditions that look ahead are lookaheads of any length; those that look back match what they
    look at, for a lookbehind would have to be bounded.
    """
    marks, between, above = icu.regex("[:^ccc=0:]"), icu.regex("[[:^ccc=0:]-[:ccc=230:]]"), icu.regex("[:ccc=230:]")
    cased = icu.regex("[:Cased:]")
    before = {"Final_Sigma": f"({cased}{marks}*+)", "After_Soft_Dotted": f"({icu.regex('[:Soft_Dotted:]')}{between}*+)", "After_I": f"(I{between}*+)"}.get(condition, "()")
    after = {"Final_Sigma": f"(?!{marks}*+{cased})", "More_Above": f"(?={between}*+{above})", "Not_Before_Dot": f"(?!{icu.regex('[[:^ccc=0:]-[̇]]')}*+̇)"}.get(condition, "")
    return f"{before}{source}{after}", "$1"


Rule = tuple[str, str, str, str, str, str]


def read_rules(lines: DataFrame, column: str = "value") -> tuple[Rule, ...]:
    """The conditional rules of lines such as ``0049; 0131; 0049; 0049; tr Not_Before_Dot; # note``, in the file's order.

    The file has some dozen of them. Rules without a condition are left to the plain mappings, and ``az`` counts as ``tr``.
    """
    parts = F.transform(F.split(F.substring_index(F.col(column), "#", 1), ";"), lambda p: F.trim(p))
    rows = lines.select(parts.alias("p"), F.monotonically_increasing_id().alias("at")).where("size(p) >= 6 and p[4] != ''").orderBy("at").limit(1_000)
    spelt = lambda t: "".join(chr(int(x, 16)) for x in t.split())
    found: list[Rule] = []
    for row in rows.collect():
        words = row["p"][4].replace("az", "tr").split()
        language, condition = next((w for w in words if w.islower()), ""), next((w for w in words if not w.islower()), "")
        rule = (*map(spelt, row["p"][:4]), language, condition)
        if rule not in found:
            found.append(rule)
    return tuple(found)


def _mapped(s: Column, locale: str, case: str, rules: tuple[Rule, ...] = RULES) -> Column:
    """``s`` with the rules of a language applied, each to the text as it was, and all else by ``case``.

    A rule's result is held by a private code point until the rest is mapped. Rules that look at a letter which
    another rule maps come first: a dot after I before I itself.
    """
    column = {"lower": 1, "title": 2, "upper": 3}[case]
    chosen = [r for r in rules if r[4] in ("", LANGUAGES[locale]) and r[column] != r[0]]
    order = ("After_I", "After_Soft_Dotted", "Final_Sigma", "More_Above", "Not_Before_Dot", "")
    out, held = s, []
    # a dot that goes is only marked, so that the I before it still sees it
    for k, rule in enumerate(sorted(chosen, key=lambda r: order.index(r[5]))):
        source, result = rule[0], rule[column]
        pattern, kept = condition_pattern(source, rule[5])
        hold = chr(_HOLD + k)
        if rule[5] == "Not_Before_Dot":
            pattern = pattern.replace("*+̇)", f"*+[̇{''.join(h for h, r in held if r == '')}])")
        out = _ruled(out, source, pattern, f"{kept}{hold}")
        held.append((hold, result))
    out = _rest(out, case)
    for hold, result in held:
        out = F.replace(out, F.lit(hold), F.lit(result))
    return out


def _ruled(s: Column, source: str, pattern: str, new: str) -> Column:
    # bound once: a chain of rules that each name the text thrice would do its work 3 ** n times
    return let(s, lambda t: F.when(t.contains(source), F.regexp_replace(t, pattern, new)).otherwise(t))


def _rest(s: Column, case: str) -> Column:
    if case == "upper":
        return F.upper(s)
    if case == "lower":
        # what sigma becomes is settled; Java would look at its neighbours again
        return F.lower(F.translate(F.replace(s, F.lit(DOTTED_I), F.lit("i̇")), "Σ", "σ"))
    return let(s, _titled)


def _titled(s: Column) -> Column:
    """Every character in title case: the upper case but for some characters, which are held back, each kind once."""
    special, changing = _title_apart(), icu.regex("[:CWT:]")
    holds = icu.char_class((_APART, _APART + len(special) - 1))
    kinds = F.array_distinct(F.regexp_extract_all(s, F.lit(f"({icu.char_class(*map(ord, special))})"), F.lit(1)))
    stands = "".join(chr(_APART + k) for k in range(len(special)))

    def back(found: Column) -> Column:
        upper = F.upper(F.translate(s, special, stands))
        pairs = F.transform(found, lambda c: F.struct(F.translate(c, special, stands).alias("hold"), title_character(c).alias("title")))
        return F.aggregate(pairs, upper, lambda t, p: F.replace(t, p["hold"], p["title"]))

    slow = F.array_join(F.transform(chars(s), lambda c: F.when(c.rlike(changing), title_character(c)).otherwise(c)), "")
    apart = F.when(s.rlike(holds), slow).otherwise(let(kinds, back))
    return F.when(~s.rlike(changing), s).when(~s.rlike(icu.char_class(*map(ord, special))), F.upper(s)).otherwise(apart)


#: Characters whose title case is not their upper case are held back by private code points from here.
_APART = 0x10F200


@lru_cache(maxsize=1)
def _title_apart() -> str:
    """The characters, some hundred, whose title case is not their upper case."""
    spark = SparkSession.active()
    cps = spark.range(0, 0x110000, 1, 8).where("id not between 55296 and 57343").select(F.expr("decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32')").alias("c"))
    changing = F.col("c").rlike(icu.regex("[:CWT:]"))
    titled = F.when(changing, title_character(F.col("c"))).otherwise(F.col("c"))
    rows = cps.where(F.col("c").rlike(icu.regex("[[:CWT:][:CWU:]]")) | (F.upper("c") != F.col("c"))).where(titled != F.upper("c")).orderBy("c").limit(0x800)
    return "".join(r["c"] for r in rows.collect())


def title_character(c: Column) -> Column:
    """Title case of one character: its simple mapping, or the full upper case with all but the first letter small.

    A subscript iota stays one, and what starts with a character without case stays in capitals.
    """
    simple = icu.simple_title(F.ascii(c))
    single = F.decode(F.unhex(F.lpad(F.hex(simple), 8, "0")), "UTF-32")
    full = F.upper(c)
    tail = F.substring(full, F.lit(2), F.length(full))
    iota = F.concat(F.substring(tail, F.lit(1), F.length(tail) - 1), F.lit("\u0345"))
    small = F.when(tail.endswith("Ι"), iota).otherwise(F.lower(tail))
    spelt = F.when(F.substring(full, 1, 1).rlike(icu.regex("[:Cased:]")), F.concat(F.substring(full, 1, 1), small)).otherwise(full)
    return F.when((F.length(full) > 1) & (single == c), spelt).otherwise(single)


def upper(s: Column, locale: str = "default", rules: tuple[Rule, ...] = RULES) -> Column:
    """Full upper case; a letter may become several. ``locale`` is default, turkish, azeri or lithuanian."""
    return F.upper(s) if locale == "default" else _mapped(s, locale, "upper", rules)


def lower(s: Column, locale: str = "default", rules: tuple[Rule, ...] = RULES) -> Column:
    """Full lower case, with a sigma at a word's end. ``locale`` is default, turkish, azeri or lithuanian."""
    return _mapped(s, locale, "lower", rules)


def title(s: Column, locale: str = "default", rules: tuple[Rule, ...] = RULES) -> Column:
    """Each character in title case (not each word's first): what a caller takes the first character of."""
    return _mapped(s, locale, "title", rules)


def holds(s: Column, source: str, condition: str) -> Column:
    """How often ``source`` stands in a text under a condition of the rules."""
    return F.regexp_count(s, F.lit(condition_pattern(source, condition)[0]))


def simple_upper(s: Column) -> Column:
    """One-to-one upper case of each code point, as code points."""
    return F.transform(chars(s), lambda c: icu.simple_upper(F.ascii(c)))


def simple_lower(s: Column) -> Column:
    return F.transform(chars(s), lambda c: icu.simple_lower(F.ascii(c)))


def simple_title(s: Column) -> Column:
    return F.transform(chars(s), lambda c: icu.simple_title(F.ascii(c)))
