"""Identifiers, scripts, restriction levels, mixed digits and PRECIS preparation."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..tables import icu
from .casing import fold
from .codec import chars, let, positions
from .normalize import nfc

ALLOWED = "[:Identifier_Status=Allowed:]"
LEVELS = ("ASCIIOnly", "SingleScript", "HighlyRestrictive", "ModeratelyRestrictive", "MinimallyRestrictive", "Unrestricted")
#: Combinations of scripts that are read together.
COVERED = (("Latn", "Hani", "Hira", "Kana"), ("Latn", "Hani", "Bopo"), ("Latn", "Hani", "Hang"))
#: Spaces other than U+0020 that PRECIS maps to it.
OTHER_SPACES = "               　"


def default_identifier(s: Column) -> Column:
    """XID_Start or underscore, then XID_Continue."""
    start, rest = icu.regex(r"[[:XIDS:]_]"), icu.regex("[:XIDC:]")
    return s.rlike(f"^{start}{rest}*+\\z")


def allowed_identifier(s: Column) -> Column:
    """A default identifier of characters with Identifier_Status Allowed."""
    return default_identifier(s) & s.rlike(f"^{icu.regex(ALLOWED)}+\\z")


#: Types of characters in identifiers; a character may be of several.
IDENTIFIER_TYPES = (
    "Recommended", "Inclusion", "Uncommon_Use", "Technical", "Obsolete", "Limited_Use", "Exclusion", "Not_XID", "Not_NFKC", "Default_Ignorable", "Deprecated", "Not_Character",
)


def identifier_types(s: Column) -> Column:
    """The types of a text's characters, in the order of IDENTIFIER_TYPES."""
    return F.array_compact(F.array(*[F.when(s.rlike(icu.regex(f"[:Identifier_Type={n}:]")), F.lit(n)) for n in IDENTIFIER_TYPES]))


def of_types(s: Column, *types: str) -> Column:
    """Whether every character of a text is of one of the types."""
    return s.rlike(f"^{icu.regex('[' + ''.join(f'[:Identifier_Type={n}:]' for n in types) + ']')}*+\\z")


def restricted_positions(s: Column) -> Column:
    return positions(s, icu.regex(ALLOWED, negated=True))


@lru_cache(maxsize=1)
def script_classes() -> dict[str, str]:
    """A class of the characters whose script extensions hold each script.

    Only scripts that share characters with another count; text in any other script has
    no resolved script.
    """
    script = SparkSession.active()._jvm.com.ibm.icu.lang.UScript
    out = {}
    for i in range(script.CODE_LIMIT):
        name = script.getShortName(i)
        if name not in ("Zyyy", "Zinh", "Zzzz") and (found := icu.ranges(f"[:scx={name}:]")) and icu.ranges(f"[[:scx={name}:]-[:sc={name}:]]"):
            out[name] = icu.char_class(*found)
    return out


_LATIN = r"[[:sc=Latn:]&[:scx=Latn:]&[\u0000-\u00FF]]"


def _scripted(s: Column) -> Column:
    """The distinct characters that have a script: neither common nor inherited. One a stands for the letters of Latin-1, which are Latin alone."""
    rest = F.regexp_replace(s, icu.regex(f"[[:scx=Zyyy:][:scx=Zinh:]{_LATIN}]") + "++", "")
    return F.concat(F.when(s.rlike(icu.regex(_LATIN)), "a").otherwise(""), F.array_join(F.array_distinct(chars(rest)), ""))


def _named(t: Column, pattern: str) -> Column:
    """Names of the scripts whose class, put into a pattern, matches."""
    each = F.array(*[F.when(t.rlike(pattern.format(c)), F.lit(n)) for n, c in script_classes().items()])
    return F.when(t == "", F.array().cast("array<string>")).when(t == "a", F.array(F.lit("Latn"))).otherwise(F.array_compact(each))


def _resolved(t: Column) -> Column:
    return _named(t, r"^{}+\z")


def scripts(s: Column) -> Column:
    """All scripts that a character of the text may belong to, by name."""
    return F.when(s.isNotNull(), let(_scripted(s), lambda t: _named(t, "{}")))


def resolved_scripts(s: Column) -> Column:
    """The scripts that every scripted character may belong to."""
    return F.when(s.isNotNull(), let(_scripted(s), _resolved))


def has_script(s: Column, name: str) -> Column:
    return s.rlike(script_classes()[name])


def ascii_only(s: Column) -> Column:
    return s.rlike(r"^[\x00-\x7F]*\z")


def _covered(t: Column) -> Column:
    sets, hit = script_classes(), F.lit(False)
    for group in COVERED:
        hit = hit | t.rlike("^[" + "".join(sets[n][1:-1] for n in group) + "]*\\z")
    return hit


def covered_cjk(s: Column) -> Column:
    return let(_scripted(s), _covered)


def highly_restrictive(s: Column) -> Column:
    return let(_scripted(s), lambda t: (~ascii_only(s) & (F.size(_resolved(t)) > 0)) | _covered(t))


def _moderate(t: Column) -> Column:
    sets = script_classes()
    return let(
        F.regexp_replace(t, sets["Latn"], ""),
        lambda rest: (rest != "") & (F.size(_resolved(rest)) > 0) & ~rest.rlike(sets["Cyrl"]) & ~rest.rlike(sets["Grek"]),
    )


def moderate_shape(s: Column) -> Column:
    """Latin with characters of exactly one other script, not Cyrillic or Greek."""
    return let(_scripted(s), _moderate)


def restriction_level(s: Column) -> Column:
    """The strictest level that the text satisfies."""
    allowed = s.rlike(f"^{icu.regex(ALLOWED)}*\\z")
    other = let(
        _scripted(s),
        lambda t: F.when(F.size(_resolved(t)) > 0, LEVELS[1]).when(_covered(t), LEVELS[2]).when(_moderate(t), LEVELS[3])
        .when(allowed, LEVELS[4]).otherwise(LEVELS[5]),
    )
    return F.when(s.isNull(), None).when(ascii_only(s), LEVELS[0]).otherwise(other)


def mixed_numbers(s: Column) -> Column:
    """Whether decimal digits of more than one system occur."""
    digits = icu.regex("[:Nd:]")
    found = F.regexp_extract_all(s, F.lit(f"({digits})"), F.lit(1))
    zero = F.transform(found, lambda c: F.ascii(c) - F.java_method(F.lit(icu.UCHAR), F.lit("getUnicodeNumericValue"), F.ascii(c)).cast("double").cast("int"))
    return F.when(s.rlike(digits), F.size(F.array_distinct(zero)) > 1).otherwise(F.lit(False))


# PRECIS


def width_map(s: Column) -> Column:
    """Wide and narrow forms to their ordinary ones, one to one."""
    source, target = _width_pairs()
    return F.translate(s, source, target)


@lru_cache(maxsize=1)
def _width_pairs() -> tuple[str, str]:
    normalizer = SparkSession.active()._jvm.com.ibm.icu.text.Normalizer2.getNFKCInstance()
    cps = [cp for a, b in icu.ranges("[[:dt=wide:][:dt=nar:]]") for cp in range(a, b + 1)]
    return "".join(map(chr, cps)), "".join(normalizer.getRawDecomposition(cp) for cp in cps)


def spaces_to_ascii(s: Column) -> Column:
    return F.translate(s, OTHER_SPACES, " " * len(OTHER_SPACES))


def bidi_label(s: Column) -> Column:
    return s.rlike(icu.regex("[[:bc=R:][:bc=AL:][:bc=AN:]]"))


def bidi_rule(s: Column, strict: bool = False) -> Column:
    """RFC 5893 section 2; without ``strict`` a label without right-to-left characters passes."""
    c = lambda *names: icu.regex("[" + "".join(f"[:bc={n}:]" for n in names) + "]")
    rtl = (
        s.rlike(f"^{c('R', 'AL')}") & s.rlike(f"^{c('R', 'AL', 'AN', 'EN', 'ES', 'CS', 'ET', 'ON', 'BN', 'NSM')}*\\z")
        & s.rlike(f"{c('R', 'AL', 'EN', 'AN')}{c('NSM')}*\\z") & ~(s.rlike(c("EN")) & s.rlike(c("AN")))
    )
    ltr = s.rlike(f"^{c('L')}") & s.rlike(f"^{c('L', 'EN', 'ES', 'CS', 'ET', 'ON', 'BN', 'NSM')}*\\z") & s.rlike(f"{c('L', 'EN')}{c('NSM')}*\\z")
    rule = F.when(s.rlike(f"^{c('R', 'AL')}"), rtl).otherwise(ltr)
    return rule if strict else ~bidi_label(s) | rule


def precis_username(s: Column, preserve_case: bool = False) -> Column:
    """Width mapping, case folding and NFC; null where the result is not admissible."""
    mapped = width_map(s)
    done = nfc(mapped if preserve_case else fold(mapped))
    ok = (done != "") & done.rlike(f"^{icu.regex(ALLOWED)}+\\z") & bidi_rule(done)
    return F.when(ok, done)


def precis_opaque(s: Column) -> Column:
    """Other spaces to U+0020 and NFC; null where the result is not admissible."""
    done = nfc(spaces_to_ascii(s))
    barred = icu.regex("[[:Zl:][:Zp:][:Cc:][:Cf:][:Cs:][:Co:][:Cn:]]")
    return F.when((done != "") & ~done.rlike(barred) & bidi_rule(done), done)


def precis_category(cp: Column) -> Column:
    c = F.decode(F.unhex(F.lpad(F.hex(cp), 8, "0")), "UTF-32")
    return (
        F.when(cp.isin(0x200C, 0x200D), "ContextJ").when(c.rlike(icu.regex(ALLOWED)), "IdentifierClass")
        .when(c.rlike(icu.regex("[:Cn:]")), "Unassigned").otherwise("Disallowed")
    )


def script_runs(s: Column) -> Column:
    """Each character's script by name, for inspection."""
    return F.transform(chars(s), lambda c: icu.value_name("Script", icu.property_value(F.ascii(c), "Script")))
