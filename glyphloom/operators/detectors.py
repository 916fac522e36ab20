"""Twenty-six text-security detectors as Spark expressions.

A detector takes a string column and gives ``struct<tag, positions>``: a null tag means
clear, positions are 0-based code points. The first condition that holds decides.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import lru_cache, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import casing, confusables, identifiers, layout
from ..functions.codec import byte_fault, chars, codepoints, first_position, let, positions
from ..functions.normalize import nfc, nfkc, nfkd, normalized
from ..tables import curated, icu

Rule = tuple[Column, str | Column, Column]


def empty() -> Column:
    return F.array().cast("array<int>")


def one(position: Column) -> Column:
    return F.array(position.cast("int"))


_TAGS_ONLY: ContextVar[bool] = ContextVar("tags_only", default=False)


@contextmanager
def tags_only() -> Iterator[None]:
    """Verdicts made within have empty positions, which are then not sought."""
    held = _TAGS_ONLY.set(True)
    try:
        yield
    finally:
        _TAGS_ONLY.reset(held)


def verdict(*rules: Rule) -> Column:
    """The tag and positions of the first rule whose condition holds."""
    out = None
    for condition, name, where in rules:
        where = empty() if _TAGS_ONLY.get() else where
        found = F.struct((F.lit(name) if isinstance(name, str) else name).alias("tag"), where.alias("positions"))
        out = F.when(condition, found) if out is None else out.when(condition, found)
    return out.otherwise(F.struct(F.lit(None).cast("string").alias("tag"), empty().alias("positions")))


def where(s: Column, cls: str, test: Callable[[Column, Column, Column], Column], guard: str | None = None) -> Column:
    """Positions i of characters of a class at which ``test(characters, character, i)`` holds; none without the guard, by default the class."""
    # bound once: a lambda that splits the text anew for every character takes its square
    found = let(chars(s), lambda cs: F.filter(positions(s, cls), lambda i: test(cs, F.get(cs, i), i)))
    return F.when(s.rlike(guard or cls), found).otherwise(empty())


def first_match(s: Column, pattern: str) -> Column:
    """0-based position of the first match of a pattern, or null."""
    return F.when(s.rlike(pattern), F.length(F.regexp_extract(s, f"(?s)^(.*?)(?:{pattern})", 1)))


def first_difference(a: Column, b: Column) -> Column:
    """First position at which two texts differ, the shorter one's length when it is a prefix."""
    same = F.zip_with(chars(a), chars(b), lambda x, y: x.eqNullSafe(y))
    return F.when(a != b, (F.array_position(same, F.lit(False)) - 1).cast("int"))


def previous(cs: Column, i: Column) -> Column:
    return F.coalesce(F.get(cs, i - 1), F.lit(""))


def following(cs: Column, i: Column) -> Column:
    return F.coalesce(F.get(cs, i + 1), F.lit(""))


# Covert content


def tag_block_payload(s: Column) -> Column:
    return let(positions(s, layout.TAG), lambda tags: _tag_block(s, tags))


def _tag_block(s: Column, tags: Column) -> Column:
    return verdict(
        (F.size(tags) == 0, F.lit(None).cast("string"), empty()),
        (s.rlike(rf"^[^{layout.TAG[1:]}*\x{{E0001}}") & (F.size(tags) >= 2), "LanguageTagRevival", tags),
        ((F.size(tags) == F.length(s)) & s.rlike(r"[\x{E0020}-\x{E007E}]"), "DirectAscii", tags),
        (F.size(tags) < F.length(s), "MixedBlock", tags),
        (F.lit(True), "BareTagPresent", tags),
    )


#: Standardized variation sequences by block, since the full list is in no library here: a
#: selector class and the class of characters that it may follow.
STANDARDIZED = ((r"[\x{180B}-\x{180D}]", r"[\x{1820}-\x{18AA}]"), (r"[\x{FE00}-\x{FE02}]", r"[\x{13000}-\x{1342F}]"), (r"[\x{FE00}]", r"[0]"))


def registered_selectors(s: Column) -> Column:
    """Selectors FE0E and FE0F directly after an emoji, and standardized ones."""
    pairs = ((r"[\x{FE0E}\x{FE0F}]", layout.emoji_class()), *STANDARDIZED)
    hit = lambda cs, c, i: reduce(lambda a, b: a | b, [c.rlike(v) & previous(cs, i).rlike(base) for v, base in pairs])
    return where(s, layout.VARIATION_SELECTOR, hit)


def suspicious_selectors(s: Column) -> Column:
    return F.array_except(positions(s, layout.VARIATION_SELECTOR), registered_selectors(s))


def selector_payload(s: Column) -> Column:
    """Bytes that suspicious selectors spell, two to a byte; Mongolian ones spell nothing."""
    return let(chars(s), lambda cs: _spelt(F.transform(suspicious_selectors(s), lambda i: F.get(cs, i))))


def _spelt(picked: Column) -> Column:
    cps = F.filter(F.transform(picked, lambda c: F.ascii(c)), lambda c: ~c.between(0x180B, 0x180D))
    bits = F.transform(cps, lambda c: F.when(c < 0xE0000, c - 0xFE00).otherwise(c - 0xE0100 + 16))
    byte = lambda values: F.transform(values, lambda v, i: F.when(i % 2 == 1, (F.get(values, i - 1) * 16).bitwiseOR(v).bitwiseAND(255)))
    return F.filter(let(bits, byte), lambda b: b.isNotNull())


def variation_selector_payload(s: Column) -> Column:
    # both lists and the selectors themselves are found once
    good = let(registered_selectors(s), lambda g: F.struct(g.alias("good"), F.array_except(positions(s, layout.VARIATION_SELECTOR), g).alias("bad")))
    held = lambda f: let(chars(s), lambda cs: F.struct(f["good"].alias("good"), f["bad"].alias("bad"), F.transform(f["bad"], lambda i: F.get(cs, i)).alias("picked")))
    found = let(let(good, held), _selector_verdict)
    return F.when(s.rlike(layout.VARIATION_SELECTOR), found).otherwise(verdict((F.lit(False), "", empty())))


def _selector_verdict(found: Column) -> Column:
    good, bad, picked = found["good"], found["bad"], found["picked"]
    return verdict(
        (F.size(bad) == 0, F.lit(None).cast("string"), empty()),
        (F.array_min(good) < F.array_min(bad), "EmbeddedAfterRegistered", bad),
        ((F.size(bad) >= 4) & (F.size(F.array_distinct(picked)) == 1), "RepeatedBase", bad),
        (F.size(_spelt(picked)) >= 1, "DirectPayload", bad),
        (F.lit(True), "IllegalTarget", bad),
    )


def _zero_width() -> str:
    ignorable = r"[[:DI:]-[\uFE00-\uFE0F]-[\U000E0100-\U000E01EF]-[\U000E0000-\U000E007F]-[\u202A-\u202E\u2066-\u2069]]"
    return icu.regex(rf"[[\u200B-\u200F\u2060-\u2064\u202F\uFEFF\uFFF9-\uFFFB]{ignorable}]")


def suspicious_zero_width(s: Column) -> Column:
    """Zero-width characters but for joiners between characters of joined emoji."""
    cls, inner = _zero_width(), layout.zwj_alphabet()
    joiner = lambda cs, c, i: (c == layout.ZWJ) & previous(cs, i).rlike(inner) & following(cs, i).rlike(inner)
    return where(s, cls, lambda cs, c, i: ~joiner(cs, c, i))


def _count(s: Column, cls: str) -> Column:
    return F.regexp_count(s, F.lit(cls))


def zero_width_payload(s: Column) -> Column:
    return let(suspicious_zero_width(s), lambda bad: _zero_width_verdict(s, bad))


def _zero_width_verdict(s: Column, bad: Column) -> Column:
    a, b, c = (_count(s, rf"\x{{{x}}}") for x in ("FFF9", "FFFA", "FFFB"))
    return verdict(
        (F.size(bad) == 0, F.lit(None).cast("string"), empty()),
        ((a != b) | (b != c), "AnnotationMisuse", bad),
        (s.contains("⁠"), "WordJoinerInjection", bad),
        (_count(s, r"\x{202F}") >= 2, "AIWatermarkNNBSP", bad),
        (_count(s, r"[\x{200B}\x{200D}]") >= 2, "BinaryPayload", bad),
        (F.lit(True), "BareZeroWidth", bad),
    )


def surrogate_reassembly(s: Column) -> Column:
    """The code points read as bytes, where all are below 256: the first that is no UTF-8."""
    return let(byte_fault(s), lambda x: verdict((~s.rlike(r"[^\x00-\xFF]") & x["kind"].isNotNull(), x["kind"], one(x["offset"]))))


def bidi_balance(s: Column) -> Column:
    """Counters of open embeddings and isolates over the controls, with orphans and depth."""
    controls = positions(s, layout.BIDI_CONTROL)
    cps = codepoints(s)
    zero = F.lit(0)
    start = F.struct(zero.alias("emb"), zero.alias("iso"), zero.alias("depth"), empty().alias("orphans"))

    def step(a: Column, x: Column) -> Column:
        i, c = x["i"], x["c"]
        opens, pops = c.isin(0x202A, 0x202B, 0x202D, 0x202E), c == 0x202C
        starts, ends = c.isin(0x2066, 0x2067, 0x2068), c == 0x2069
        emb = a["emb"] + F.when(opens, 1).when(pops & (a["emb"] > 0), -1).otherwise(0)
        iso = a["iso"] + F.when(starts, 1).when(ends & (a["iso"] > 0), -1).otherwise(0)
        orphan = (pops & (a["emb"] == 0)) | (ends & (a["iso"] == 0))
        return F.struct(
            emb.alias("emb"), iso.alias("iso"), F.greatest(a["depth"], emb + iso).alias("depth"),
            F.when(orphan, F.array_append(a["orphans"], i)).otherwise(a["orphans"]).alias("orphans"),
        )

    # the controls' code points, looked up once
    looked = let(cps, lambda all_cps: F.transform(controls, lambda i: F.struct(i.alias("i"), F.get(all_cps, i).alias("c"))))
    return F.aggregate(looked, start, step)


def bidi_control_balance(s: Column) -> Column:
    return let(bidi_balance(s), lambda state: _balance_verdict(s, state))


def _balance_verdict(s: Column, state: Column) -> Column:
    controls = positions(s, layout.BIDI_CONTROL)
    return verdict(
        (~layout.has_bidi_control(s), F.lit(None).cast("string"), empty()),
        (state["depth"] > 125, "DepthExceeded", empty()),
        (F.size(state["orphans"]) > 0, "OrphanPop", state["orphans"]),
        (state["emb"] > 0, "UnbalancedEmbedding", controls),
        (state["iso"] > 0, "UnbalancedIsolate", controls),
    )


# Identity


def targets(spark: SparkSession, names: DataFrame | None = None) -> DataFrame:
    """``(letters, names)``: names by letter skeleton, in order of search.

    ``names(rank, name)`` are protected names, by default the fixed list of imitated ones.
    """
    if names is None:
        names = spark.createDataFrame(list(enumerate(curated.TARGETS)), "rank int, name string")
    named = names.select("rank", "name", confusables.letter_skeleton(F.col("name")).alias("letters"))
    return named.groupBy("letters").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "name"))), lambda x: x["name"]).alias("names"))


def with_target(df: DataFrame, column: str, out: str = "target", names: DataFrame | None = None) -> DataFrame:
    """Add the first name that the text's letters imitate without being it, or null.

    The skeleton is a column of its own and meets the names in an equality join. The fixed
    list has under a hundred names and is broadcast; a table ``names(rank, name)`` is joined
    as Spark sees fit.
    """
    wanted, text = targets(df.sparkSession, names), F.col(column)
    if names is None:
        # an ASCII letter or digit leaves at least one letter, so a text of more of them than the longest name has letters is none
        longest = wanted.agg(F.max(F.length("letters")).alias("n")).first()["n"]
        text = F.when(~text.rlike(f"^(?:[^A-Za-z0-9]*+[A-Za-z0-9]){{{longest + 1}}}"), text)
    lettered = df.withColumn("_letters", confusables.letter_skeleton(text))
    joined = lettered.join(F.broadcast(wanted) if names is None else wanted, F.col("_letters") == F.col("letters"), "left")
    name = F.get(F.filter("names", lambda n: n != F.col(column)), F.lit(0))
    return joined.withColumn(out, name).drop("_letters", "letters", "names")


def homoglyph_confusable(s: Column, target: Column | None = None, form: Column | None = None) -> Column:
    """``target`` is the column that ``with_target`` adds; without it no name is imitated."""
    target = F.lit(None).cast("string") if target is None else target
    form = nfc(s) if form is None else form
    level = identifiers.restriction_level(s)
    math, wide = icu.char_class((0x1D400, 0x1D7FF)), icu.char_class((0xFF01, 0xFFEF))
    short = F.least(F.length(s), F.length(form))
    differs = let(first_difference(s, form), lambda at: F.coalesce(F.when(at < short, at), F.lit(0)))
    plain = s.rlike(r"^[\x00-\x7F]*\z")
    return verdict(
        (target.isNotNull(), "TargetMatch", empty()),
        (plain, F.lit(None).cast("string"), empty()),
        (s.rlike(math), "MathAlpha", one(first_position(s, math))),
        (s.rlike(wide), "WidthClass", one(first_position(s, wide))),
        (form != s, "DecompositionSwap", one(differs)),
        ((F.size(identifiers.scripts(s)) >= 2) & ~identifiers.highly_restrictive(s), "CrossScriptMix", empty()),
        (level.isin(*identifiers.LEVELS[4:]), "RestrictionLow", empty()),
    )


def mixed_script_admissibility(s: Column) -> Column:
    sets = identifiers.script_classes()
    latin, cyrl, grek = (s.rlike(sets[n]) for n in ("Latn", "Cyrl", "Grek"))
    barred = icu.regex(identifiers.ALLOWED, negated=True)
    return verdict(
        (s.rlike(barred), "RestrictedStatusCp", positions(s, barred)),
        (latin & cyrl, "LatinCyrillic", positions(s, sets["Cyrl"])),
        (latin & grek, "LatinGreek", positions(s, sets["Grek"])),
        (identifiers.ascii_only(s), F.lit(None).cast("string"), empty()),
        ((F.size(identifiers.scripts(s)) >= 2) & ~identifiers.highly_restrictive(s), "ScriptMixOther", empty()),
    )


def emoji_zwj_integrity(s: Column) -> Column:
    inner, modifier = layout.zwj_alphabet(), layout.emoji_class("Emoji_Modifier")
    joiners = positions(s, r"\x{200D}")
    double = where(s, r"\x{200D}", lambda cs, c, i: following(cs, i) == layout.ZWJ, r"\x{200D}\x{200D}")
    stray = where(s, r"\x{200D}", lambda cs, c, i: ~(previous(cs, i).rlike(inner) & following(cs, i).rlike(inner)))
    tones = _count(s, modifier)
    return verdict(
        ((F.size(joiners) == 0) & (tones <= 1), F.lit(None).cast("string"), empty()),
        (layout.is_rgi_zwj(s), F.lit(None).cast("string"), empty()),
        (F.size(double) > 0, "DoubleZWJ", double),
        (F.size(stray) > 0, "NonEmojiInjection", one(F.array_min(stray))),
        (F.length(s) > 16, "OverLength", empty()),
        (tones >= 5, "SkinToneOverflow", empty()),
        (F.size(joiners) > 0, "UnregisteredSequence", joiners),
    )


def skin_tone_forgery(s: Column, at_start: bool = False) -> Column:
    """``at_start`` also counts a modifier that opens the text, which has no character before it."""
    modifier, base, shown = layout.emoji_class("Emoji_Modifier"), layout.emoji_class("Emoji_Modifier_Base"), layout.emoji_class("Emoji_Presentation")
    tone = lambda c: c.rlike(modifier)
    first = 0 if at_start else 1
    stacked = F.array_min(where(s, modifier, lambda cs, c, i: (i >= first) & tone(following(cs, i)), f"{modifier}{modifier}"))
    target = F.array_min(where(s, modifier, lambda cs, c, i: (i >= first) & ~previous(cs, i).rlike(base)))
    forced = F.array_min(where(s, r"\x{FE0E}", lambda cs, c, i: previous(cs, i).rlike(shown)))
    return verdict(
        (stacked.isNotNull(), "StackedSkinTones", F.array(stacked, stacked + 1)),
        (target.isNotNull(), "InvalidSkinToneTarget", one(target)),
        (forced.isNotNull(), "ForcedTextStyle", one(forced)),
    )


# Display


def source_display_divergence(s: Column, parts: dict[str, Column] | None = None) -> Column:
    """Which of five other detectors fire; ``parts`` has their verdicts where at hand."""
    parts = parts or {}
    get = lambda name, f: (parts[name] if name in parts else f(s))["tag"].isNotNull()
    with tags_only():
        fired = (
            ("TagBlock", get("tagBlockPayload", tag_block_payload)), ("VariationSelector", get("variationSelectorPayload", variation_selector_payload)),
            ("ZeroWidth", get("zeroWidthPayload", zero_width_payload)), ("BidiControl", get("bidiControlBalance", bidi_control_balance)),
            ("IdentifierHomoglyph", get("homoglyphConfusable", homoglyph_confusable)),
        )
    names = F.array_compact(F.array(*[F.when(f, F.lit(name)) for name, f in fired]))
    return let(names, lambda n: verdict((F.size(n) >= 2, "Compound", empty()), (F.size(n) == 1, F.get(n, F.lit(0)), empty())))


def filename_disguise(s: Column) -> Column:
    ext_at = F.length(F.regexp_extract(s, r"(?s)^(.*[.])", 1))
    ext = F.substring_index(s, ".", -1)
    wide, extend = icu.char_class((0xFF01, 0xFFEF)), icu.regex("[:GCB=Extend:]")
    return verdict(
        (layout.has_bidi_control(s), "RloFlip", one(first_position(s, layout.BIDI_CONTROL))),
        (s.contains(".") & ext.rlike(wide), "WidthClassExt", one(ext_at + first_position(ext, wide))),
        (s.contains(".") & ext.rlike(extend), "CombiningInExt", one(ext_at + first_position(ext, extend))),
        (s.rlike(r"(?s)[.].*?[.].*?[.]"), "MultipleExtensions", positions(s, "[.]")),
    )


def rtl_injection(s: Column) -> Column:
    rtl, ltr = icu.regex("[[:bc=R:][:bc=AL:]]"), icu.regex("[:bc=L:]")
    neither = icu.regex("[[:bc=R:][:bc=AL:][:bc=L:]]", negated=True)
    longest = F.array_max(F.transform(F.regexp_extract_all(s, F.lit(f"({rtl}+)"), F.lit(1)), lambda r: F.length(r)))
    return verdict(
        (layout.has_bidi_control(s), "RloInLTRField", one(first_position(s, layout.BIDI_CONTROL))),
        (~s.rlike(rtl), F.lit(None).cast("string"), empty()),
        (s.rlike(f"^{neither}*+{rtl}"), "FieldTakeover", one(first_position(s, rtl))),
        (longest >= 4, "MixedOverflow", one(first_match(s, f"{rtl}{{4}}"))),
        (F.lit(True), "StrongRTLInLTR", one(first_position(s, rtl))),
    )


def renderer_divergence(s: Column) -> Column:
    extend = icu.regex("[:GCB=Extend:]")
    wide = icu.char_class((0xFF01, 0xFFEF))
    rtl, ltr = icu.regex("[[:bc=R:][:bc=AL:]]"), icu.regex("[:bc=L:]")
    stack = f"[^{extend[1:]}{extend}{{4}}"
    return verdict(
        (s.rlike(stack), "CombiningStackOverflow", one(first_match(s, stack))),
        (s.rlike(layout.VARIATION_SELECTOR), "VariationSelectorVariance", one(first_position(s, layout.VARIATION_SELECTOR))),
        (s.contains(layout.ZWJ) & ~layout.is_rgi_zwj(s), "UnregisteredZwjVariance", one(first_position(s, r"[\x{200D}]"))),
        (s.rlike(wide), "FullwidthVariance", one(first_position(s, wide))),
        (s.rlike(rtl) & s.rlike(ltr), "MixedDirectionVariance", empty()),
    )


# Form


def normalization_bomb(s: Column, forms: dict[str, Column] | None = None) -> Column:
    compat = icu.regex("[:NFKD_QC=N:]")
    large = F.array_min(where(s, compat, lambda cs, c, i: F.length(normalized(c, "NFKD")) > 8))
    return let(large, lambda at: _bomb(s, at, forms))


def _bomb(s: Column, large: Column, forms: dict[str, Column] | None) -> Column:
    n = F.greatest(F.length(s), F.lit(1))
    grown = lambda form: F.floor(F.length((forms or {}).get(form, normalized(s, form))) * 100 / n)
    return verdict(
        (identifiers.ascii_only(s), F.lit(None).cast("string"), empty()),
        (large.isNotNull(), "SingleCpBlowup", one(large)),
        (grown("NFKD") > 400, "NfkdHighExpansion", empty()),
        (grown("NFD") > 300, "NfdHighExpansion", empty()),
    )


def stream_safe_violation(s: Column) -> Column:
    run = icu.regex("[:^ccc=0:]") + "{31}"
    return verdict((s.rlike(run), "StreamSafeOverrun", one(first_match(s, run))))


def locale_case_inversion(s: Column) -> Column:
    below = icu.regex("[[:^ccc=0:]-[:ccc=230:]]")
    above = icu.regex("[:ccc=230:]")
    turkish = (f"[{casing.DOTTED_I}]|I(?!{below}*+\\x{{307}})|(?<=I{below}{{0,30}})\\x{{307}}")
    baltic = (f"[ÌÍĨ]|[IJĮ](?={below}*+{above})")
    return verdict(
        (s.rlike(turkish), "TurkishCaseDivergence", one(first_match(s, turkish))), (s.rlike(baltic), "LithuanianCaseDivergence", one(first_match(s, baltic)))
    )


def case_expansion_mismatch(s: Column) -> Column:
    changes = icu.regex("[[:CWU:]-[a-z]]")
    more = F.array_min(where(s, changes, lambda cs, c, i: F.length(F.upper(c)) > 1))
    return let(more, lambda first: _expansion(s, first))


def _expansion(s: Column, more: Column) -> Column:
    return verdict(
        (more.isNotNull(), "UpperExpansion", one(more)),
        (s.contains(casing.DOTTED_I), "LowerExpansion", one(first_position(s, f"[{casing.DOTTED_I}]"))),
    )


def width_class_confusion(s: Column) -> Column:
    full, half = icu.regex("[[:ea=F:]&[:NFKD_QC=N:]]"), icu.regex("[[:ea=H:]&[:NFKD_QC=N:]]")
    return verdict((s.rlike(full), "FullwidthFold", one(first_position(s, full))), (s.rlike(half), "HalfwidthFold", one(first_position(s, half))))


def nfc_idempotence_witness(s: Column, forms: dict[str, Column] | None = None) -> Column:
    c, k = (forms or {}).get("NFC", nfc(s)), (forms or {}).get("NFKC", nfkc(s))
    return verdict((c != s, "NonNfcForm", one(first_difference(s, c))), (k != s, "NonNfkcCompatForm", one(first_difference(s, k))))


# Boundaries between layers


def _status_shifts(s: Column) -> Column:
    compat, allowed = icu.regex("[:NFKD_QC=N:]"), icu.regex(identifiers.ALLOWED)
    head = lambda c: F.substring(normalized(c, "NFKD"), 1, 1)
    return where(s, compat, lambda cs, c, i: c.rlike(allowed) != head(c).rlike(allowed))


def identifier_form_drift(s: Column) -> Column:
    return let(F.array_min(_status_shifts(s)), lambda at: verdict((at.isNotNull(), "IdentifierStatusShift", one(at))))


def covert_display_compound(s: Column) -> Column:
    bidi, bad = first_position(s, layout.BIDI_CONTROL), suspicious_selectors(s)
    return verdict(
        (bidi.isNull(), F.lit(None).cast("string"), empty()),
        (F.size(bad) > 0, "BidiPlusUnregisteredVs", F.array(bidi, F.array_min(bad))),
        (s.rlike(layout.TAG), "BidiPlusTagBlock", F.array(bidi, first_position(s, layout.TAG))),
    )


def confusable_bidi_compound(s: Column) -> Column:
    look, over, isolate = confusables.confusable_class(), icu.char_class((0x202A, 0x202E)), icu.char_class((0x2066, 0x2069))
    at = first_position(s, look)
    return verdict(
        (~layout.has_bidi_control(s) | ~s.rlike(look), F.lit(None).cast("string"), empty()),
        (s.rlike(over), "ConfusableInOverride", F.array(at, first_position(s, over))),
        (F.lit(True), "ConfusableInIsolate", F.array(at, first_position(s, isolate))),
    )


def admissibility_form_drift(s: Column, forms: dict[str, Column] | None = None) -> Column:
    a, b = identifiers.allowed_identifier(s), identifiers.allowed_identifier((forms or {}).get("NFKC", nfkc(s)))
    return verdict((a != b, "AdmissibilityFormDrift", empty()))


# Cryptographic input


_SPACE = r"[\x{20}\x{3000}]"


def mnemonic_words(s: Column, form: Column | None = None) -> Column:
    """The words of a text in NFKD and lower case, cut at spaces."""
    canonical = F.trim(F.regexp_replace(F.lower(nfkd(s) if form is None else form), f"{_SPACE}+", " "))
    return F.filter(F.split(canonical, " "), lambda w: w != "")


def with_mnemonic(df: DataFrame, column: str, wordlists: DataFrame, out: str = "mnemonic") -> DataFrame:
    """Add ``(unknown, covered, language)``: the place of the first word of no list, whether one list has all words, and the first such list.

    ``wordlists(lang, word)`` is a table of up to 62 lists. Words meet it in an equality join,
    each list being one bit; what is found goes back by the digest of the text, so equal texts share it.
    """
    langs = sorted(r["lang"] for r in wordlists.select("lang").distinct().limit(63).collect())
    if len(langs) > 62:
        raise ValueError("more than 62 word lists")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.array_position(F.array(*map(F.lit, langs)).cast("array<string>"), F.col("lang")).cast("int") - 1)
    known = wordlists.select(nfkd(F.col("word")).alias("_word"), bit.alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_lists"))
    rows = df.withColumn("_key", F.sha2(F.col(column), 256))
    parts = rows.select("_key", F.posexplode(mnemonic_words(F.col(column))).alias("_at", "_word")).join(known, "_word", "left")
    state = parts.groupBy("_key").agg(F.min(F.when(F.col("_lists").isNull(), F.col("_at"))).alias("unknown"), F.bit_and(F.coalesce("_lists", F.lit(0).cast("long"))).alias("_all"))
    found = rows.join(state, "_key", "left")
    language = F.get(F.filter(F.transform(F.array(*map(F.lit, langs)).cast("array<string>"), lambda n, i: F.when(F.call_function("getbit", F.coalesce("_all", F.lit(0).cast("long")), i) == 1, n)), lambda n: n.isNotNull()), F.lit(0))
    return found.select(*df.columns, F.struct("unknown", (F.coalesce("_all", F.lit(1).cast("long")) != 0).alias("covered"), language.alias("language")).alias(out))


def bip39_canonical(s: Column, mnemonic: Column | None = None, forms: dict[str, Column] | None = None) -> Column:
    """``mnemonic`` is the column that ``with_mnemonic`` adds; without it words are not looked up."""
    form = (forms or {}).get("NFKD", nfkd(s))
    trailing = F.length(s) - F.length(F.rtrim(s, F.lit("\u0020\u3000")))
    rules: list[Rule] = [
        (trailing > 0, "TrailingWhitespace", one(F.length(s) - trailing)),
        (s.rlike("[A-Z]"), "MixedCase", one(first_position(s, "[A-Z]"))),
        (s.rlike(f"^{_SPACE}"), "WhitespaceAnomaly", one(F.lit(0))),
        (s.rlike(f"{_SPACE}{_SPACE}"), "WhitespaceAnomaly", one(first_match(s, f"{_SPACE}{_SPACE}"))),
        (form != s, "NonNFKD", one(first_difference(s, form))),
    ]
    if mnemonic is not None:
        rules += [(mnemonic["unknown"].isNotNull(), "WordlistMismatch", one(mnemonic["unknown"])), (~mnemonic["covered"], "LanguageAmbiguous", empty())]
    return verdict(*rules)


#: Signing rules by name: a pattern whose first match violates the rule.
SIGNING_RULES = {
    "pgp4880TrailingWhitespace": r"[ \t]+(?=\r?\n|\z)", "pgp9580LineEnding": r"(?<!\r)\n|\r(?!\n)", "rfc5751SmimeLineEnding": r"(?<!\r)\n|\r(?!\n)", "rfc8259ControlChar": r"[\x00-\x1F]",
    "rfc7515JwsBase64Url": r"[^A-Za-z0-9_-]", "rfc6376DkimRelaxed": r"(?<=[ \t])[ \t]",
}


def hash_input_stability(
    s: Column, declared: Column | None = None, rule: Column | None = None, as_written: Column | None = None, server_bytes: Column | None = None,
    forms: dict[str, Column] | None = None,
) -> Column:
    """Context columns may be null or absent: declared encoding, signing rule, logged and received text."""
    none = F.lit(None).cast("string")
    declared, rule, as_written, server_bytes = (none if c is None else c for c in (declared, rule, as_written, server_bytes))
    broken = F.lit(None).cast("int")
    for name, pattern in SIGNING_RULES.items():
        broken = F.when(rule == name, first_match(s, pattern)).otherwise(broken)
    form = (forms or {}).get("NFC", nfc(s))
    broken = F.when(rule == "rfc8785NfcRequirement", first_difference(s, form)).otherwise(broken)
    trailing = F.length(s) - F.length(F.rtrim(s, F.lit(" \t\n\r")))
    return verdict(
        (declared.isNotNull() & ~F.lower(declared).isin("utf-8", "utf8"), "EncodingMismatch", one(F.lit(0))),
        (server_bytes.isNotNull() & (server_bytes != s), "WebhookSignatureDrift", one(first_difference(s, server_bytes))),
        (as_written.isNotNull() & (as_written != s), "AuditLogReinterpretation", one(first_difference(s, as_written))),
        (broken.isNotNull(), "SignedMessageRule", one(broken)),
        (trailing > 0, "TrailingWhitespace", one(F.length(s) - trailing)),
        (form != s, "NormalizationDrift", one(first_difference(s, form))),
    )


def _regular(at: Column, tolerance: int) -> Column:
    """Whether positions are evenly spaced, each gap within a tolerance of the first."""
    gaps = let(at, lambda ps: F.transform(F.slice(ps, 2, F.greatest(F.size(ps) - 1, F.lit(0))), lambda p, i: p - F.get(ps, i)))
    return let(gaps, lambda gs: F.forall(gs, lambda g: F.abs(g - F.get(gs, F.lit(0))) <= tolerance))


def _phrase(s: Column) -> Rule:
    phrase = F.get(F.filter(F.array(*map(F.lit, curated.FAVOURED)), lambda v: s.contains(v)), F.lit(0))
    return phrase.isNotNull(), "StatisticalTokenChoice", one(F.call_function("instr", s, phrase) - 1)


def ai_watermark(s: Column, tolerance: int = 0) -> Column:
    emoji = layout.emoji_class()
    selectors = icu.char_class((0xFE00, 0xFE0F), (0xE0100, 0xE01EF))
    alone = lambda cs, i: ~previous(cs, i).rlike(emoji) & ~following(cs, i).rlike(emoji)
    nnbsp, zwsp = positions(s, r"\x{202F}"), positions(s, r"\x{200B}")
    marks = where(s, selectors, lambda cs, c, i: alone(cs, i))
    joiners = where(s, r"\x{200D}", lambda cs, c, i: alone(cs, i))
    others = icu.regex(r"[[:DI:]-[︀-️]-[\U000E0100-\U000E01EF]-[‍]]")
    curly, dash = positions(s, r"[\x{2018}\x{2019}\x{201C}\x{201D}]"), positions(s, r"\x{2014}")
    found = {"nnbsp": nnbsp, "zwsp": zwsp, "marks": marks, "joiners": joiners, "ignorable": positions(s, others), "curly": curly, "dash": dash}
    return let(F.struct(*[x.alias(name) for name, x in found.items()]), lambda at: _watermark(s, {name: at[name] for name in found}, tolerance))


def _watermark(s: Column, at: dict[str, Column], tolerance: int) -> Column:
    nnbsp, zwsp, marks, joiners, ignorable, curly, dash = at.values()
    kinds = reduce(lambda a, b: a + b, [(F.size(x) > 0).cast("int") for x in (nnbsp, marks, joiners, ignorable)])
    every = lambda *xs: F.array_sort(F.array_distinct(F.concat(*xs)))
    return verdict(
        ((F.size(nnbsp) >= 3) & _regular(nnbsp, tolerance), "Adversarial", nnbsp),
        ((F.size(zwsp) >= 3) & _regular(zwsp, tolerance), "Gpt5ZwspModulo", zwsp),
        (kinds >= 2, "Unknown", every(nnbsp, marks, joiners, ignorable)),
        (F.size(nnbsp) > 0, "NnbspBoundary", nnbsp),
        (F.size(marks) > 0, "VariationSelectorCarrier", marks),
        (F.size(joiners) > 0, "ZwjNonEmoji", joiners),
        ((F.size(curly) >= 2) & ~s.rlike("[\"']"), "SmartQuoteAlternation", curly),
        ((F.size(dash) >= 2) & ~s.contains("-"), "EmDashPattern", dash),
        _phrase(s),
        (F.size(ignorable) > 0, "DefaultIgnorableCarrier", ignorable),
    )


#: Families in order, with their layer.
FAMILIES: dict[str, tuple[str, Callable[[Column], Column]]] = {
    "tagBlockPayload": ("covert", tag_block_payload),
    "variationSelectorPayload": ("covert", variation_selector_payload),
    "zeroWidthPayload": ("covert", zero_width_payload),
    "surrogateReassembly": ("covert", surrogate_reassembly),
    "bidiControlBalance": ("covert", bidi_control_balance),
    "homoglyphConfusable": ("identity", homoglyph_confusable),
    "mixedScriptAdmissibility": ("identity", mixed_script_admissibility),
    "emojiZwjIntegrity": ("identity", emoji_zwj_integrity),
    "skinToneVariationForgery": ("identity", skin_tone_forgery),
    "sourceDisplayDivergence": ("display", source_display_divergence),
    "filenameDisguise": ("display", filename_disguise),
    "rtlInjection": ("display", rtl_injection),
    "rendererDivergence": ("display", renderer_divergence),
    "normalizationBomb": ("form", normalization_bomb),
    "streamSafeViolation": ("form", stream_safe_violation),
    "localeCaseInversion": ("form", locale_case_inversion),
    "caseExpansionMismatch": ("form", case_expansion_mismatch),
    "widthClassConfusion": ("form", width_class_confusion),
    "nfcIdempotenceWitness": ("form", nfc_idempotence_witness),
    "identifierFormDrift": ("boundary", identifier_form_drift),
    "covertDisplayCompound": ("boundary", covert_display_compound),
    "confusableBidiCompound": ("boundary", confusable_bidi_compound),
    "admissibilityFormDrift": ("boundary", admissibility_form_drift),
    "bip39Canonical": ("crypto", bip39_canonical),
    "hashInputStability": ("crypto", hash_input_stability),
    "aiWatermarkDetectability": ("crypto", ai_watermark),
}

#: Texts of characters below U+0100, of which most families need to know little.
LATIN_1 = r"^[\x{0}-\x{FF}]*\z"


def _clear(s: Column) -> Column:
    return verdict((F.lit(False), "", empty()))


@lru_cache(maxsize=1)
def _latin_shifts() -> str:
    """The characters below U+0100 whose decomposition starts with one of another identifier status."""
    allowed = lambda cp: any(a <= cp <= b for a, b in icu.ranges(identifiers.ALLOWED))
    heads = {cp: ord(unicodedata.normalize("NFKD", chr(cp))[0]) for cp in range(256)}
    return icu.char_class(*[cp for cp, head in heads.items() if head != cp and allowed(cp) != allowed(head)])


def _latin_status_shift(s: Column) -> Column:
    return verdict((s.rlike(_latin_shifts()), "IdentifierStatusShift", one(first_position(s, _latin_shifts()))))


def _latin_locale_case(s: Column) -> Column:
    return verdict((s.contains("I"), "TurkishCaseDivergence", one(first_position(s, "[I]"))), (s.rlike("[ÌÍ]"), "LithuanianCaseDivergence", one(first_position(s, "[ÌÍ]"))))


def _latin_watermark(s: Column) -> Column:
    """Of what carries a mark there is the soft hyphen only."""
    return verdict(_phrase(s), (s.contains("\xad"), "DefaultIgnorableCarrier", positions(s, r"[\xAD]")))


def _latin_soft_hyphens(s: Column) -> Column:
    return verdict((s.contains("\xad"), "BareZeroWidth", positions(s, r"[\xAD]")))


#: What families say of texts that LATIN_1 matches, without looking for what stands above.
ON_LATIN_1: dict[str, Callable[[Column], Column]] = {
    "zeroWidthPayload": _latin_soft_hyphens,
    "localeCaseInversion": _latin_locale_case,
    "caseExpansionMismatch": lambda s: verdict((s.contains("ß"), "UpperExpansion", one(first_position(s, "[ß]")))),
    "identifierFormDrift": _latin_status_shift,
    "aiWatermarkDetectability": _latin_watermark,
} | dict.fromkeys(
    (
        "tagBlockPayload", "variationSelectorPayload", "bidiControlBalance", "emojiZwjIntegrity", "skinToneVariationForgery", "rtlInjection", "rendererDivergence",
        "normalizationBomb", "streamSafeViolation", "widthClassConfusion", "covertDisplayCompound", "confusableBidiCompound",
    ),
    _clear,
)
