"""Figures beside the verdicts of the detectors, and checks of attributions against them.

Each family has a few named figures of a text: counts, lengths, flags and names. An attribution is a map of strings that claims
some of them; a claim that is absent agrees, one that cannot be read as its figure's type does not.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import confusables, identifiers, layout
from ..functions.codec import chars, let
from ..functions.normalize import nfc, nfd, nfkc, nfkd, normalized
from ..tables import icu
from . import detectors

Figure = Callable[[Column], Column]


def count(pattern: str) -> Figure:
    return lambda s: F.regexp_count(s, F.lit(pattern))


def icu_count(pattern: str) -> Figure:
    return lambda s: F.regexp_count(s, F.lit(icu.regex(pattern)))


def size(found: Callable[[Column], Column]) -> Figure:
    return lambda s: F.size(found(s))


def longest(pattern: str) -> Figure:
    """Length of the longest run of a set's characters."""
    return lambda s: F.coalesce(F.array_max(F.transform(F.regexp_extract_all(s, F.lit(f"({icu.regex(pattern)}++)"), F.lit(1)), lambda r: F.length(r))), F.lit(0))


_WIDE = icu.char_class((0xFF01, 0xFFEF))


def _extension(s: Column) -> Column:
    return F.when(s.contains("."), F.substring_index(s, ".", -1)).otherwise("")


def _largest(guard: str, least: int, grown: Callable[[Column], Column]) -> Figure:
    """The largest of a figure over a text's characters, which is ``least`` (0 for no text) for all that are not in ``guard``."""

    def run(s: Column) -> Column:
        cls = icu.regex(guard)
        hits = F.transform(F.regexp_extract_all(s, F.lit(f"({cls})"), F.lit(1)), grown)
        return F.when(s == "", 0).otherwise(F.greatest(F.lit(least), F.coalesce(F.array_max(hits), F.lit(0))))

    return run


def _uppers(s: Column) -> Column:
    changes = icu.regex("[[:CWU:]-[a-z]]")
    return F.filter(F.regexp_extract_all(s, F.lit(f"({changes})"), F.lit(1)), lambda c: F.length(F.upper(c)) > 1)


def _stable(s: Column) -> Column:
    return F.length(F.regexp_replace(nfc(s), r"[ \t\n\r]++\z", ""))


def _shifts(s: Column) -> Column:
    return detectors._status_shifts(s)


def _markers(s: Column) -> Column:
    """Markers of the scheme that the watermark detector names, none if it is clear; those of several kinds count each."""
    found = detectors.ai_watermark(s)
    return F.when(found["tag"].isNull(), 0).otherwise(F.size(found["positions"]))


_DOTTED = "[İ]"
_RTL, _LTR, _EXTEND, _NONSTART = "[[:bc=R:][:bc=AL:]]", "[:bc=L:]", "[:GCB=Extend:]", "[:^ccc=0:]"
_BIDI = layout.BIDI_CONTROL


def _balance(field: str) -> Figure:
    return lambda s: F.when(s == "", 0).otherwise(detectors.bidi_balance(s)[field])


#: Figures by family and name.
FIGURES: dict[str, dict[str, Figure]] = {
    "tagBlockPayload": {"tag_count": count(layout.TAG), "total_cps": F.length},
    "variationSelectorPayload": {"registered_vs": size(detectors.registered_selectors), "suspicious_vs": size(detectors.suspicious_selectors)},
    "zeroWidthPayload": {"zwsp_count": count(r"\x{200B}"), "zwj_count": count(r"\x{200D}"), "wj_count": count(r"\x{2060}"), "nnbsp_count": count(r"\x{202F}")},
    "bidiControlBalance": {
        "emb_open": count(r"[\x{202A}\x{202B}\x{202D}\x{202E}]"), "emb_pop": count(r"\x{202C}"), "iso_open": count(r"[\x{2066}-\x{2068}]"), "iso_pop": count(r"\x{2069}"),
        "max_depth": _balance("depth"),
    },
    "homoglyphConfusable": {"restriction": identifiers.restriction_level},
    "mixedScriptAdmissibility": {"level": identifiers.restriction_level},
    "emojiZwjIntegrity": {
        "chain_len": lambda s: F.when(s.contains(layout.ZWJ), F.length(s)).otherwise(0), "zwj_count": count(r"\x{200D}"), "skin_tone_count": icu_count("[:Emoji_Modifier:]"),
        "is_rgi": layout.is_rgi_zwj,
    },
    "skinToneVariationForgery": {"skin_tone_count": icu_count("[:Emoji_Modifier:]"), "vs15_count": count(r"\x{FE0E}"), "vs16_count": count(r"\x{FE0F}")},
    "filenameDisguise": {
        "dot_count": count("[.]"), "bidi_count": count(_BIDI), "fw_in_ext": lambda s: count(_WIDE)(_extension(s)), "comb_in_ext": lambda s: icu_count(_EXTEND)(_extension(s)),
    },
    "rtlInjection": {"strong_rtl": icu_count(_RTL), "strong_ltr": icu_count(_LTR), "bidi_count": count(_BIDI), "longest_run": longest(_RTL)},
    "rendererDivergence": {
        "vs_count": count(layout.VARIATION_SELECTOR), "comb_count": icu_count(_EXTEND), "fw_count": count(_WIDE), "has_zwj": lambda s: s.contains(layout.ZWJ),
        "ltr_count": icu_count(_LTR), "rtl_count": icu_count(_RTL),
    },
    "normalizationBomb": {
        "nfd_len": lambda s: F.length(nfd(s)), "nfkd_len": lambda s: F.length(nfkd(s)), "input_len": F.length,
        "max_per_cp": _largest("[:NFKD_QC=N:]", 1, lambda c: F.length(normalized(c, "NFKD"))),
    },
    "streamSafeViolation": {"max_run": longest(_NONSTART), "overruns": lambda s: F.regexp_count(s, F.lit(f"(?<!{icu.regex(_NONSTART)}){icu.regex(_NONSTART)}{{31,}}+")), "total_ns": icu_count(_NONSTART)},
    "caseExpansionMismatch": {
        "upper_exp": size(_uppers), "lower_exp": count(_DOTTED),
        "max_exp": _largest("[[[:CWU:]-[a-z]]İ]", 1, lambda c: F.greatest(F.length(F.upper(c)), F.length(F.lower(c)), F.when(c.rlike(_DOTTED), 2).otherwise(1))),
    },
    "widthClassConfusion": {"fw_fold": icu_count("[[:ea=F:]&[:NFKD_QC=N:]]"), "hw_fold": icu_count("[[:ea=H:]&[:NFKD_QC=N:]]")},
    "nfcIdempotenceWitness": {"nfc_len": lambda s: F.length(nfc(s)), "nfkc_len": lambda s: F.length(nfkc(s))},
    "identifierFormDrift": {"shift_count": size(_shifts)},
    "confusableBidiCompound": {"conf_count": lambda s: count(confusables.confusable_class())(s)},
    "admissibilityFormDrift": {"input_adm": identifiers.allowed_identifier, "nfkc_adm": lambda s: identifiers.allowed_identifier(nfkc(s))},
    "bip39Canonical": {"wordCount": lambda s: F.size(detectors.mnemonic_words(s))},
    "hashInputStability": {"stableSize": _stable},
    "aiWatermarkDetectability": {"markerCount": _markers},
}


def figures(s: Column, family: str) -> Column:
    """A family's figures of a text as a struct; null for a null text or a family without any."""
    own = FIGURES.get(family, {})
    if not own:
        return F.lit(None)
    return F.when(s.isNotNull(), let(s, lambda t: F.struct(*[f(t).alias(name) for name, f in own.items()])))


def as_attribution(figure_struct: Column, family: str) -> Column:
    """The figures as a map of strings, the form in which attributions claim them."""
    pairs = [x for name in FIGURES.get(family, {}) for x in (F.lit(name), figure_struct[name].cast("string"))]
    return F.create_map(*pairs) if pairs else F.lit(None).cast("map<string,string>")


def claim_agrees(attribution: Column, key: str, actual: Column, kind: str) -> Column:
    """Whether a claim holds: absent ones do, of ``kind`` number and flag those that can be read and are equal, of text equal ones."""
    raw = F.try_element_at(attribution, F.lit(key))
    if kind == "number":
        same = F.when(raw.rlike("^[0-9]+\\z"), raw.cast("decimal(38,0)") == actual).otherwise(False)
    elif kind == "flag":
        same = F.when(raw == "true", actual).when(raw == "false", ~actual).otherwise(False)
    else:
        same = raw == actual
    return F.when(raw.isNull(), True).otherwise(F.coalesce(same, F.lit(False)))


#: Figures that are no numbers.
_FLAGS = {"is_rgi", "has_zwj", "input_adm", "nfkc_adm"}
_TEXTS = {"restriction", "level", "language"}


def agrees(attribution: Column, s: Column, family: str, more: dict[str, Column] | None = None) -> Column:
    """Whether all that an attribution claims of a family's figures, and of ``more`` by name, holds of a text."""
    found = {name: f(s) for name, f in FIGURES.get(family, {}).items()} | (more or {})
    ok = F.lit(True)
    for name, actual in found.items():
        ok = ok & claim_agrees(attribution, name, actual, "flag" if name in _FLAGS else "text" if name in _TEXTS else "number")
    return F.coalesce(attribution.isNull() | ok, F.lit(False))


def measured(df: DataFrame, column: str, families: tuple[str, ...] | None = None) -> DataFrame:
    """``df`` with ``figures``, a struct of each family's figures."""
    s = F.col(column)
    return df.withColumn("figures", F.struct(*[figures(s, n).alias(n) for n in families or tuple(FIGURES)]))
