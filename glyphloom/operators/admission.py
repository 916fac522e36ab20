"""All detectors over a corpus: long-form verdicts, admission by level, roll-ups."""

from __future__ import annotations

from contextlib import nullcontext

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.codec import let
from ..functions.normalize import normalized
from . import detectors

FORMS = ("NFC", "NFD", "NFKC", "NFKD")
#: Detectors that use normalization forms computed once for all.
_FORMED = {
    "normalizationBomb": detectors.normalization_bomb, "nfcIdempotenceWitness": detectors.nfc_idempotence_witness,
    "admissibilityFormDrift": detectors.admissibility_form_drift,
}
_CRYPTO = {"nonCrypto": (), "bip39Mnemonic": ("bip39Canonical",), "hashInput": ("hashInputStability",), "aiAttribution": ("aiWatermarkDetectability",)}
_MODERATE_ALLOWS = ("emojiZwjIntegrity", "rtlInjection", "rendererDivergence", "normalizationBomb")
#: Families whose hazards bar a text, by level.
REJECTION = {
    "restrictive": tuple(n for n, (layer, _) in detectors.FAMILIES.items() if layer != "crypto"),
    "moderate": tuple(n for n, (layer, _) in detectors.FAMILIES.items() if layer != "crypto" and n not in _MODERATE_ALLOWS),
    "minimal": ("surrogateReassembly", "bidiControlBalance", "streamSafeViolation"),
}
SEVERITIES = ("informational", "low", "moderate", "high", "critical")


CONTEXT = ("declared", "rule", "as_written", "server_bytes")


def run_all(
    df: DataFrame, column: str, families: tuple[str, ...] | None = None, wordlists: DataFrame | None = None, context: dict[str, str] | None = None, tolerance: int = 0,
    positions: bool = True,
) -> DataFrame:
    """``df`` with ``verdicts``: an array of ``(family, layer, tag, positions)``, one per family.

    Normalization forms and the imitated name are computed once, as columns that the
    detectors share. Null texts have null tags. ``wordlists(lang, word)`` are the mnemonic
    detector's; without them it looks no word up. ``context`` names the columns of ``df`` that
    hold a signed text's CONTEXT; ``tolerance`` is the watermark detector's. Without
    ``positions`` they are left empty, for callers that only read tags.
    """
    with nullcontext() if positions else detectors.tags_only():
        return _run_all(df, column, families, wordlists, context, tolerance)


def _run_all(df: DataFrame, column: str, families: tuple[str, ...] | None, wordlists: DataFrame | None, context: dict[str, str] | None, tolerance: int) -> DataFrame:
    wanted = families or tuple(detectors.FAMILIES)
    base, mnemonic = df, None
    # words first: they read the texts a second time, and the imitated name would be sought twice
    if wordlists is not None and "bip39Canonical" in wanted:
        base, mnemonic = detectors.with_mnemonic(base, column, wordlists, "_mnemonic"), F.col("_mnemonic")
    base = detectors.with_target(base, column, "_target")
    around = {k: F.col(c) for k, c in (context or {}).items()}
    s = F.col(column)
    # most texts are in Latin letters, and most families look for what stands above them
    base = base.select("*", *[normalized(s, f).alias(f"_{f}") for f in FORMS], s.rlike(detectors.LATIN_1).alias("_latin"))
    forms = {f: F.col(f"_{f}") for f in FORMS}
    found: dict[str, Column] = {}
    for name in wanted:
        if name in _FORMED:
            found[name] = _FORMED[name](s, forms=forms)
        elif name == "bip39Canonical":
            found[name] = detectors.bip39_canonical(s, mnemonic, forms)
        elif name == "hashInputStability":
            found[name] = detectors.hash_input_stability(s, *(around.get(c) for c in CONTEXT), forms=forms)
        elif name == "aiWatermarkDetectability":
            found[name] = detectors.ai_watermark(s, tolerance)
        elif name == "homoglyphConfusable":
            found[name] = detectors.homoglyph_confusable(s, F.col("_target"), forms["NFC"])
        elif name != "sourceDisplayDivergence":
            found[name] = detectors.FAMILIES[name][1](s)
    for name, latin in detectors.ON_LATIN_1.items():
        if name in found:
            found[name] = F.when(F.col("_latin"), latin(s)).otherwise(found[name])
    # each verdict appears once in the plan; the compound one reads the others from their array
    row = lambda n, v: F.struct(F.lit(n).alias("family"), F.lit(detectors.FAMILIES[n][0]).alias("layer"), v.alias("v"))
    order = list(found)
    verdicts = F.array(*[row(n, found[n]) for n in order])

    def finish(all_rows: Column) -> Column:
        at = {n: F.get(all_rows, F.lit(i)) for i, n in enumerate(order)}
        parts = {n: x["v"] for n, x in at.items()}
        rows = []
        for n in wanted:
            if n == "sourceDisplayDivergence":
                display = detectors.source_display_divergence(s, parts if "homoglyphConfusable" in parts else parts | {"homoglyphConfusable": homoglyph})
                at[n] = row(n, display)
            rows.append(at[n])
        return F.transform(F.array(*rows), lambda x: F.struct(x["family"].alias("family"), x["layer"].alias("layer"), x["v"]["tag"].alias("tag"), x["v"]["positions"].alias("positions")))

    homoglyph = detectors.homoglyph_confusable(s, F.col("_target"), forms["NFC"])
    return base.select(*df.columns, let(verdicts, finish).alias("verdicts"))


def hazards(
    df: DataFrame, column: str, families: tuple[str, ...] | None = None, wordlists: DataFrame | None = None, context: dict[str, str] | None = None, tolerance: int = 0,
    positions: bool = True,
) -> DataFrame:
    """One row per hazard found: ``df``'s columns with ``family, layer, tag, positions``; the rest as for ``run_all``."""
    found = run_all(df, column, families, wordlists, context, tolerance, positions)
    fired = F.filter("verdicts", lambda v: v["tag"].isNotNull())
    return found.select(*df.columns, F.explode(fired).alias("v")).select(*df.columns, "v.*")


def rejection_families(level: str, context: str = "nonCrypto") -> tuple[str, ...]:
    return (*REJECTION[level], *_CRYPTO[context])


def admissible(verdicts: Column, level: str, context: str = "nonCrypto") -> Column:
    """Whether no family that the level or context rejects has found a hazard."""
    barred = F.array(*map(F.lit, rejection_families(level, context)))
    return ~F.exists(verdicts, lambda v: v["tag"].isNotNull() & F.array_contains(barred, v["family"]))


def compose(*verdicts: Column) -> Column:
    """The verdicts of several runs on one text as one array."""
    return F.concat(*verdicts)


def severity_name(rank: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, SEVERITIES)), rank.cast("int") + 1)


def sites(verdicts: Column, severities: dict[str, str] | None = None) -> Column:
    """The hazards of a row as ``(family, tag, severity, positions, first, last)``, in the order of families.

    A site is moderate unless ``severities`` names its ``family`` or, before that, its ``family/tag``.
    ``first`` and ``last`` are the ends of its positions, 0 where it has none.
    """
    named = [x for key, level in (severities or {}).items() for x in (F.lit(key), F.lit(SEVERITIES.index(level)))]
    table = F.create_map(*named) if named else None

    def site(v: Column) -> Column:
        rank = F.lit(SEVERITIES.index("moderate"))
        if table is not None:
            rank = F.coalesce(F.try_element_at(table, F.concat(v["family"], F.lit("/"), v["tag"])), F.try_element_at(table, v["family"]), rank)
        ends = lambda f: F.coalesce(f(v["positions"]), F.lit(0))
        return F.struct(
            v["family"].alias("family"), v["tag"].alias("tag"), severity_name(rank).alias("severity"), v["positions"].alias("positions"), ends(F.array_min).alias("first"), ends(F.array_max).alias("last")
        )

    return F.transform(F.filter(verdicts, lambda v: v["tag"].isNotNull()), site)


def composite(verdicts: Column, severities: dict[str, str] | None = None) -> Column:
    """``(kind, n_sites, severity)`` of a row: clear, hazard or compound, and the greatest severity of its sites."""
    return let(sites(verdicts, severities), _rolled_up)


def _rolled_up(found: Column) -> Column:
    n = F.size(found)
    kind = F.when(n == 0, "clear").when(n == 1, "hazard").otherwise("compound")
    order = F.array(*map(F.lit, SEVERITIES))
    worst = F.array_max(F.transform(found, lambda s: F.array_position(order, s["severity"]).cast("int") - 1))
    return F.struct(kind.alias("kind"), n.alias("n_sites"), severity_name(F.coalesce(worst, F.lit(0))).alias("severity"))


def hazard_rollup(df: DataFrame, column: str, by: tuple[str, ...] = (), wordlists: DataFrame | None = None, context: dict[str, str] | None = None) -> DataFrame:
    """Hazards counted by layer and family, with subtotals; word lists and context as for ``run_all``."""
    return hazards(df, column, wordlists=wordlists, context=context, positions=False).rollup(*by, "layer", "family").agg(F.count(F.lit(1)).alias("n"))
