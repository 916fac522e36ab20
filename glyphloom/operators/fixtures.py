"""Run rows of expected verdicts (see ``sources.delimited.read_fixtures``) through their detectors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.codec import from_codepoints
from . import detectors, metrics

#: Keys of a row's attribution that are a signed text's context, in the detector's order.
CONTEXT = ("declaredEnc", "rfcRule", "asWritten", "serverBytes")


def _spelt(key: str) -> Column:
    """A context text, spelt as code points in hexadecimal."""
    parts = F.filter(F.split(F.element_at("attribution", F.lit(key)), r"\s+"), lambda x: x != "")
    return F.when(F.array_contains(F.map_keys("attribution"), key), from_codepoints(F.transform(parts, lambda x: F.conv(x, 16, 10).cast("int"))))


def _detector(family: str, s: Column) -> Column:
    if family == "hashInputStability":
        plain = [F.try_element_at("attribution", F.lit(k)) for k in CONTEXT[:2]]
        return detectors.hash_input_stability(s, *plain, *map(_spelt, CONTEXT[2:]))
    if family == "homoglyphConfusable":
        return detectors.homoglyph_confusable(s, F.col("target"))
    if family == "bip39Canonical":
        return detectors.bip39_canonical(s, F.col("mnemonic"))
    return detectors.FAMILIES[family][1](s)


def verdicts(rows: DataFrame, wordlists: DataFrame) -> DataFrame:
    """``rows`` with ``found`` (tag and positions), whether both agree with what is expected, and whether what the attribution claims of the figures does."""
    rows = rows.withColumn("text", from_codepoints(F.col("input")))
    name = F.concat(F.lower(F.substring("family", 1, 1)), F.substring("family", 2, 100))
    parts = []
    for family in detectors.FAMILIES:
        own = rows.where(name == family)
        if family == "homoglyphConfusable":
            own = detectors.with_target(own, "text")
        if family == "bip39Canonical":
            own = detectors.with_mnemonic(own, "text", wordlists)
        found = own.withColumn("found", _detector(family, F.col("text")))
        # only a clear mnemonic has a language
        more = {"language": F.when(F.col("found.tag").isNull(), F.col("mnemonic.language")).otherwise("")} if family == "bip39Canonical" else None
        claims = metrics.agrees(F.col("attribution"), F.col("text"), family, more)
        parts.append(found.select(*rows.columns, "found", claims.alias("same_figures")))
    both = reduce(DataFrame.unionByName, parts)
    same = F.col("tag").eqNullSafe(F.col("found.tag"))
    return both.withColumn("same_tag", same).withColumn("same_positions", F.array_sort("positions") == F.array_sort("found.positions"))
