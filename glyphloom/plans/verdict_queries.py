"""Queries of the detectors over all documents, each beside its SQL.

The documents' own text fires few families, so most queries put a trigger into every text
(see ``text_queries.injected``); the SQL then derives tag and positions from the trigger.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..intermediate import written
from ..operators import admission, detectors
from .property_queries import APART as _APART
from .property_queries import COMPAT as _COMPAT
from .text_queries import AT, injected, injected_sql, read

Query = Callable[[SparkSession, str], DataFrame]

#: Position of the trigger in SQL, for a text t made from ``text``.
K = f"least({AT}, length(text))"


def _shown(v: Column) -> list[Column]:
    return [v["tag"].alias("tag"), F.array_join(v["positions"].cast("array<string>"), ",").alias("positions")]


def over_documents(detect: Callable[[Column], Column], triggers: list[str] | None) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        s = injected(F.col("text"), F.col("doc_id"), triggers) if triggers else F.col("text")
        rows = read(spark, sf_dir, "documents").select("doc_id", s.alias("t"))
        return rows.select("doc_id", detect(F.col("t")).alias("v")).select("doc_id", *_shown(F.col("v")))

    return run


def _at(*offsets: int) -> str:
    return " || ',' || ".join(f"({K} + {o})::VARCHAR" for o in offsets) or "''"


def by_trigger(family: str, rows: list[tuple[str, str | None, str]], detect: Callable[[Column], Column] | None = None) -> tuple[Query, str]:
    """An entry whose verdict follows from the trigger: rows of trigger, tag, positions in SQL."""
    n = len(rows)
    tags = " ".join(f"WHEN {i} THEN {tag if tag.startswith('CASE') else repr(tag)}" for i, (_, tag, _) in enumerate(rows) if tag)
    places = " ".join(f"WHEN {i} THEN {where}" for i, (_, tag, where) in enumerate(rows) if tag)
    sql = f"SELECT doc_id, CASE doc_id % {n} {tags} END AS tag, CASE doc_id % {n} {places} ELSE '' END AS positions FROM documents"
    return over_documents(detect or detectors.FAMILIES[family][1], [t for t, _, _ in rows]), sql


def by_text(family: str, tag: str, positions: str) -> tuple[Query, str]:
    sql = f"SELECT doc_id, {tag} AS tag, {positions} AS positions FROM documents"
    return over_documents(detectors.FAMILIES[family][1], None), sql


_STRONG = "regexp_matches(substr(text, 1, 10), '[A-Za-zÀ-ÖØ-öø-ÿ]')"
_HIGH = r"nullif(regexp_extract(text, '[\x{80}-\x{FF}]'), '')"


_AT_HIGH = f"(instr(text, {_HIGH}) - 1)"
_SURROGATE_TAG = (
    f"CASE WHEN {_HIGH} IS NULL THEN NULL WHEN ord({_HIGH}) >= 245 OR ord({_HIGH}) < 194 THEN 'InvalidStartByte' "
    f"WHEN {_AT_HIGH} + 1 = length(text) THEN 'Truncated' ELSE 'InvalidContinuation' END"
)
_MIXED_TAG = r"CASE WHEN regexp_matches(text, '[^''\-.0-9:A-Z_a-zÀ-ÖØ-öø-ÿ]') THEN 'RestrictedStatusCp' END"
_FILENAME_TAG = "CASE WHEN length(text) - length(replace(text, '.', '')) >= 3 THEN 'MultipleExtensions' END"
_LOCALE_TAG = "CASE WHEN contains(text, 'I') THEN 'TurkishCaseDivergence' WHEN regexp_matches(text, '[ÌÍ]') THEN 'LithuanianCaseDivergence' END"
_EXPANSION_TAG = "CASE WHEN contains(text, 'ß') THEN 'UpperExpansion' END"


def _surrogate() -> tuple[Query, str]:
    """Latin letters read as bytes: 0xF5 and up start nothing; others lack a continuation."""
    at = _AT_HIGH
    tag = _SURROGATE_TAG
    where = f"CASE WHEN {_HIGH} IS NULL THEN '' WHEN ord({_HIGH}) >= 245 OR ord({_HIGH}) < 194 THEN {at}::VARCHAR ELSE ({at} + 1)::VARCHAR END"
    return by_text("surrogateReassembly", tag, where)


def _every(pattern: str) -> str:
    return f"array_to_string([i - 1 for i in range(1, length(text) + 1) if regexp_matches(text[i], '{pattern}')], ',')"


def _crypto_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signing rules in turn over every document's text."""
    rules = [*detectors.SIGNING_RULES, "rfc8785NfcRequirement"]
    rule = F.element_at(F.array(*map(F.lit, rules)), (F.pmod("doc_id", F.lit(len(rules))) + 1).cast("int"))
    rows = read(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("t"), rule.alias("rule"))
    return rows.select("doc_id", detectors.hash_input_stability(F.col("t"), rule=F.col("rule")).alias("v")).select("doc_id", *_shown(F.col("v")))


def run_all_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hazards of all families over all documents, by language and family."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return admission.hazards(docs, "text", wordlists=written_lists(spark, sf_dir), positions=False).groupBy("lang", "family", "tag").agg(F.count(F.lit(1)).alias("n"))


def hazard_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return admission.hazard_rollup(docs, "text", wordlists=written_lists(spark, sf_dir))


def admissible_by_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = admission.run_all(read(spark, sf_dir, "documents").select("doc_id", "text"), "text", wordlists=written_lists(spark, sf_dir), positions=False)
    levels = [admission.admissible(F.col("verdicts"), level).alias(level) for level in admission.REJECTION]
    state = admission.composite(F.col("verdicts"))
    return docs.select("doc_id", *levels, state["kind"].alias("kind"), state["n_sites"].alias("n_sites"), state["severity"].alias("severity"))


def imitated_in_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's source, its c in Cyrillic in every other row, against the sources as protected names."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 1, F.translate("source", "c", "с")).otherwise(F.col("source")).alias("name"))
    names = read(spark, sf_dir, "documents").select(F.col("source").alias("name")).where("name is not null").distinct().select(F.lit(0).alias("rank"), "name")
    found = detectors.with_target(docs, "name", names=names)
    return found.select("doc_id", F.col("target"), detectors.homoglyph_confusable(F.col("name"), F.col("target"))["tag"].alias("tag"))


IMITATED_SQL = """
SELECT doc_id, CASE WHEN doc_id % 2 = 1 AND contains(source, 'c') THEN source END AS target,
       CASE WHEN doc_id % 2 = 1 AND contains(source, 'c') THEN 'TargetMatch' END AS tag FROM documents
"""
#: Words of a list, as many as mnemonic lists have.
LIST_WORDS = 2048
_LETTERS = "[^a-zß-öø-ÿ]+"
#: Shares of a vocabulary that are ranked apart first.
SHARES = 64


def language_lists(docs: DataFrame) -> DataFrame:
    """``(lang, word)``: the most frequent words of each language's texts, ties by word."""
    words = docs.where("lang is not null").select("lang", F.explode(F.split("t", " ")).alias("word")).where("word != ''")
    counts = words.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
    # the most frequent words of all are among those of each share, so no task sorts a language's whole vocabulary
    place = lambda *share: F.row_number().over(Window.partitionBy("lang", *share).orderBy(F.desc("n"), F.encode("word", "UTF-8")))
    shares = counts.withColumn("share", F.pmod(F.xxhash64("word"), F.lit(SHARES)))
    leading = shares.withColumn("rank", place("share")).where(F.col("rank") <= LIST_WORDS)
    return leading.withColumn("rank", place()).where(F.col("rank") <= LIST_WORDS).select("lang", "word")


def written_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lists of all documents' languages, written once."""
    t = F.trim(F.regexp_replace(F.lower("text"), _LETTERS, " "))
    return written(language_lists(read(spark, sf_dir, "documents").select("lang", t.alias("t"))), "word-lists")


def mnemonics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's words, and every other one's first word alone, against lists of each language's frequent words."""
    t = F.trim(F.regexp_replace(F.lower("text"), _LETTERS, " "))
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang", t.alias("t"))
    lists = written(language_lists(docs), "word-lists")
    docs = docs.withColumn("t", F.when(F.col("doc_id") % 2 == 1, F.substring_index("t", " ", 1)).otherwise(F.col("t")))
    found = detectors.with_mnemonic(docs, "t", lists)
    return found.select("doc_id", detectors.bip39_canonical(F.col("t"), F.col("mnemonic")).alias("v")).select("doc_id", *_shown(F.col("v")))


MNEMONIC_SQL = f"""
WITH whole AS (SELECT doc_id, lang, trim(regexp_replace(lower(text), '{_LETTERS}', ' ', 'g')) AS t FROM documents),
counts AS (SELECT lang, w, count(*) AS n FROM (SELECT lang, unnest(string_split(t, ' ')) AS w FROM whole WHERE lang IS NOT NULL) WHERE w <> '' GROUP BY ALL),
lists AS (SELECT lang, w FROM counts QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, w) <= {LIST_WORDS}),
d AS (SELECT doc_id, CASE WHEN doc_id % 2 = 1 THEN split_part(t, ' ', 1) ELSE t END AS t FROM whole),
parts AS (SELECT doc_id, unnest(string_split(t, ' ')) AS w, generate_subscripts(string_split(t, ' '), 1) - 1 AS pos FROM d WHERE t <> ''),
unknown AS (SELECT doc_id, min(pos) AS pos FROM parts WHERE w NOT IN (SELECT w FROM lists) GROUP BY doc_id),
size AS (SELECT doc_id, count(*) AS n FROM parts GROUP BY doc_id),
covered AS (SELECT DISTINCT doc_id FROM (SELECT doc_id, lang, count(*) AS n FROM parts JOIN lists USING (w) GROUP BY ALL) JOIN size USING (doc_id, n)),
state AS (SELECT d.doc_id, regexp_extract(t, '[à-åç-ïñ-öù-ýÿ]') AS mark, t, u.pos, s.n IS NULL OR c.doc_id IS NOT NULL AS ok
          FROM d LEFT JOIN unknown u USING (doc_id) LEFT JOIN size s USING (doc_id) LEFT JOIN covered c USING (doc_id))
SELECT doc_id, CASE WHEN mark <> '' THEN 'NonNFKD' WHEN pos IS NOT NULL THEN 'WordlistMismatch' WHEN NOT ok THEN 'LanguageAmbiguous' END AS tag,
       CASE WHEN mark <> '' THEN (instr(t, mark) - 1)::VARCHAR WHEN pos IS NOT NULL THEN pos::VARCHAR ELSE '' END AS positions FROM state
"""


#: The characters below U+0100 that have a confusable prototype.
_LOOKALIKES = '["%01I`m|\u00a0\u00a2\u00a5\u00af\u00b4\u00b5\u00b8\u00c6\u00d0\u00d7\u00d8\u00e6\u00f0\u00f8]'
_BIDI_TRIGGERS = ["\u202e", "\u2066", ""]
CONFUSABLE_BIDI_SQL = f"""
WITH d AS (SELECT doc_id, doc_id % 3 AS turn, {K} AS k, {injected_sql(_BIDI_TRIGGERS)} AS t FROM documents),
f AS (SELECT doc_id, turn, k, CASE WHEN turn < 2 AND regexp_matches(t, '{_LOOKALIKES}') THEN length(regexp_extract(t, '^[^{_LOOKALIKES[1:]}*')) END AS place FROM d)
SELECT doc_id, CASE WHEN place IS NOT NULL THEN CASE turn WHEN 0 THEN 'ConfusableInOverride' ELSE 'ConfusableInIsolate' END END AS tag,
       CASE WHEN place IS NULL THEN '' ELSE place || ',' || k END AS positions FROM f
"""
#: Line ends are line feeds alone here, and the texts are in NFC, so the last rule breaks nowhere.
SIGNING_SQL = r"""
WITH d AS (SELECT doc_id, text AS t, doc_id % 7 AS rule, length(regexp_extract(text, '[ \t\n\r]+$')) AS tail FROM documents),
p AS (SELECT *, CASE rule WHEN 0 THEN CASE WHEN regexp_matches(t, '[ \t]+(\r?\n|\z)') THEN length(regexp_extract(t, '(?s)^(.*?)[ \t]+(?:\r?\n|\z)', 1)) END
  WHEN 1 THEN nullif(strpos(t, chr(10)), 0) - 1 WHEN 2 THEN nullif(strpos(t, chr(10)), 0) - 1
  WHEN 3 THEN CASE WHEN regexp_matches(t, '[\x00-\x1F]') THEN length(regexp_extract(t, '^[^\x00-\x1F]*')) END
  WHEN 4 THEN CASE WHEN regexp_matches(t, '[^A-Za-z0-9_-]') THEN length(regexp_extract(t, '^[A-Za-z0-9_-]*')) END
  WHEN 5 THEN CASE WHEN regexp_matches(t, '[ \t]{2}') THEN length(regexp_extract(t, '(?s)^(.*?)[ \t]{2}', 1)) + 1 END END AS place FROM d)
SELECT doc_id, CASE WHEN place IS NOT NULL THEN 'SignedMessageRule' WHEN tail > 0 THEN 'TrailingWhitespace' END AS tag,
       CASE WHEN place IS NOT NULL THEN place::VARCHAR WHEN tail > 0 THEN (length(t) - tail)::VARCHAR ELSE '' END AS positions FROM p
"""

#: The words of a text, and the frequent words of each language in SQL.
_SPACED = "list_filter(string_split(lower(text), ' '), lambda x: x <> '')"
_LISTS = f"""whole AS (SELECT lang, trim(regexp_replace(lower(text), '{_LETTERS}', ' ', 'g')) AS t FROM documents),
counts AS (SELECT lang, w, count(*) AS n FROM (SELECT lang, unnest(string_split(t, ' ')) AS w FROM whole WHERE lang IS NOT NULL) WHERE w <> '' GROUP BY ALL),
lists AS (SELECT lang, w FROM counts QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, w) <= {LIST_WORDS})"""
#: Hazards of texts in Latin letters without controls, selectors or emoji: what each family says of them; the others say nothing.
_PLAIN = {
    ("covert", "surrogateReassembly"): _SURROGATE_TAG, ("identity", "mixedScriptAdmissibility"): _MIXED_TAG, ("display", "filenameDisguise"): _FILENAME_TAG,
    ("form", "localeCaseInversion"): _LOCALE_TAG, ("form", "caseExpansionMismatch"): _EXPANSION_TAG,
    ("crypto", "bip39Canonical"): r"CASE WHEN regexp_matches(text, '[ \x{3000}]$') THEN 'TrailingWhitespace' WHEN regexp_matches(text, '[A-Z]') THEN 'MixedCase' WHEN regexp_matches(text, '^[ \x{3000}]|[ \x{3000}]{2}') THEN 'WhitespaceAnomaly' "
    + rf"WHEN regexp_matches(text, '{_APART}|{_COMPAT}') THEN 'NonNFKD' WHEN NOT list_has_all((SELECT coalesce(list(w), []) FROM lists), {_SPACED}) THEN 'WordlistMismatch' "
    + f"WHEN len({_SPACED}) > 0 AND len(list_filter((SELECT coalesce(list(ws), []) FROM (SELECT list(w) AS ws FROM lists GROUP BY lang)), lambda ws: list_has_all(ws, {_SPACED}))) = 0 THEN 'LanguageAmbiguous' END",
    ("crypto", "hashInputStability"): r"CASE WHEN regexp_matches(text, '[ \t\n\r]$') THEN 'TrailingWhitespace' END",
}
_HAZARDS = f"{_LISTS}, h AS (" + " UNION ALL ".join(f"SELECT doc_id, lang, '{layer}' AS layer, '{family}' AS family, {tag} AS tag FROM documents" for (layer, family), tag in _PLAIN.items()) + "), f AS (SELECT * FROM h WHERE tag IS NOT NULL)"
RUN_ALL_SQL = f"WITH {_HAZARDS} SELECT lang, family, tag, count(*) AS n FROM f GROUP BY ALL"
ROLLUP_SQL = f"WITH {_HAZARDS} SELECT layer, family, count(*) AS n FROM f GROUP BY ROLLUP (layer, family)"
ADMISSIBLE_SQL = f"""
WITH {_HAZARDS}, n AS (
  SELECT doc_id, count(*) AS n, count(*) FILTER (layer <> 'crypto') AS plain, count(*) FILTER (family = 'surrogateReassembly') AS least FROM f GROUP BY doc_id
)
SELECT doc_id, coalesce(plain, 0) = 0 AS restrictive, coalesce(plain, 0) = 0 AS moderate, coalesce(least, 0) = 0 AS minimal,
       CASE coalesce(n, 0) WHEN 0 THEN 'clear' WHEN 1 THEN 'hazard' ELSE 'compound' END AS kind, coalesce(n, 0)::INT AS n_sites,
       CASE WHEN coalesce(n, 0) = 0 THEN 'informational' ELSE 'moderate' END AS severity
FROM documents LEFT JOIN n USING (doc_id)
"""


def all_entries() -> dict[str, tuple[Query, str | None]]:
    none = ("", None, "")
    rtl = f"CASE WHEN {_STRONG} THEN 'MixedOverflow' ELSE 'FieldTakeover' END"
    rtl_one = f"CASE WHEN {_STRONG} THEN 'StrongRTLInLTR' ELSE 'FieldTakeover' END"
    return {
        "tag_block": by_trigger("tagBlockPayload", [("\U000e0041\U000e0042", "MixedBlock", _at(0, 1)), none]),
        "variation_selectors": by_trigger(
            "variationSelectorPayload",
            [("\U000e0101" * 4, "RepeatedBase", _at(0, 1, 2, 3)), ("\U000e0101\U000e0102", "DirectPayload", _at(0, 1)), ("\U000e0101", "IllegalTarget", _at(0)), none],
        ),
        "zero_width": by_trigger(
            "zeroWidthPayload",
            [
                ("​" * 3, "BinaryPayload", _at(0, 1, 2)), (" " * 2, "AIWatermarkNNBSP", _at(0, 1)), ("⁠", "WordJoinerInjection", _at(0)),
                ("￹", "AnnotationMisuse", _at(0)), ("‌", "BareZeroWidth", _at(0)), none,
            ],
        ),
        "surrogate_reassembly": _surrogate(),
        "bidi_balance": by_trigger(
            "bidiControlBalance",
            [("‮", "UnbalancedEmbedding", _at(0)), ("⁦", "UnbalancedIsolate", _at(0)), ("‬", "OrphanPop", _at(0)), ("‮‬", None, ""), none],
        ),
        "homoglyphs": by_trigger("homoglyphConfusable", [("\U0001d400", "MathAlpha", _at(0)), ("Ａ", "WidthClass", _at(0)), ("é", "DecompositionSwap", _at(0)), none]),
        "mixed_scripts": by_text(
            "mixedScriptAdmissibility",
            _MIXED_TAG,
            _every(r"[^''\-.0-9:A-Z_a-zÀ-ÖØ-öø-ÿ]"),
        ),
        "emoji_zwj": by_trigger("emojiZwjIntegrity", [("‍‍", "DoubleZWJ", _at(0)), ("‍", "NonEmojiInjection", _at(0)), none]),
        # in an empty text the trigger is at the start, and the SQL counts it there
        "skin_tones": by_trigger(
            "skinToneVariationForgery",
            [("\U0001f3fb\U0001f3fb", "StackedSkinTones", _at(0, 1)), ("\U0001f3fb", "InvalidSkinToneTarget", _at(0)), none],
            lambda s: detectors.skin_tone_forgery(s, at_start=True),
        ),
        "source_display": by_trigger(
            "sourceDisplayDivergence",
            [("\U000e0041", "TagBlock", "''"), ("\U000e0101", "VariationSelector", "''"), ("​", "ZeroWidth", "''"), ("‮", "BidiControl", "''"), ("‮​", "Compound", "''")],
        ),
        "filename_disguise": by_text(
            "filenameDisguise",
            _FILENAME_TAG,
            f"CASE WHEN length(text) - length(replace(text, '.', '')) >= 3 THEN {_every('[.]')} ELSE '' END",
        ),
        "rtl_injection": by_trigger("rtlInjection", [("‮", "RloInLTRField", _at(0)), ("א" * 5, rtl, _at(0)), ("א", rtl_one, _at(0)), none]),
        "renderer": by_trigger(
            "rendererDivergence",
            [("́" * 4, "CombiningStackOverflow", _at(-1)), ("︀", "VariationSelectorVariance", _at(0)), ("‍", "UnregisteredZwjVariance", _at(0)), ("Ａ", "FullwidthVariance", _at(0)), none],
        ),
        "normalization_bomb": by_trigger("normalizationBomb", [("ﷺ", "SingleCpBlowup", _at(0)), none]),
        "stream_safe_violation": by_trigger("streamSafeViolation", [("́" * 31, "StreamSafeOverrun", _at(0)), ("́" * 30, None, ""), none]),
        "locale_case": by_text(
            "localeCaseInversion",
            _LOCALE_TAG,
            "CASE WHEN contains(text, 'I') THEN (instr(text, 'I') - 1)::VARCHAR WHEN regexp_matches(text, '[ÌÍ]') THEN (instr(text, regexp_extract(text, '[ÌÍ]')) - 1)::VARCHAR ELSE '' END",
        ),
        "case_expansion": by_text(
            "caseExpansionMismatch",
            _EXPANSION_TAG,
            "CASE WHEN contains(text, 'ß') THEN (instr(text, 'ß') - 1)::VARCHAR ELSE '' END",
        ),
        "width_class": by_trigger("widthClassConfusion", [("Ａ", "FullwidthFold", _at(0)), ("ｱ", "HalfwidthFold", _at(0)), none]),
        "nfc_witness": by_trigger("nfcIdempotenceWitness", [("é", "NonNfcForm", _at(0)), ("Ａ", "NonNfkcCompatForm", _at(0)), none]),
        "identifier_form_drift": by_trigger("identifierFormDrift", [("Ａ", "IdentifierStatusShift", _at(0)), none]),
        "covert_display": by_trigger(
            "covertDisplayCompound", [("‮\U000e0101", "BidiPlusUnregisteredVs", _at(0, 1)), ("‮\U000e0041", "BidiPlusTagBlock", _at(0, 1)), ("‮", None, ""), none]
        ),
        "confusable_bidi": (over_documents(detectors.confusable_bidi_compound, _BIDI_TRIGGERS), CONFUSABLE_BIDI_SQL),
        "admissibility_drift": by_text("admissibilityFormDrift", "CAST(NULL AS VARCHAR)", "''"),
        "bip39": (mnemonics, MNEMONIC_SQL),
        "hash_stability": by_trigger("hashInputStability", [("é", "NormalizationDrift", _at(0)), none]),
        "signing_rules": (_crypto_context, SIGNING_SQL),
        "watermarks": by_trigger(
            "aiWatermarkDetectability",
            [(" " * 3, "Adversarial", _at(0, 1, 2)), ("​" * 3, "Gpt5ZwspModulo", _at(0, 1, 2)), (" ", "NnbspBoundary", _at(0)), none],
        ),
        "imitated_names": (imitated_in_documents, IMITATED_SQL),
        "run_all_counts": (run_all_counts, RUN_ALL_SQL),
        "hazard_rollup": (hazard_rollup, ROLLUP_SQL),
        "admissible_by_level": (admissible_by_level, ADMISSIBLE_SQL),
    }
