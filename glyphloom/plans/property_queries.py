"""Queries of character properties, encodings and forms over all documents, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codec, domains, identifiers, layout, normalize, segments
from ..operators import ranges
from ..tables import icu
from .text_queries import AT, Query, injected, injected_sql, over_documents, read

#: Position of what is put in, in SQL.
K = f"least({AT}, length(text))"


def by_property(name: str, triggers: list[str]) -> Query:
    """Characters of all documents by a property's value, looked up once for each character."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = read(spark, sf_dir, "documents").select(F.lit(0).alias("all"), injected(F.col("text"), F.col("doc_id"), triggers).alias("t"))
        counts = ranges.codepoint_counts(docs, "all", "t")
        named = counts.withColumn("value", icu.value_name(name, icu.property_value(F.col("cp"), name)))
        return named.groupBy("value").agg(F.sum("n").alias("n"))

    return run


def by_class_sql(triggers: list[str], classes: dict[str, str]) -> str:
    """Counts of the characters of each class, given as a body of a class in brackets; what is in none is not there."""
    rows = ", ".join("('" + name + "', '[" + body.replace("'", "''") + "]')" for name, body in classes.items())
    return f"""
    WITH d AS (SELECT {injected_sql(triggers)} AS t FROM documents), c(value, re) AS (VALUES {rows})
    SELECT value, sum(len(regexp_extract_all(t, re)))::BIGINT AS n FROM d, c GROUP BY value HAVING sum(len(regexp_extract_all(t, re))) > 0
    """


# Classes of properties below U+0100 and of the characters that are put in.
_BIDI = ["א", "ب", "١", "̈", "‮", "⁧", ""]
_BIDI_CLASSES = {
    "L": r"A-Za-z\xAA\xB5\xBA\xC0-\xD6\xD8-\xF6\xF8-\xFF", "EN": r"0-9\xB2\xB3\xB9", "ES": r"+\x2D", "ET": r"#$%\xA2-\xA5\xB0\xB1", "CS": r",./:\xA0", "B": r"\x0A\x0D\x1C-\x1E\x85",
    "S": r"\x09\x0B\x1F", "WS": r"\x0C\x20", "ON": r"!\x22&'()*;-@\x5B-`{-~\xA1\xA6-\xA9\xAB\xAC\xAE\xAF\xB4\xB6-\xB8\xBB-\xBF\xD7\xF7", "BN": r"\x00-\x08\x0E-\x1B\x7F-\x84\x86-\x9F\xAD",
    "R": r"\x{5D0}", "AL": r"\x{628}", "AN": r"\x{661}", "NSM": r"\x{308}", "RLO": r"\x{202E}", "RLI": r"\x{2067}",
}
_WIDTHS = ["漢", "Ａ", "ｱ", "§", ""]
_WIDTH_CLASSES = {
    "Na": r"\x20-\x7E\xA2\xA3\xA5\xA6\xAC\xAF", "A": r"\xA1\xA4\xA7\xA8\xAA\xAD\xAE\xB0-\xB4\xB6-\xBA\xBC-\xBF\xC6\xD0\xD7\xD8\xDE-\xE1\xE6\xE8-\xEA\xEC\xED\xF0\xF2\xF3\xF7-\xFA\xFC\xFE",
    "N": r"\x00-\x1F\x7F-\xA0\xA9\xAB\xB5\xBB\xC0-\xC5\xC7-\xCF\xD1-\xD6\xD9-\xDD\xE2-\xE5\xE7\xEB\xEE\xEF\xF1\xF4-\xF6\xFB\xFD\xFF", "W": r"\x{6F22}", "F": r"\x{FF21}", "H": r"\x{FF71}",
}
_JOINS = ["ب", "ا", "ـ", "ً", "ꡲ", ""]
_JOIN_CLASSES = {"D": r"\x{628}", "R": r"\x{627}", "C": r"\x{640}", "T": r"\x{64B}\xAD", "L": r"\x{A872}", "U": r"\x00-\xAC\xAE-\xFF"}
_SHAPES = ["Ａ", "²", "½", "ﬁ", "é", " ", "가", "①", ""]
_SHAPE_CLASSES = {
    "Can": r"\xC0-\xC5\xC7-\xCF\xD1-\xD6\xD9-\xDD\xE0-\xE5\xE7-\xEF\xF1-\xF6\xF9-\xFD\xFF\x{AC00}", "Wide": r"\x{FF21}", "Sup": r"\xAA\xB2\xB3\xB9\xBA", "Fra": r"\xBC-\xBE", "Com": r"\xA8\xAF\xB4\xB5\xB8\x{FB01}",
    "Nb": r"\xA0", "Enc": r"\x{2460}", "None": r"\x00-\x9F\xA1-\xA7\xA9\xAB-\xAE\xB0\xB1\xB6\xB7\xBB\xBF\xC6\xD0\xD7\xD8\xDE\xDF\xE6\xF0\xF7\xF8\xFE\x{301}",
}
_TURNED = ["漢", "©", "Ａ", "ｱ", "a", ""]


def word_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters of all documents by the letter of their word-break class."""
    docs = read(spark, sf_dir, "documents").select(segments.class_letters(F.col("text"), "WB", segments.WORD_CLASS).alias("t"))
    each = docs.select(F.explode(F.split("t", "")).alias("value")).where("value != ''")
    return each.groupBy("value").agg(F.count(F.lit(1)).alias("n"))


_WORD_CLASSES = {
    "A": r"A-Za-z\xAA\xB5\xBA\xC0-\xD6\xD8-\xF6\xF8-\xFF", "N": "0-9", "E": "_", "m": r":\xB7", "n": ",;", "q": ".", "s": "'", "d": r"\x22", "w": r"\x20", "r": r"\x0D", "l": r"\x0A", "b": r"\x0B\x0C\x85",
    "x": r"\xAD", "P": r"\xA9\xAE", ".": r"\x00-\x09\x0E-\x1F!#-&(-+\x2D/<-@\x5B-^`{-\x84\x86-\xA8\xAB\xAC\xAF-\xB4\xB6\xB8\xB9\xBB-\xBF\xD7\xF7",
}

_QUICK = ["é", "é", "Ａ", "̧́", "x̧́", ""]
#: Latin letters that come apart, or a compatibility character that does.
APART, COMPAT = r"[\xC0-\xC5\xC7-\xCF\xD1-\xD6\xD9-\xDD\xE0-\xE5\xE7-\xEF\xF1-\xF6\xF9-\xFD\xFF]", r"[\xA0\xA8\xAA\xAF\xB2-\xB5\xB8-\xBA\xBC-\xBE\x{FF21}]"


def _quick(s: Column) -> Column:
    return F.concat_ws(",", *[normalize.quick_check(s, f).cast("string") for f in ("NFC", "NFD", "NFKC", "NFKD")])


#: A mark that may join the letter before it counts as a failure of the composed forms, and marks out of order of every form.
_QUICK_SQL = f"""CASE WHEN t IS NULL THEN '' ELSE concat_ws(',', (doc_id % 6 NOT IN (0, 3, 4))::VARCHAR, (NOT regexp_matches(t, '{APART}') AND doc_id % 6 <> 3)::VARCHAR,
  (doc_id % 6 NOT IN (0, 3, 4) AND NOT regexp_matches(t, '{COMPAT}'))::VARCHAR, (NOT regexp_matches(t, '{APART}|{COMPAT}') AND doc_id % 6 <> 3)::VARCHAR) END"""

_CLASSES = ["́", "̧", "ְ", "〪", "x", "्"]
_CLASS_SUMS = (230, 202, 10, 218, 0, 9)


def _class_sum(s: Column) -> Column:
    marks = F.regexp_extract_all(s, F.lit(f"({icu.regex('[:^ccc=0:]')})"), F.lit(1))
    return F.aggregate(F.transform(marks, normalize.combining_class), F.lit(0), lambda a, c: a + c)


_SYLLABLES = ["가", "한", "힣", "一", ""]


def _jamo(s: Column) -> Column:
    """Jamo of a text's syllables, and whether they compose to the syllables again."""
    syllables = F.transform(F.regexp_extract_all(s, F.lit(r"([\x{AC00}-\x{D7A3}])"), F.lit(1)), lambda c: F.ascii(c))
    told = lambda found, parts: F.concat_ws(",", F.size(parts).cast("string"), (normalize.hangul_composed(parts) == found).cast("string"))
    return codec.let(syllables, lambda found: codec.let(F.flatten(F.transform(found, normalize.hangul_parts)), lambda parts: told(found, parts)))


_CONTROLS = ["\x07", "\x7f", "\t", "é\x01", ""]


def _control(s: Column) -> Column:
    at = codec.first_control(s)
    return F.concat_ws(":", at["offset"].cast("string"), at["byte"].cast("string"))


_CONTROL_SQL = r"""CASE WHEN t IS NULL OR NOT regexp_matches(t, '[\x00-\x08\x0B-\x1F\x7F]') THEN '' ELSE strlen(regexp_extract(t, '^[^\x00-\x08\x0B-\x1F\x7F]*')) || ':' ||
  ord(regexp_extract(t, '[\x00-\x08\x0B-\x1F\x7F]')) END"""


def _latin_hex(order: str) -> str:
    """UTF-16 or UTF-32 of texts below U+10000, little end first."""
    return f"sha256(array_to_string([format('{{:02X}}{{:02X}}{order}', ord(c) & 255, ord(c) >> 8) for c in string_split(t, '')], ''))"


def transitional_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts of all pages with a sharp s and a joiner in front, mapped as older software does."""
    pages = read(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("Faß‍"), F.array_join(domains.host_labels(F.col("url")), ".")).alias("host"))
    return pages.select("page_id", domains.to_ascii(F.col("host"), transitional=True).alias("ascii"))


HOST_SQL = r"SELECT page_id, 'fass' || lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS ascii FROM pages"


def label_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of five label rules fail, for all pages' first host labels with something put in front."""
    pages = read(spark, sf_dir, "pages").select("page_id", F.concat(_picked(F.col("page_id"), list(_LABELS)), F.get(domains.host_labels(F.col("url")), F.lit(0))).alias("label"))
    off = {"check_hyphens": False, "check_bidi": False, "check_joiners": False, "std3_rules": False}
    only = [(flag, domains.valid_label(F.col("label"), domains.Options(**{**off, flag: True}))) for flag in off]
    return pages.select("page_id", domains.valid_label(F.col("label"), domains.Options(**off)).alias("plain"), *[ok.alias(flag) for flag, ok in only])


#: What is put in front of a label, and whether it passes no rules, hyphens, direction, joiners and ASCII rules.
_LABELS = {"-": (1, 0, 1, 1, 1), "ab--": (1, 0, 1, 1, 1), "א": (1, 1, 0, 1, 1), "‍": (1, 1, 1, 0, 1), "_": (1, 1, 1, 1, 0), "́": (0, 0, 0, 0, 0), "b": (1, 1, 1, 1, 1)}
LABEL_SQL = f"""
SELECT page_id, v.* EXCLUDE (turn) FROM pages JOIN (VALUES {", ".join(f"({i}, {', '.join(str(bool(x)).lower() for x in v)})" for i, v in enumerate(_LABELS.values()))})
AS v(turn, plain, check_hyphens, check_bidi, check_joiners, std3_rules) ON page_id % {len(_LABELS)} = turn
"""


def _picked(key: Column, choices: list[str]) -> Column:
    return F.element_at(F.array(*map(F.lit, choices)), (F.pmod(key, F.lit(len(choices))) + 1).cast("int"))


def prepared_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' names as user names, with letters and signs in front: prepared, with their case, and as opaque strings."""
    names = read(spark, sf_dir, "customer").select("c_custkey", F.concat(_picked(F.col("c_custkey"), list(_NAMES)), F.translate("c_name", "#", "_")).alias("n"))
    s = F.col("n")
    return names.select("c_custkey", identifiers.precis_username(s).alias("folded"), identifiers.precis_username(s, preserve_case=True).alias("kept"), identifiers.precis_opaque(s).alias("opaque"))


#: What is put in front of a name, and it as user name, with its case and as an opaque string, null where it is barred.
_NAMES = {"Ａ": ("a", "A", "Ａ"), "ｱ": ("ア", "ア", "ｱ"), "é": ("é", "é", "é"), " ": (None, None, " "), "　": (None, None, " "), "ﬁ": ("fi", None, "ﬁ"), "ß": ("ss", "ß", "ß"), "\x07": (None, None, None)}
_name_sql = lambda i: "CASE c_custkey % 8 " + " ".join(f"WHEN {k} THEN " + ("NULL" if v[i] is None else " || ".join(f"chr({ord(c)})" for c in v[i])) for k, v in enumerate(_NAMES.values())) + " END"
NAME_SQL = f"""
SELECT c_custkey, {_name_sql(0)} || lower(translate(c_name, '#', '_')) AS folded, {_name_sql(1)} || translate(c_name, '#', '_') AS kept, {_name_sql(2)} || translate(c_name, '#', '_') AS opaque FROM customer
"""


def precis_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters of all documents by their category in identifiers' preparation, looked up once each."""
    docs = read(spark, sf_dir, "documents").select(F.lit(0).alias("all"), injected(F.col("text"), F.col("doc_id"), _CATEGORY_MARKS).alias("t"))
    counts = ranges.codepoint_counts(docs, "all", "t")
    return counts.groupBy(identifiers.precis_category(F.col("cp")).alias("value")).agg(F.sum("n").alias("n"))


_CATEGORY_MARKS = ["‍", "͸", " ", ""]
_PRECIS_CLASSES = {"ContextJ": r"\x{200D}", "Unassigned": r"\x{378}", "IdentifierClass": r"0-9A-Z_a-z\xB7\xC0-\xD6\xD8-\xF6\xF8-\xFF'\x2D.:", "Disallowed": r"\x00-\x26\x28-\x2C/;-@\x5B-^`{-\xB6\xB8-\xBF\xD7\xF7\x{2028}"}


def all_entries() -> dict[str, tuple[Query, str | None]]:
    d = over_documents
    return {
        "bidi_classes": (by_property("Bidi_Class", _BIDI), by_class_sql(_BIDI, _BIDI_CLASSES)),
        "width_classes": (by_property("East_Asian_Width", _WIDTHS), by_class_sql(_WIDTHS, _WIDTH_CLASSES)),
        "joining_types": (by_property("Joining_Type", _JOINS), by_class_sql(_JOINS, _JOIN_CLASSES)),
        "decomposition_types": (by_property("Decomposition_Type", _SHAPES), by_class_sql(_SHAPES, _SHAPE_CLASSES)),
        "word_classes": (word_classes, by_class_sql([""], _WORD_CLASSES)),
        "quick_checks": d(_quick, _QUICK_SQL, _QUICK),
        "combining_classes": d(_class_sum, f"CASE WHEN t IS NOT NULL THEN list_extract({list(_CLASS_SUMS)}, (doc_id % 6 + 1)::INT) END", _CLASSES),
        "hangul": d(_jamo, "CASE WHEN t IS NULL THEN NULL ELSE list_extract(['2,true', '3,true', '3,true', '0,true', '0,true'], (doc_id % 5 + 1)::INT) END", _SYLLABLES),
        "first_control": d(_control, _CONTROL_SQL, _CONTROLS),
        "utf16_little": d(lambda s: F.sha2(F.hex(codec.utf16(s, little=True)), 256), _latin_hex("")),
        "utf32_little": d(lambda s: F.sha2(F.hex(codec.utf32(codec.decode_utf32(codec.utf32(s, little=True), little=True), little=True)), 256), _latin_hex("0000")),
        "upright": d(lambda s: F.size(F.filter(layout.orientation(s), lambda o: o == "Upright")), r"CASE WHEN t IS NOT NULL THEN len(regexp_extract_all(t, '[\xA7\xA9\xAE\xB1\xBC-\xBE\xD7\xF7\x{6F22}\x{FF21}]'))::INT END", _TURNED),
        "transitional_hosts": (transitional_hosts, HOST_SQL),
        "label_options": (label_options, LABEL_SQL),
        "prepared_names": (prepared_names, NAME_SQL),
        "precis_categories": (precis_categories, by_class_sql(_CATEGORY_MARKS, _PRECIS_CLASSES)),
        "width_mapped": d(lambda s: F.sha2(identifiers.spaces_to_ascii(identifiers.width_map(s)), 256), f"sha256(replace(replace(replace(t, chr({0xFF21}), 'A'), chr({0xFF71}), chr({0x30A2})), chr({0x3000}), ' '))", ["Ａ", "ｱ", "　", ""]),
    }
