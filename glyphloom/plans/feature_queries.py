"""Queries of streams, joins and orders over whole tables, each beside its SQL."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import casing, codec, confusables, domains, identifiers, layout, strict
from ..intermediate import shared_folder
from ..operators import chains, emoji, lookalikes, metrics, ordering, property_names, ranges
from ..streaming import utf8_chunks
from ..tables import curated, icu
from .text_queries import Query, broken_utf8, injected, injected_sql, over_documents, read

ROCKS = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _pieces(spark: SparkSession, sf_dir: str, words: int) -> DataFrame:
    """The bytes of all documents, broken as in ``broken_utf8``, cut into pieces of a size that each document has for itself."""
    size = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 997 + words).cast("int")
    rows = read(spark, sf_dir, "documents").select("doc_id", F.coalesce(broken_utf8(), F.lit(b"")).alias("data"))
    return rows.select("doc_id", F.inline(utf8_chunks.chunks(F.col("data"), size)))


def _flat(found: DataFrame) -> DataFrame:
    v = F.col("verdict")
    where = F.concat_ws(":", v["reason"]["kind"], v["reason"]["offset"].cast("string"), v["reason"]["byte"].cast("string"))
    return found.select("doc_id", v["status"].alias("status"), where.alias("reason"))


def utf8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of all documents' bytes from pieces cut anywhere."""
    return _flat(utf8_chunks.verdicts(_pieces(spark, sf_dir, 1), "doc_id"))


def utf8_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a stream of the pieces, with each document's unfinished sequence as keyed state."""
    folder = f"{shared_folder(spark)}/utf8-{uuid4().hex}"
    _pieces(spark, sf_dir, 4000).write.parquet(f"{folder}/in")
    before = spark.conf.get(ROCKS[0], None)
    spark.conf.set(*ROCKS)
    try:
        stream = spark.readStream.schema("doc_id long, seq int, data binary, last boolean").parquet(f"{folder}/in")
        found = utf8_chunks.stream_verdicts(stream, "doc_id")
        put = lambda batch, number: batch.withColumn("batch", F.lit(number)).write.parquet(f"{folder}/out/batch={number}")
        sink = found.writeStream.outputMode("update").foreachBatch(lambda b, n: put(b.drop("batch"), n)).option("checkpointLocation", f"{folder}/state")
        sink.trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset(ROCKS[0]) if before is None else spark.conf.set(ROCKS[0], before)
    rows = spark.read.parquet(f"{folder}/out")
    # a document's last row stands
    return _flat(rows.groupBy("doc_id").agg(F.max_by("verdict", "batch").alias("verdict")))


UTF8_VERDICT_SQL = """
WITH d AS (SELECT doc_id, doc_id % 4 AS k, coalesce(text, '') AS t, text IS NULL AS none FROM documents)
SELECT doc_id, CASE WHEN k = 0 OR none THEN 'ok' ELSE 'rejected' END AS status,
  CASE WHEN k = 0 OR none THEN '' WHEN k = 1 THEN 'utf8InvalidStartByte:0:128'
       WHEN k = 2 AND t = '' THEN 'utf8TruncatedSequence:1'
       WHEN k = 2 THEN 'utf8InvalidContinuation:' || (strlen(substr(t, 1, length(t) // 2)) + 1)::VARCHAR || ':' || ('0x' || substr(hex(encode(substr(t, length(t) // 2 + 1, 1))), 1, 2))::INT::VARCHAR
       ELSE 'utf8TruncatedSequence:' || (strlen(t) + 2)::VARCHAR END AS reason
FROM d
"""

#: Texts of several scripts, put into documents in turn.
_SCRIPTS = ["Жук и жaба", "αβγ ω", "漢字かなカナ", "שלום عالم", "한국어 ไทย", "☃ 1٣", ""]
_SCRIPT_NAMES = {
    "Latn": "Latin", "Cyrl": "Cyrillic", "Grek": "Greek", "Hani": "Han", "Hira": "Hiragana", "Kana": "Katakana", "Hebr": "Hebrew", "Arab": "Arabic", "Hang": "Hangul",
    "Thai": "Thai", "Zinh": "Inherited", "Zyyy": "Common",
}


def script_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code points of every document by script, by a range join with the script table."""
    docs = read(spark, sf_dir, "documents").select("doc_id", injected(F.col("text"), F.col("doc_id"), _SCRIPTS).alias("t"))
    return ranges.property_profile(docs, "doc_id", "t", ranges.script_ranges(spark), "Zzzz").withColumnRenamed("value", "script")


SCRIPT_SQL = f"""
WITH d AS (SELECT doc_id, {injected_sql(_SCRIPTS)} AS t FROM documents), s(script, re) AS (VALUES {", ".join(f"('{a}', '\\p{{{b}}}')" for a, b in _SCRIPT_NAMES.items())})
SELECT doc_id, script, len(regexp_extract_all(t, re))::BIGINT AS n FROM d, s WHERE len(regexp_extract_all(t, re)) > 0
"""

ZWNJ, ZWJ = "‌", "‍"
#: Pieces put into host labels, and whether joiners in them are in place after and before Latin letters.
_JOINERS = {
    "क्" + ZWJ + "ष": True, "क्" + ZWNJ + "ष": True, "क" + ZWJ + "ष": False, "ن" + ZWNJ + "ا": True, "نً" + ZWNJ + "ًا": True, "ا" + ZWNJ + "ن": False, "ن" + ZWNJ: False,
    ZWNJ + "ن": False, "ن" + ZWNJ + ZWNJ + "ن": False, "": True, ZWJ: False, "ن" + ZWNJ + "ن" + ZWNJ + "ن": True,
}


def label_joiners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether joiners are in their context, for the host labels of all pages with joiners put in."""
    pages = read(spark, sf_dir, "pages").select("page_id", F.posexplode(domains.host_labels(F.col("url"))).alias("at", "label"))
    picked = F.element_at(F.array(*map(F.lit, _JOINERS)), (F.pmod(F.col("page_id") + F.col("at"), F.lit(len(_JOINERS))) + 1).cast("int"))
    label = F.concat(F.substring("label", F.lit(1), F.lit(1)), picked, F.substring("label", F.lit(2), F.length("label")))
    return pages.select("page_id", "at", domains.joiners_in_place(label).alias("in_place"))


JOINER_SQL = rf"""
SELECT page_id, (i - 1)::INT AS at, list_extract([{", ".join(str(v).lower() for v in _JOINERS.values())}], ((page_id + i - 1) % {len(_JOINERS)} + 1)::INT) AS in_place
FROM (SELECT page_id, string_split(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '.') AS ls FROM pages), unnest(range(1, len(ls) + 1)) AS u(i)
"""

#: Emoji in running text: what is put in, and the kinds of what is registered in it.
_EMOJI = {
    "😀": {"basic": 1}, "☺️": {"basic": 1}, "☺": {}, "1️⃣#️⃣": {"keycap": 2}, "1⃣": {}, "🇩🇪🇫🇷": {"flag": 2}, "🇩🇩": {}, "👋🏽x👋": {"modifier": 1, "basic": 1},
    "🏴\U000e0067\U000e0062\U000e0065\U000e006e\U000e0067\U000e007f": {"tag": 1}, "👨‍👩‍👧": {"zwj": 1}, "🚀‍🦒": {"basic": 2}, "👩🏽‍🚀👩‍🚀!👩": {"zwj": 2, "basic": 1}, "🏳️‍🌈🏳️": {"zwj": 1, "basic": 1}, "": {},
}


def rgi_emoji(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registered emoji of all documents by kind."""
    docs = read(spark, sf_dir, "documents").select("doc_id", injected(F.col("text"), F.col("doc_id"), list(_EMOJI)).alias("t"))
    return emoji.rgi_kinds(docs, "doc_id", "t")


#: Each row is a trigger's place in turn, a kind and its count; the documents themselves hold none of the first kinds' characters.
EMOJI_SQL = f"""
SELECT doc_id, kind, n::BIGINT AS n FROM documents
JOIN (VALUES {", ".join(f"({i}, '{k}', {n})" for i, kinds in enumerate(_EMOJI.values()) for k, n in kinds.items())}) AS e(turn, kind, n) ON doc_id % {len(_EMOJI)} = turn
WHERE text IS NOT NULL
"""

_WORD = "([A-Za-zÀ-ÿ]+)"


def words_out_of_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents whose neighbour before them without regard to case has larger code points."""
    words = read(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(_WORD), F.lit(1))).alias("word")).distinct()
    keyed = words.withColumn("fold", F.lower("word"))
    found = ordering.out_of_order(keyed, ["fold", "word"], ["word"], F.col("before.word") <= F.col("word"))
    return found.select("word", F.col("before.word").alias("before"))


ORDER_SQL = f"""
WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(text, '{_WORD}')) AS word FROM documents),
n AS (SELECT word, lag(word) OVER (ORDER BY lower(word), word) AS before FROM w)
SELECT word, before FROM n WHERE before > word
"""


def confusable_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters of all documents' letters and digits at the fixed point of case folding and confusable prototypes: sizes and the deepest chain."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", "[^A-Za-z0-9]", "").alias("t"))
    counts = ranges.codepoint_counts(docs, "doc_id", "t").withColumn("source", F.expr("decode(unhex(lpad(hex(cp), 8, '0')), 'UTF-32')"))
    table = chains.resolve(confusables.step_table(spark)).withColumnRenamed("source", "c")
    mapped = counts.join(table, F.col("source") == F.col("c"), "left")
    return mapped.groupBy("doc_id").agg(
        F.sum(F.col("n") * F.coalesce("expansion", F.lit(1))).alias("size"), F.max(F.coalesce("depth", F.lit(0))).alias("depth"), F.max(F.coalesce("expansion", F.lit(1))).alias("widest")
    )


CHAIN_SQL = """
WITH d AS (SELECT doc_id, regexp_replace(text, '[^A-Za-z0-9]', '', 'g') AS t FROM documents)
SELECT doc_id, (length(t) + len(regexp_extract_all(t, '[mM]')))::BIGINT AS size, CASE WHEN regexp_matches(t, 'M') THEN 2 WHEN regexp_matches(t, '[A-Z01m]') THEN 1 ELSE 0 END AS depth,
       CASE WHEN regexp_matches(t, '[mM]') THEN 2 ELSE 1 END AS widest
FROM d WHERE t <> ''
"""


#: Spellings of property names and what they name, put into documents as words; the last ones name none.
_PROPERTY_WORDS = {"Line_Break": "lb", "line-break": "lb", "GRAPHEMEclusterBREAK": "GCB", "sc": "sc", "Script": "sc", "white_space": "WSpace", "NFC_QC": "NFC_QC", "No_Such_Name": None, "scripts": None}


def property_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents that name a Unicode property, loosely spelt, by property."""
    docs = read(spark, sf_dir, "documents").select(injected(F.col("text"), F.col("doc_id"), [f" \u00a7{w}\u00a7 " for w in _PROPERTY_WORDS]).alias("t"))
    words = docs.select(F.explode(F.regexp_extract_all("t", F.lit("\u00a7([A-Za-z_-]+)\u00a7"), F.lit(1))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    found = property_names.resolved(words, "word", icu.property_aliases(spark))
    return found.groupBy("property").agg(F.sum("n").alias("n"))


PROPERTY_WORD_SQL = f"""
SELECT property, count(*) AS n FROM documents JOIN (VALUES {", ".join(f"({i}, {'NULL' if p is None else repr(p)})" for i, p in enumerate(_PROPERTY_WORDS.values()))}) AS v(turn, property)
ON doc_id % {len(_PROPERTY_WORDS)} = turn WHERE text IS NOT NULL GROUP BY property
"""

#: Numerals and their values, put into documents.
_NUMERALS = {"\u4e00\u4e8c\u5341": 13, "\u767e": 100, "\u58f9": 1, "\u00bd": 0.5, "\u2167": 8, "\u0663": 3, "x": 0}


def numerals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many numerals beyond ASCII each document has, and the sum of their values."""
    docs = read(spark, sf_dir, "documents").select("doc_id", injected(F.col("text"), F.col("doc_id"), list(_NUMERALS)).alias("t"))
    counts = ranges.codepoint_counts(docs.withColumn("t", F.regexp_replace("t", r"[\x00-\x{B1}\x{B4}-\x{B8}\x{BA}\x{BB}\x{BF}-\x{FF}]", "")), "doc_id", "t")
    # values are looked up once for each character of the whole table
    values = counts.select("cp").distinct().withColumn("v", icu.numeric_value(F.col("cp"))).where("v is not null")
    return counts.join(values, "cp").groupBy("doc_id").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("v")).alias("total"))


NUMERAL_SQL = f"""
SELECT doc_id, n::BIGINT AS n, total::DOUBLE AS total FROM documents JOIN (VALUES {", ".join(f"({i}, {len(t)}, {v})" for i, (t, v) in enumerate(_NUMERALS.items()) if v)}) AS v(turn, n, total)
ON doc_id % {len(_NUMERALS)} = turn WHERE text IS NOT NULL
"""

#: Texts for case mapping by language: what is put in, and it in lower, title and upper case.
_TURKISH = {"I\u0307": ("i", "I\u0307", "I\u0307"), "I\u0301\u0307": ("i\u0301\u0307", "I\u0301\u0307", "I\u0301\u0307"), "i": ("i", "\u0130", "\u0130"), "\u0130": ("i", "\u0130", "\u0130"), "I": ("\u0131", "I", "I"), "I\u0323\u0307": ("i\u0323", "I\u0323\u0307", "I\u0323\u0307")}
_LITHUANIAN = {"I\u0301": ("i\u0307\u0301", "I\u0301", "I\u0301"), "j\u0307": ("j\u0307", "J", "J"), "\u012e\u0323\u0300": ("\u012f\u0307\u0323\u0300", "\u012e\u0323\u0300", "\u012e\u0323\u0300"), "\u00cc": ("i\u0307\u0300", "\u00cc", "\u00cc"), "Jx": ("jx", "JX", "JX"), "\u012f\u0323\u0307": ("\u012f\u0323\u0307", "\u012e\u0323", "\u012e\u0323")}


def _cases(locale: str, texts: dict[str, tuple[str, str, str]]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = read(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", "[^B-HK-Zb-hk-z]+", "").alias("text"))
        docs = docs.select("doc_id", injected(F.col("text"), F.col("doc_id"), list(texts)).alias("t"))
        return docs.select("doc_id", *[F.sha2(f(F.col("t"), locale), 256).alias(n) for n, f in (("lowered", casing.lower), ("titled", casing.title), ("uppered", casing.upper))])

    return run


def _cases_sql(texts: dict[str, tuple[str, str, str]]) -> str:
    spelt = lambda t: " || ".join(f"chr({ord(c)})" for c in t) or "''"
    pick = lambda i: "CASE doc_id % " + str(len(texts)) + " " + " ".join(f"WHEN {k} THEN {spelt(v[i])}" for k, v in enumerate(texts.values())) + " END"
    side = lambda f, i, n: f"sha256({f}(substr(t, 1, 10)) || {pick(i)} || {f}(substr(t, 11))) AS {n}"
    return f"SELECT doc_id, {side('lower', 0, 'lowered')}, {side('upper', 1, 'titled')}, {side('upper', 2, 'uppered')} FROM (SELECT doc_id, regexp_replace(text, '[^B-HK-Zb-hk-z]', '', 'g') AS t FROM documents)"


def figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures of several families over all documents, with controls, marks and wide letters put in."""
    docs = read(spark, sf_dir, "documents").select("doc_id", injected(F.col("text"), F.col("doc_id"), list(_FIGURES)).alias("t"))
    out = metrics.measured(docs, "t", ("bidiControlBalance", "streamSafeViolation", "widthClassConfusion", "zeroWidthPayload", "hashInputStability"))
    f = F.col("figures")
    return out.select(
        "doc_id", f["bidiControlBalance"]["emb_open"].alias("emb_open"), f["bidiControlBalance"]["max_depth"].alias("max_depth"), f["streamSafeViolation"]["max_run"].alias("max_run"),
        f["streamSafeViolation"]["overruns"].alias("overruns"), f["widthClassConfusion"]["fw_fold"].alias("fw_fold"), f["zeroWidthPayload"]["zwsp_count"].alias("zwsp_count"),
        f["hashInputStability"]["stableSize"].alias("stable_size"),
    )


#: What is put in, and its embeddings, depth, longest run of marks, overruns, wide letters, zero-width spaces and lost characters in NFC.
_FIGURES = {
    "\u202a\u202b\u2066": (2, 3, 0, 0, 0, 0, 0), "\u202e\u202c\u202e": (2, 1, 0, 0, 0, 0, 0), "\u0327" * 31 + "x": (0, 0, 31, 1, 0, 0, 0), "\u0327" * 30 + "x" + "\u0327" * 32 + "x": (0, 0, 32, 1, 0, 0, 0),
    "\uff21\uff22": (0, 0, 0, 0, 2, 0, 0), "\u200b\u200bx\u200b": (0, 0, 0, 0, 0, 3, 0), "": (0, 0, 0, 0, 0, 0, 0),
}
FIGURES_SQL = f"""
WITH d AS (SELECT doc_id, {injected_sql(list(_FIGURES))} AS t FROM documents), v(turn, emb_open, max_depth, max_run, overruns, fw_fold, zwsp_count) AS (
  VALUES {", ".join(str((i, *v[:6])) for i, v in enumerate(_FIGURES.values()))})
SELECT doc_id, emb_open, max_depth, max_run, overruns, fw_fold, zwsp_count, length(regexp_replace(nfc_normalize(t), '[ \t\n\r]+$', ''))::INT AS stable_size
FROM d JOIN v ON doc_id % {len(_FIGURES)} = turn WHERE t IS NOT NULL
"""


def imitated_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers under a nation's name with Cyrillic letters in it, and the nation that it imitates."""
    names = read(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    spoofed = F.when(F.col("c_custkey") % 3 > 0, F.translate("n_name", "AEO", "\u0410\u0415\u041e")).otherwise(F.col("n_name"))
    customers = read(spark, sf_dir, "customer").join(names, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", spoofed.alias("written"))
    # each spelling is resolved once, not each customer
    spellings = lookalikes.confusable_with(customers.select("written").distinct(), "written", names.select("n_name"), "n_name")
    return customers.join(spellings, "written").select("c_custkey", "imitated")


NATION_SQL = "SELECT c_custkey, n_name AS imitated FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 3 > 0 AND regexp_matches(n_name, '[AEO]')"


def used_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ranges of the script table that all documents' characters fall in, and how often."""
    counts = ranges.codepoint_counts(read(spark, sf_dir, "documents").select(F.lit(0).alias("all"), "text"), "all", "text")
    return ranges.range_join(counts, ranges.script_ranges(spark), "cp").groupBy("lo", "hi", "value").agg(F.sum("n").alias("n"))


#: The ranges of one script below U+0100, and the one that starts there and goes on.
RANGE_SQL = r"""
WITH r(lo, hi, value) AS (VALUES (0, 64, 'Zyyy'), (65, 90, 'Latn'), (91, 96, 'Zyyy'), (97, 122, 'Latn'), (123, 169, 'Zyyy'), (170, 170, 'Latn'), (171, 185, 'Zyyy'), (186, 186, 'Latn'),
  (187, 191, 'Zyyy'), (192, 214, 'Latn'), (215, 215, 'Zyyy'), (216, 246, 'Latn'), (247, 247, 'Zyyy'), (248, 696, 'Latn'))
SELECT lo, hi, value, sum(len(regexp_extract_all(text, '[' || printf('\x{%x}-\x{%x}', lo, hi) || ']')))::BIGINT AS n FROM documents, r GROUP BY ALL HAVING sum(len(regexp_extract_all(text, '[' || printf('\x{%x}-\x{%x}', lo, hi) || ']'))) > 0
"""
_CATEGORIES = ("Lu", "Ll", "Lt", "Lm", "Lo", "Mn", "Mc", "Me", "Nd", "Nl", "No", "Pc", "Pd", "Ps", "Pe", "Pi", "Pf", "Po", "Sm", "Sc", "Sk", "So", "Zs", "Zl", "Zp", "Cc", "Cf")


def category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters of all documents by general category, looked up once each."""
    docs = read(spark, sf_dir, "documents").select(F.lit(0).alias("all"), injected(F.col("text"), F.col("doc_id"), _SCRIPTS).alias("t"))
    counts = ranges.codepoint_counts(docs, "all", "t")
    named = counts.withColumn("value", icu.value_name("General_Category", icu.property_value(F.col("cp"), "General_Category")))
    return named.groupBy("value").agg(F.sum("n").alias("n"))


CATEGORY_SQL = f"""
WITH d AS (SELECT {injected_sql(_SCRIPTS)} AS t FROM documents), c(value, re) AS (VALUES {", ".join(f"('{c}', '\\p{{{c}}}')" for c in _CATEGORIES)})
SELECT value, sum(len(regexp_extract_all(t, re)))::BIGINT AS n FROM d, c GROUP BY value HAVING sum(len(regexp_extract_all(t, re))) > 0
"""


def favoured_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold each entry of the curated list of favoured words, one put into each in turn."""
    docs = read(spark, sf_dir, "documents").select(injected(F.col("text"), F.col("doc_id"), [f" {w} " for w in curated.FAVOURED]).alias("t"))
    held = docs.select(F.explode(F.filter(F.array(*map(F.lit, curated.FAVOURED)), lambda w: F.col("t").contains(w))).alias("entry"))
    return held.groupBy("entry").agg(F.count(F.lit(1)).alias("n"))


_ENTRIES = ", ".join("(" + repr(w) + ")" for w in curated.FAVOURED)
FAVOURED_SQL = f"""
WITH d AS (SELECT {injected_sql([f" {w} " for w in curated.FAVOURED])} AS t FROM documents) SELECT entry, count(*) AS n FROM d JOIN (VALUES {_ENTRIES}) AS v(entry) ON contains(t, entry) GROUP BY entry
"""

#: What is put in, by the identifier types that it brings.
_TYPED = {"\u0430": ["Recommended"], "\u200d": ["Default_Ignorable"], "\u16a0": ["Exclusion"], "\uff21": ["Not_NFKC"], "\u2028": ["Not_XID"], "\u0149": ["Deprecated"], "\u00ad": ["Default_Ignorable"], "": []}
_LATIN_TYPES = r"list_filter([CASE WHEN regexp_matches(text, '[0-9A-Za-z_\xC0-\xD6\xD8-\xF6\xF8-\xFF]') THEN 'Recommended' END, CASE WHEN regexp_matches(text, '['':.\x2D\xB7]') THEN 'Inclusion' END, CASE WHEN regexp_matches(text, '[\x00-\x26\x28-\x2C\x2F;-@\[-^`{-\x9F]') THEN 'Not_XID' END], lambda x: x IS NOT NULL)"
TYPE_SQL = f"""
SELECT doc_id, array_to_string(list_sort(list_distinct({_LATIN_TYPES} || CASE doc_id % {len(_TYPED)} {" ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(_TYPED.values()) if v)} ELSE CAST([] AS VARCHAR[]) END)), ',') AS value FROM documents
"""


#: What is put in, and the columns that it takes.
_WIDTHS = {"\u6f22\u5b57": 4, "e\u0301": 1, "\U0001f468\u200d\U0001f469\u200d\U0001f467": 2, "\U0001f1e9\U0001f1ea": 2, "\u2603\ufe0f": 2, "\u200b": 1, "\uff71": 1, "": 0}
_WIDTH_SQL = (
    f"(length(regexp_replace(t, '[\\x00-\\x1F\\x7F-\\x{{9F}}]', '', 'g')) + len(regexp_extract_all(t, '[\u00a9\u00ae]')) + CASE doc_id % {len(_WIDTHS)} "
    + " ".join(f"WHEN {i} THEN {w - len(t)}" for i, (t, w) in enumerate(_WIDTHS.items())) + " END)::INT"
)


def nfc_of_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bytes of all documents in NFC, with a mark put in or broken in three of four; null for those that are no UTF-8."""
    made = F.when(F.col("doc_id") % 2 == 0, F.encode(injected(F.col("text"), F.col("doc_id"), _MARKED), "UTF-8")).otherwise(broken_utf8())
    rows = read(spark, sf_dir, "documents").select("doc_id", made.alias("data"))
    return rows.select("doc_id", F.sha2(codec.nfc_bytes(F.col("data")), 256).alias("digest"), codec.is_nfc_bytes(F.col("data")).alias("is_nfc"))


_MARKED = ["e\u0301", "x", "o\u0308", "x"]
NFC_BYTES_SQL = f"""
SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN sha256(nfc_normalize(t)) END AS digest, CASE WHEN t IS NOT NULL THEN doc_id % 2 = 0 AND nfc_normalize(t) = t END AS is_nfc
FROM (SELECT doc_id, {injected_sql(_MARKED)} AS t FROM documents)
"""


def brackets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brackets, mirrored characters and their counterparts in all documents: how often each occurs and what it pairs with."""
    docs = read(spark, sf_dir, "documents").select(F.lit(0).alias("all"), injected(F.col("text"), F.col("doc_id"), ["([{", "\u300c\u300d", "<\u00ab>", ""]).alias("t"))
    counts = ranges.codepoint_counts(docs, "all", "t").groupBy("cp").agg(F.sum("n").alias("n"))
    paired = counts.select("cp", icu.paired_bracket(F.col("cp")).alias("bracket"), icu.mirror(F.col("cp")).alias("mirror"), "n")
    return paired.where("bracket != cp or mirror != cp")


#: Brackets and mirrored characters in the documents and in what is put in, with their counterparts.
BRACKET_SQL = f"""
WITH d AS (SELECT {injected_sql(["([{", "\u300c\u300d", "<\u00ab>", ""])} AS t FROM documents), v(cp, bracket, mirror) AS (
  VALUES (40, 41, 41), (41, 40, 40), (91, 93, 93), (93, 91, 91), (123, 125, 125), (125, 123, 123), (60, 60, 62), (62, 62, 60), (171, 171, 187), (187, 187, 171), (12300, 12301, 12301), (12301, 12300, 12300))
SELECT cp, bracket, mirror, sum(length(t) - length(replace(t, chr(cp), '')))::BIGINT AS n FROM d, v GROUP BY ALL HAVING sum(length(t) - length(replace(t, chr(cp), ''))) > 0
"""

#: Spellings of scripts' names, put into documents, and the short names.
_SCRIPT_WORDS = {"Latin": "Latn", "latn": "Latn", "qaac": "Copt", "Old-Italic": "Ital", "GREEK": "Grek", "Latinate": None}


def script_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents that name a script, loosely spelt, by script."""
    docs = read(spark, sf_dir, "documents").select(injected(F.col("text"), F.col("doc_id"), [f" \u00a7{w}\u00a7 " for w in _SCRIPT_WORDS]).alias("t"))
    words = docs.select(F.explode(F.regexp_extract_all("t", F.lit("\u00a7([A-Za-z_-]+)\u00a7"), F.lit(1))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    found = property_names.resolved(words, "word", icu.value_aliases(spark, "Script"))
    return found.groupBy("property").agg(F.sum("n").alias("n")).withColumnRenamed("property", "script")


SCRIPT_WORD_SQL = f"""
SELECT script, count(*) AS n FROM documents JOIN (VALUES {", ".join(f"({i}, {'NULL' if p is None else repr(p)})" for i, p in enumerate(_SCRIPT_WORDS.values()))}) AS v(turn, script)
ON doc_id % {len(_SCRIPT_WORDS)} = turn WHERE text IS NOT NULL GROUP BY script
"""


def _told(found: Column) -> Column:
    r = found["reason"]
    return F.concat_ws(":", found["status"], r["kind"], *[r[f].cast("string") for f in ("offset", "byte", "cp", "category", "actual", "limit")])


#: What is put into documents for strict parses, and the reason that it is, with K for its byte offset.
_STRICT = {
    "\u202e": "forbiddenCodepoint:K:8238:bidi_override", "\u034f": "defaultIgnorable:K:847", "\x07": "nonPrintableAsciiByte:K:7", "x\u0301\u0327": "notNfcNormalized:K1", "": "",
    "\ufeff\x01": "nonPrintableAsciiByte:K3:1",
}


def strict_printable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strict parses of all documents' bytes as text to be shown of 20,000 bytes at most, broken ones among them."""
    made = F.when(F.col("doc_id") % 7 == 6, F.concat(F.encode("text", "UTF-8"), F.unhex(F.lit("ED A0 80".replace(" ", "")))))
    made = made.otherwise(F.encode(injected(F.col("text"), F.col("doc_id"), list(_STRICT)), "UTF-8"))
    rows = read(spark, sf_dir, "documents").select("doc_id", made.alias("data"))
    return rows.select("doc_id", _told(strict.printable_result(F.col("data"), 20_000)).alias("value"))


STRICT_SQL = f"""
WITH d AS (SELECT doc_id, doc_id % 7 = 6 AS broken, doc_id % {len(_STRICT)} AS turn, text, {injected_sql(list(_STRICT))} AS t, strlen(substr(text, 1, least(10, length(text)))) AS k FROM documents),
v(turn, why) AS (VALUES {", ".join(f"({i}, {w!r})" for i, w in enumerate(_STRICT.values()))}),
r AS (SELECT doc_id, CASE WHEN broken THEN strlen(text) + 3 ELSE strlen(t) END AS size, CASE WHEN broken THEN 'utf8Surrogate:' || (strlen(text) + 2) || ':55296'
  ELSE replace(replace(replace(why, 'K1', (k + 1)::VARCHAR), 'K3', (k + 3)::VARCHAR), 'K', k::VARCHAR) END AS why, text FROM d JOIN v USING (turn))
SELECT doc_id, CASE WHEN text IS NULL THEN '' WHEN size > 20000 THEN 'rejected:sizeExceeded:' || size || ':20000' WHEN why = '' THEN 'ok' ELSE 'rejected:' || why END AS value FROM r
"""


def strict_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strict parses of all customers' names as identifiers and as printable ASCII, some with something put in."""
    n = F.encode(F.concat(F.element_at(F.array(*map(F.lit, _NAMED)), (F.col("c_custkey") % len(_NAMED) + 1).cast("int")), F.when(F.col("c_custkey") % 2 == 0, F.translate("c_name", "#", "_")).otherwise(F.col("c_name"))), "UTF-8")
    rows = read(spark, sf_dir, "customer").select("c_custkey", n.alias("n"))
    return rows.select("c_custkey", _told(strict.identifier_result(F.col("n"), 19)).alias("identifier"), _told(strict.ascii_result(F.col("n"))).alias("plain"))


_NAMED = ["", "9", "\u00e9", "\x7f", "_"]
#: A name has 18 bytes with its number sign after the eighth.
NAMES_SQL = """
WITH n AS (SELECT c_custkey, c_custkey % 5 AS k, c_custkey % 2 = 0 AS even, strlen(c_name) + CASE c_custkey % 5 WHEN 0 THEN 0 WHEN 2 THEN 2 ELSE 1 END AS size FROM customer)
SELECT c_custkey, CASE WHEN size > 19 THEN 'rejected:sizeExceeded:' || size || ':19' WHEN k = 1 THEN 'rejected:nonIdentifierStartByte:0:57' WHEN k = 3 THEN 'rejected:nonIdentifierStartByte:0:127'
  WHEN even THEN 'ok' ELSE 'rejected:nonIdentifierContinueByte:' || (8 + (k = 4)::INT) || ':35' END AS identifier,
  CASE k WHEN 2 THEN 'rejected:nonAsciiByte:0:195' WHEN 3 THEN 'rejected:nonPrintableAsciiByte:0:127' ELSE 'ok' END AS plain
FROM n
"""


def all_entries() -> dict[str, tuple[Query, str | None]]:
    return {
        "utf8_pieces": (utf8_pieces, UTF8_VERDICT_SQL),
        "utf8_stream": (utf8_stream, UTF8_VERDICT_SQL),
        "script_profile": (script_profile, SCRIPT_SQL),
        "label_joiners": (label_joiners, JOINER_SQL),
        "rgi_emoji": (rgi_emoji, EMOJI_SQL),
        "words_out_of_order": (words_out_of_order, ORDER_SQL),
        "confusable_chains": (confusable_chains, CHAIN_SQL),
        "property_words": (property_words, PROPERTY_WORD_SQL),
        "strict_printable": (strict_printable, STRICT_SQL),
        "strict_names": (strict_names, NAMES_SQL),
        "nfc_bytes": (nfc_of_bytes, NFC_BYTES_SQL),
        "brackets": (brackets, BRACKET_SQL),
        "script_words": (script_words, SCRIPT_WORD_SQL),
        "numerals": (numerals, NUMERAL_SQL),
        "case_turkish": (_cases("turkish", _TURKISH), _cases_sql(_TURKISH)),
        "case_lithuanian": (_cases("lithuanian", _LITHUANIAN), _cases_sql(_LITHUANIAN)),
        "figures": (figures, FIGURES_SQL),
        "cluster_width": over_documents(layout.display_width_clusters, _WIDTH_SQL, list(_WIDTHS)),
        "identifier_types": (over_documents(lambda s: F.array_join(F.array_sort(identifiers.identifier_types(s)), ","), None, list(_TYPED))[0], TYPE_SQL),
        "imitated_targets": (imitated_nations, NATION_SQL),
        "script_ranges": (used_ranges, RANGE_SQL),
        "general_categories": (category_counts, CATEGORY_SQL),
        "vocabulary": (favoured_words, FAVOURED_SQL),
    }
