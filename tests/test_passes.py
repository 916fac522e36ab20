"""Functions that pass once over a text, against plain Python on odd texts, and the sizes of their plans."""

import re

import pytest
from pyspark.sql import functions as F

from glyphloom.functions import casing, codec, identifiers, layout, segments
from glyphloom.operators import detectors
from glyphloom.plans import text_queries, verdict_queries
from glyphloom.tables import icu

TEXTS = ["", "a", "é" * 300, "x" * 255 + "éé" + "y" * 300 + "é", "\U0001f600é" * 200, "a\nb\r\né‍‍", "no hit", None]


def column(spark, f, texts=TEXTS):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r["v"] for r in rows.select("i", f(F.col("t")).alias("v")).orderBy("i").collect()]


def plan(spark, f):
    return spark.range(1).select(F.lit("x").alias("t")).select(f(F.col("t")).alias("v"))._jdf.queryExecution().analyzed().toString()


@pytest.mark.parametrize("cls", [r"[é\n]", r"\x{200D}", r"[^a-z]", "[:é]"])
def test_positions_over_blocks(spark, cls):
    plain = re.compile(cls.replace(r"\x{200D}", "‍"))
    assert column(spark, lambda s: codec.positions(s, cls)) == [None if t is None else [m.start() for m in plain.finditer(t)] for t in TEXTS]


def test_positions_split_no_text_into_characters(spark):
    assert "split(" not in plan(spark, lambda s: codec.positions(s, "[é]"))


def test_scripts_of_latin_letters(spark):
    letters = [chr(c) for c in range(0x100)]
    sets = identifiers.script_classes()
    wanted = [sorted(n for n, c in sets.items() if n == "Latn" and (t.isalpha() and t != "µ")) for t in letters]
    found = column(spark, lambda s: F.array_sort(identifiers.scripts(s)), letters)
    assert [f for t, f in zip(letters, found) if t.isalpha()] == [w for t, w in zip(letters, wanted) if t.isalpha()]
    assert not any(icu.ranges(f"[[:scx={n}:]&[:sc=Latn:]&[\\u0000-\\u00FF]]") for n in sets if n != "Latn")
    assert column(spark, identifiers.scripts, ["éж", None, "1"]) == [["Cyrl", "Latn"], None, []]


@pytest.mark.parametrize("locale", ["turkish", "lithuanian"])
def test_case_rules_name_the_text_once_each(spark, locale):
    # each rule named the text of the one before it three times
    assert all(plan(spark, lambda s: f(s, locale)).count("regexp_replace") < 20 for f in (casing.lower, casing.title, casing.upper))


def test_title_of_characters_apart(spark):
    texts = ["straße ﬃx ǆ ǅ ა", "ß" * 300 + "ж", chr(0x10F200) + "ßa", "plain é", "ᾳΐŉ", "", None]
    one = lambda c: F.when(c.rlike(icu.regex("[:CWT:]")), casing.title_character(c)).otherwise(c)
    slow = lambda s: F.array_join(F.transform(codec.chars(s), one), "")
    assert column(spark, casing.title, texts) == column(spark, slow, texts)
    assert column(spark, casing.title, texts)[0] == "STRASsE FfiX ǅ ǅ ა"


def test_orientation_by_runs(spark):
    upright = icu.regex("[[:vo=U:][:vo=Tu:]]")
    slow = lambda s: F.transform(codec.chars(s), lambda c: F.when(c.rlike(upright), "Upright").otherwise("Rotated"))
    texts = [*TEXTS, "漢字ab©漢"]
    assert column(spark, layout.orientation, texts) == column(spark, slow, texts)


@pytest.mark.parametrize("ambiguous", [False, True])
def test_cluster_widths_by_runs(spark, ambiguous):
    texts = [*TEXTS, "abc©é漢éx", "é", "­漢a", "👨‍👩‍👧ab®️", "a\r\n漢"]
    slow = lambda s: F.aggregate(segments.graphemes(s), F.lit(0), lambda n, c: n + layout.cluster_width(c, ambiguous))
    assert column(spark, lambda s: layout.display_width_clusters(s, ambiguous), texts) == column(spark, slow, texts)
    assert column(spark, lambda s: F.size(segments.pieces(s)), ["x" * 1000 + "漢"]) == [3]


def test_little_endian_by_turning(spark):
    texts = ["", "aé漢😀", "﻿ab", "ab﻿", None]
    little = lambda t: None if t is None else t.encode("utf-32-le")
    assert [None if v is None else bytes(v) for v in column(spark, lambda s: codec.utf32(s, little=True), texts)] == [little(t) for t in texts]
    back = column(spark, lambda s: codec.decode_utf32(codec.utf32(s, little=True), little=True), texts)
    assert back == ["", "aé漢😀", "ab", "ab﻿", None]
    assert "regexp_replace" not in plan(spark, lambda s: codec.utf32(s, little=True))


def test_forbidden_characters_look_once(spark):
    assert plan(spark, codec.first_forbidden).count("regexp_extract(") < 3
    assert column(spark, codec.first_forbidden, ["ab͏"])[0].asDict() == {"offset": 2, "cp": 0x34F, "kind": "default_ignorable"}


def test_watermarks_at_even_steps_look_once(spark):
    found = column(spark, detectors.ai_watermark, ["a b c d", " a bc ", "plain"])
    assert [(v["tag"], v["positions"]) for v in found] == [("Adversarial", [1, 3, 5]), ("NnbspBoundary", [0, 2, 5]), (None, [])]
    assert plan(spark, detectors.ai_watermark).count("regexp_extract_all") < 40


def test_spellings_are_counted_before_they_are_collated(spark):
    found = text_queries.collated_names(spark, "/root/testdata/sf0.001")
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 2


def test_word_lists_are_written_once(spark):
    text = verdict_queries.mnemonics(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in text
