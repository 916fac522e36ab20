"""Joins, orders, chains and rules against plain loops over small inputs."""

import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from glyphloom.functions import casing, domains, identifiers, layout
from glyphloom.operators import chains, emoji, metrics, ordering, property_names, ranges
from glyphloom.sources import delimited
from glyphloom.tables import icu


def values(spark, f, texts, kind="string"):
    rows = spark.createDataFrame(list(enumerate(texts)), f"i int, t {kind}").select("i", f(F.col("t")).alias("v"))
    return [r["v"] for r in rows.orderBy("i").collect()]


# Joins and orders


def test_range_join_is_the_nested_loop(spark):
    rng = random.Random(1)
    spans = [(a, a + rng.choice([0, 3, 70, 5_000, 10**6, 10**12])) for a in (rng.choice([rng.randrange(500), rng.randrange(10**6), -(10**5), 2**60]) for _ in range(60))]
    spans += [spans[0], (9, 3), (None, 5), (4, None)]
    points = [rng.choice([rng.randrange(600), rng.randrange(10**6), 2**60, -99_990]) for _ in range(200)] + [None]
    left = spark.createDataFrame(list(enumerate(points)), "i int, p long")
    right = spark.createDataFrame([(k, *s) for k, s in enumerate(spans)], "k int, lo long, hi long")
    wanted = {(i, p, k, *s) for i, p in enumerate(points) for k, s in enumerate(spans) if None not in (p, *s) and s[0] <= p <= s[1]}
    found = [tuple(r) for r in ranges.range_join(left, right, "p").collect()]
    assert len(found) == len(wanted) and set(found) == wanted
    kept = {tuple(r) for r in ranges.range_join(left, right, "p", how="left").collect()}
    assert kept == wanted | {(i, p, None, None, None) for i, p in enumerate(points) if i not in {w[0] for w in wanted}}
    assert ranges.range_join(left, right.where("false"), "p").count() == 0
    plan = ranges.range_join(left, right, "p")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    with pytest.raises(ValueError):
        ranges.range_join(left.withColumnRenamed("i", "k"), right, "p")


def test_neighbours_across_partitions(spark):
    rng = random.Random(2)
    rows = [(rng.choice([None, "a", "b", *"cdefgh"]), i) for i in range(500)]
    df = spark.createDataFrame(rows, "w string, n int").repartition(7)
    found = ordering.neighbours(df, ["w", "n"], ["w", "n"]).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1]))
    before = {r: b for b, r in zip([None, *order], order)}
    assert len(found) == 500
    assert all((tuple(r["before"]) if r["before"] else None) == before[r["w"], r["n"]] for r in found)
    assert ordering.neighbours(df.where("false"), ["w", "n"], ["w"]).count() == 0
    wrong = ordering.out_of_order(df.where("w is not null"), ["n"], ["w"], F.col("before.w") <= F.col("w"))
    plain = [r for r in rows if r[0] is not None]
    assert wrong.count() == sum(a[0] > b[0] for a, b in zip(plain, plain[1:]))


def test_chains_are_plain_iteration(spark):
    rng = random.Random(3)
    letters = [chr(0x4E00 + i) for i in range(300)]
    table = {c: "".join(rng.choices(letters[i + 1 :] + ["x"], k=rng.choice([1, 1, 1, 2]))) for i, c in enumerate(letters) if i % 3 < 2}
    table |= {chr(0x3400 + i): chr(0x3401 + i) for i in range(200)} | {"z": "z", "gone": ""}

    def follow(text):
        depth = 0
        while (after := "".join(table.get(c, c) for c in text)) != text:
            text, depth = after, depth + 1
        return text, depth

    found = {r["source"]: (r["target"], r["depth"], r["expansion"]) for r in chains.resolve(spark.createDataFrame([*table.items(), (None, "x"), ("q", None)], "source string, target string")).collect()}
    wanted = {}
    for c, t in table.items():
        text, depth = follow(t)
        wanted[c] = (text, depth + (t != c), len(text))
    assert found == wanted
    with pytest.raises(ValueError):
        chains.resolve(spark.createDataFrame([("a", "b"), ("b", "ca"), ("c", "c")], "source string, target string"))


# Emoji


def test_emoji_by_greedy_longest_match(spark):
    rng, known = random.Random(4), emoji.sequences()
    longest = max(map(len, known))
    pieces = [*rng.sample(sorted(known), 300), "‍", "️", "a", "1", "\U0001f3fd", "\U0001f1e6", "⃣"]
    texts = ["".join(rng.choices(pieces, k=8)) for _ in range(300)] + ["", "x" * 1000, "\U0001f468‍" * 5000]

    def greedy(t):
        out, at = [], 0
        while at < len(t):
            n = next((n for n in range(min(longest, len(t) - at), 0, -1) if t[at : at + n] in known), 0)
            out += [t[at : at + n]] if n else []
            at += n or 1
        return out

    assert values(spark, emoji.rgi_emoji, texts) == [greedy(t) for t in texts]
    assert values(spark, emoji.is_rgi, ["\U0001f600", "☺", "☺️", "ab", "", None]) == [True, False, True, False, False, None]
    assert {"basic", "keycap", "flag", "modifier", "tag", "zwj"} == set(known.values()) and len(known) > 3_000


def test_cluster_widths(spark):
    texts = ["abc", "é", "漢字", "\U0001f468‍\U0001f469‍\U0001f467", "\U0001f1e9\U0001f1ea", "\r\n", "☃️", "́", "", None, "§漢"]
    assert values(spark, layout.display_width_clusters, texts) == [3, 1, 4, 2, 2, 0, 2, 0, 0, None, 3]
    assert values(spark, lambda s: layout.display_width_clusters(s, True), ["§", "α"]) == [2, 2]


# Labels


def joining(cp):
    for name in "LRDTC":
        if any(a <= cp <= b for a, b in icu.ranges(f"[:jt={name}:]")):
            return name
    return "U"


def joiners_by_loop(label):
    types = [joining(ord(c)) for c in label]
    for i, c in enumerate(label):
        virama = i > 0 and unicodedata.combining(label[i - 1]) == 9
        if c == "‍" and not virama:
            return False
        if c == "‌" and not virama:
            before = next((t for t in reversed(types[:i]) if t != "T"), None)
            after = next((t for t in types[i + 1 :] if t != "T"), None)
            if before not in ("L", "D") or after not in ("R", "D"):
                return False
    return True


def test_joiners_in_their_context(spark):
    rng = random.Random(5)
    alphabet = "‌‍‌ابتدًेक्aA-ꡲبـ"
    labels = ["".join(rng.choices(alphabet, k=rng.randrange(7))) for _ in range(600)] + ["ب" + "ً" * 100_000 + "‌ب", "‍" * 5]
    wanted = [joiners_by_loop(x) for x in labels]
    assert values(spark, domains.joiners_in_place, labels) == wanted and 100 < sum(wanted) < 550
    assert values(spark, domains.joiners_in_place, [None]) == [None]


def test_joiners_make_domains_fail(spark):
    found = values(spark, lambda s: domains.to_ascii_result(s)["has_errors"], ["نامه‌ای.com", "a‌b.com", "xn--ab-m1t.com"])
    assert found == [False, True, True]
    free = domains.Options(check_joiners=False)
    assert values(spark, lambda s: domains.to_ascii_result(s, free)["has_errors"], ["a‌b.com"]) == [False]


def test_punycode_of_surrogates_is_none(spark):
    assert domains.punycode_decode("ab-zd9k") is None and domains.punycode_decode("bcher-kva") == "bücher"
    row = values(spark, domains.to_unicode, ["xn--ab-zd9k"])[0]
    assert row["value"] == "xn--ab-zd9k" and row["has_errors"]


# Case


def ccc(c):
    return unicodedata.combining(c)


def looks(text, at, step, hit, stop):
    at += step
    while 0 <= at < len(text):
        if hit(text[at]):
            return True
        if stop(text[at]):
            return False
        at += step
    return False


def holds(text, i, condition, cased, dotted):
    zero, zero_or_above = (lambda c: ccc(c) == 0), (lambda c: ccc(c) in (0, 230))
    if condition == "Final_Sigma":
        return looks(text, i, -1, cased, zero) and not looks(text, i, 1, cased, zero)
    if condition == "After_Soft_Dotted":
        return looks(text, i, -1, dotted, zero_or_above)
    if condition == "More_Above":
        return looks(text, i, 1, lambda c: ccc(c) == 230, zero)
    if condition == "Not_Before_Dot":
        return not looks(text, i, 1, lambda c: c == "̇", zero)
    if condition == "After_I":
        return looks(text, i, -1, lambda c: c == "I", zero_or_above)
    return True


def case_by_loop(text, locale, column, cased, dotted):
    out = []
    for i, c in enumerate(text):
        rules = [r for r in casing.RULES if r[0] == c and r[4] in ("", casing.LANGUAGES[locale]) and holds(text, i, r[5], cased, dotted)]
        plain = [None, "σ" if c == "Σ" else c.lower(), c.title(), c.upper()][column]
        out.append(rules[0][column] if rules else plain)
    return "".join(out)


@pytest.mark.parametrize("locale", sorted(casing.LANGUAGES))
def test_case_rules_by_loop(spark, locale):
    rng = random.Random(6)
    alphabet = "IiJjİıĮįÌÍĨΣσΑa1 ̧̣̇̇́ßﬁᾳ"
    texts = ["".join(rng.choices(alphabet, k=rng.randrange(9))) for _ in range(500)] + ["I" + "̣" * 20_000 + "̇", "Α" + "́" * 20_000 + "Σ", ""]
    inside = lambda pattern: (lambda spans: lambda c: any(a <= ord(c) <= b for a, b in spans))(icu.ranges(pattern))
    cased, dotted = inside("[:Cased:]"), inside("[:Soft_Dotted:]")
    for column, f in ((1, casing.lower), (2, casing.title), (3, casing.upper)):
        wanted = [case_by_loop(t, locale, column, cased, dotted) for t in texts]
        found = values(spark, lambda s: f(s, locale), texts)
        assert [(t, x, w) for t, x, w in zip(texts, found, wanted) if x != w][:3] == []


def test_title_of_every_letter(spark):
    letters = [chr(cp) for a, b in icu.ranges("[:CWT:]") for cp in range(a, b + 1) if unicodedata.category(chr(cp)) != "Cn"]
    found = values(spark, casing.title, letters)
    letters, found = zip(*[(c, x) for c, x in zip(letters, found) if unicodedata.category(x[0]) != "Cn"])  # pairs newer than Python's table
    assert [(c, x, c.title()) for c, x in zip(letters, found) if x != c.title()] == []
    assert values(spark, casing.simple_title, ["ǆß"]) == [[0x1C5, 0xDF]] and values(spark, casing.simple_lower, ["İA"]) == [[0x69, 0x61]]


# Names, types, figures


def test_property_names(spark):
    table = icu.property_aliases(spark).cache()
    words = spark.createDataFrame([("General_Category",), ("generalcategory",), ("gc",), ("GC",), ("space",), ("no such",), (None,), ("",)], "w string")
    loose = {r["w"]: r["property"] for r in property_names.resolved(words, "w", table).collect()}
    assert loose == {"General_Category": "gc", "generalcategory": "gc", "gc": "gc", "GC": "gc", "space": "WSpace", "no such": None, None: None, "": None}
    strict = {r["w"]: r["property"] for r in property_names.resolved(words, "w", table, strict=True).collect()}
    assert strict["gc"] == "gc" and strict["GC"] is None and strict["General_Category"] == "gc"
    assert table.where("short = 'scx'").count() >= 2


def test_tabbed_rows_keep_the_first(spark, tmp_path):
    (tmp_path / "a.txt").write_text("# note\nU+4E00\tkOne\t1\nU+4E00\tkOne\t2\nU+4E00\tkTwo\t3 4\nU+20000\tkOne\t 5 \nbroken\tkOne\t1\nU+4E01\n")
    (tmp_path / "b.txt").write_text("U+4E00\tkOne\t9\n")
    rows = {(r["cp"], r["field"]): r["entry"] for r in delimited.read_tabbed(spark, str(tmp_path)).collect()}
    assert rows == {(0x4E00, "kOne"): "1", (0x4E00, "kTwo"): "3 4", (0x20000, "kOne"): "5"}


def test_identifier_types(spark):
    found = values(spark, identifiers.identifier_types, ["ab", "aᚠ", "'", "", None])
    assert found == [["Recommended"], ["Recommended", "Exclusion"], ["Inclusion"], [], None] or found[:4] == [["Recommended"], ["Recommended", "Exclusion"], ["Inclusion"], []]
    assert values(spark, lambda s: identifiers.of_types(s, "Recommended", "Inclusion"), ["a'b", "ᚠ"]) == [True, False]


def test_claims_about_figures(spark):
    df = spark.createDataFrame([({"n": "3", "bad": "x", "flag": "true", "odd": "yes", "name": "a"},)], "m map<string,string>")
    check = lambda key, actual, kind: df.select(metrics.claim_agrees(F.col("m"), key, F.lit(actual), kind).alias("v")).first()["v"]
    assert [check("n", 3, "number"), check("n", 4, "number"), check("bad", 3, "number"), check("absent", 9, "number")] == [True, False, False, True]
    assert [check("flag", True, "flag"), check("flag", False, "flag"), check("odd", True, "flag"), check("name", "a", "text"), check("name", "b", "text")] == [True, False, False, True, False]


def test_figures_of_texts(spark):
    assert values(spark, lambda s: metrics.figures(s, "bidiControlBalance"), ["a‪⁦b‬‬", None])[0].asDict() == {"emb_open": 1, "emb_pop": 2, "iso_open": 1, "iso_pop": 0, "max_depth": 2}
    assert values(spark, lambda s: metrics.figures(s, "caseExpansionMismatch"), ["aßΐİ"])[0].asDict() == {"upper_exp": 2, "lower_exp": 1, "max_exp": 3}
    assert values(spark, lambda s: metrics.as_attribution(metrics.figures(s, "tagBlockPayload"), "tagBlockPayload"), ["ab"]) == [{"tag_count": "0", "total_cps": "2"}]
    assert values(spark, lambda s: metrics.agrees(F.create_map(F.lit("total_cps"), F.lit("2")), s, "tagBlockPayload"), ["ab", "abc"]) == [True, False]


def test_case_rules_from_lines(spark):
    """Lines as in the public file, with conditions of two languages and rows without any."""
    lines = ["# note", "00DF; 00DF; 0053 0073; 0053 0053; # no condition", "0049; 0069 0307; 0049; 0049; lt More_Above; # I", "0307; ; 0307; 0307; tr After_I; # dot", "0307; ; 0307; 0307; az After_I; # dot", "0130; 0069; 0130; 0130; tr; # I dot", "03A3; 03C2; 03A3; 03A3; Final_Sigma; # sigma"]
    rules = casing.read_rules(spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1))
    assert rules == (("I", "i\u0307", "I", "I", "lt", "More_Above"), ("\u0307", "", "\u0307", "\u0307", "tr", "After_I"), ("\u0130", "i", "\u0130", "\u0130", "tr", ""), ("Σ", "ς", "Σ", "Σ", "", "Final_Sigma"))
    assert set(rules) <= set(casing.RULES)
    assert values(spark, lambda s: casing.lower(s, "azeri", rules), ["I\u0307\u0130ΑΣ"]) == ["iiας"]


def test_values_of_properties(spark):
    names = {(r["short"], r["alias"]) for r in icu.value_aliases(spark, "Script").collect()}
    assert {("Latn", "Latn"), ("Latn", "Latin"), ("Copt", "Qaac")} <= names
    assert values(spark, lambda s: icu.numeric_value(F.ascii(s)), ["四", "½", "a"]) == [4.0, 0.5, None]
    assert values(spark, lambda s: icu.paired_bracket(F.ascii(s)), ["(", "a"]) == [41, 97]


def test_strict_parses(spark):
    from glyphloom.functions import strict

    data = [b"", b"a_1", b"1a", b"a-", "é".encode(), b"\xed\xa0\x80", "é".encode(), "a‮".encode(), b"\x07", None, b"x" * 30]
    told = lambda f: [None if r is None else (r["reason"]["kind"], r["reason"]["offset"]) if r["reason"] else r["status"] for r in values(spark, f, data, "binary")]
    assert told(lambda d: strict.identifier_result(d, 20)) == [
        ("identifierEmpty", None), "ok", ("nonIdentifierStartByte", 0), ("nonIdentifierContinueByte", 1), ("nonIdentifierStartByte", 0), ("nonIdentifierStartByte", 0),
        ("nonIdentifierContinueByte", 1), ("nonIdentifierContinueByte", 1), ("nonIdentifierStartByte", 0), None, ("sizeExceeded", None),
    ]
    assert told(lambda d: strict.printable_result(d, 20)) == ["ok", "ok", "ok", "ok", "ok", ("utf8Surrogate", 2), ("notNfcNormalized", 0), ("forbiddenCodepoint", 1), ("nonPrintableAsciiByte", 0), None, ("sizeExceeded", None)]
    assert told(strict.ascii_result)[4:9] == [("nonAsciiByte", 0), ("nonAsciiByte", 0), ("nonAsciiByte", 1), ("nonAsciiByte", 1), ("nonPrintableAsciiByte", 0)]
    assert told(lambda d: strict.in_container(strict.blob_result(d, 20), F.lit(100)))[5:6] == [("utf8Surrogate", 102)]


def test_a_cluster_has_to_name_its_shared_folder():
    from types import SimpleNamespace

    from glyphloom import intermediate

    session = lambda master, folder: SimpleNamespace(conf=SimpleNamespace(get=lambda *_: folder), sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: None, setCheckpointDir=lambda _: None))
    assert intermediate.shared_folder(session("local[8]", None)).startswith("file:///")
    assert intermediate.shared_folder(session("spark://x:7077", "hdfs://x/y")) == "hdfs://x/y"
    for master in ("spark://x:7077", "yarn", "local-cluster[3,2,3000]"):
        with pytest.raises(ValueError):
            intermediate.shared_folder(session(master, None))


def test_idna_round_trip_takes_three_python_workers_a_task(spark):
    """Each step of Python in a chain keeps a worker for each running task: mapping is left to Spark's expressions."""
    plan = queries()["fn_idna_round_trip"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") <= 3  # seven before


def test_idna_maps_each_character_once(spark):
    """Longer mappings, single ones and dropped characters side by side; what is mapped is not mapped again."""
    df = spark.createDataFrame([("ẞﬁ­Ä‍ς",), ("ß\U0001d400",), (None,), ("",)], "s string")
    got = df.select(domains.idna_map(F.col("s")).alias("m"), domains.idna_map(F.col("s"), True).alias("t")).collect()
    assert [tuple(r) for r in got] == [("ßfiä‍ς", "ßfiäσ"), ("ßa", "ssa"), (None, None), ("", "")]
