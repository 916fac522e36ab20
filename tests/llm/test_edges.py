"""Stages over clashing columns, nulls, repeats and empty tables."""

import pytest
from pyspark.sql import functions as F

from glyphloom.llm import decontamination, exact_dedup, language_id, mixing, near_copies, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = " ".join(f"w{i}" for i in range(60))
CLASHES = ("_id", "_lost", "_scored", "_c0", "id", "key", "sig", "fp", "component", "component_id", "_n", "_sha", "taken_", "row", "k", "node")


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, WORDS, "en", "a", 1), (2, WORDS + " ", "en", "a", 1), (None, WORDS, "en", None, 1), (3, None, None, "b", 0), (4, "", "en", "b", 0), (5, "a b c", "en", "b", 5), (5, "a b c", "en", "b", 5), (5, "d e f g", "en", "b", 5)]
    return spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in CLASHES})


def kept(df):
    return sorted((r["doc_id"] or -1, r["text"]) for r in df.collect() if r["text"])


def test_exact(docs):
    out = exact_dedup.drop_exact_copies(docs)
    assert out.columns == docs.columns
    assert kept(out) == [(2, WORDS + " "), (5, "a b c"), (5, "d e f g")]
    assert exact_dedup.drop_exact_copies(docs.limit(0)).count() == 0


def test_near(docs):
    out = near_copies.drop_near_copies(docs)
    assert out.columns == docs.columns and {d for d, _ in kept(out)} == {-1, 1, 5}
    assert simhash.drop_near_duplicates(docs, radius=0).columns == docs.columns


def test_mix_language_and_benchmark(spark, docs):
    out = mixing.mixed(docs)
    assert set(docs.columns) < set(out.columns) and {d for d, _ in kept(out)} <= {-1, 1, 2, 5}
    model = language_id.train(docs.select("doc_id", "text", "lang"))
    known = language_id.keep_known_language(docs, model)
    assert known.columns == docs.columns and known.where("text is null or text = ''").count() == 0
    clean = decontamination.drop_contaminated(docs, spark.createDataFrame([(1, WORDS)], "item_id long, text string"))
    assert clean.columns == docs.columns and {d for d, _ in kept(clean)} == {5}


def test_number_signs_are_no_letters_and_columns_may_clash(spark):
    rows = [(i, t, 0.5, "x", "y") for i, t in enumerate(["½ ²", "①②", "Ⅷ", "12 — !", "١٢", "aⅧ"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double, _scored string, _kept0 string")
    model = language_id.train(spark.createDataFrame([(1, "some words of a text", "en"), (2, "einige Wörter", "de")], "doc_id long, text string, lang string"))
    found = language_id.predict(docs, model)
    assert found.columns == ["doc_id", "text", "_scored", "_kept0", "lang_pred", "score", "bits_per_byte"]
    got = {r["doc_id"]: r for r in found.collect()}
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in range(5)) and got[5]["lang_pred"] != "und" and got[0]["_kept0"] == "y"
