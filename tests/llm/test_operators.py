"""The training-data operators against brute force, accuracy and edge cases."""

import json
import math
import re
from collections import Counter
from zlib import crc32

import pytest
import xxhash
from pyspark.sql import functions as F

from glyphloom.llm import chat, decontamination, exact_dedup, language_id, license_scan, lm_scoring, mixing, secret_scan, simhash, token_counts

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _id string, size int"


def table(spark, texts, sources=None):
    rows = [(i, t, "en", (sources or ["s"])[i % len(sources or [1])], 0, "x", 7) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


def test_language_accuracy_on_held_out(spark, docs):
    found = language_id.op1_language_id(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in found) >= 0.95 * len(found)


def test_language_of_odd_texts(spark, docs):
    model = language_id.train(docs.select("doc_id", "text", "lang"))
    # the prose is invented, so a long text of a language is one of its own documents over and over
    english = docs.where("lang = 'en' and length(text) > 1000").orderBy("doc_id").first()["text"]
    got = {r["doc_id"]: r for r in language_id.predict(table(spark, [None, "", "123 !", english * 400]), model).collect()}
    assert [got[i]["lang_pred"] for i in range(3)] == ["und"] * 3 and got[3]["lang_pred"] == "en"
    assert language_id.predict(table(spark, []), model).count() == 0


def test_lm_base_score_by_brute_force(spark, docs):
    got = {r["doc_id"]: r for r in lm_scoring.op2_lm_scoring(spark, SF).collect()}
    texts = {r["doc_id"]: re.findall(r"[^\x20\x09-\x0D]+", (r["text"] or "").translate({c: c + 32 for c in range(65, 91)})) + [None] for r in docs.collect()}
    counts = Counter(w for d, ws in texts.items() if crc32(str(d).encode()) % 7 != 2 for w in ws)
    n, v = sum(counts.values()), len(counts)
    for d, ws in texts.items():
        assert got[d]["n_tokens"] == len(ws) and got[d]["n_known"] == sum(counts[w] > 0 for w in ws) and got[d]["train_tokens"] == n
        assert math.isclose(got[d]["base_score"], sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws), rel_tol=1e-9)


def test_lm_beats_its_base_on_held_out(spark):
    held = [r for r in lm_scoring.op2_lm_scoring(spark, SF).collect() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_token_counts_use_the_cache(spark, tmp_path):
    import public_tokenizers
    from sentencepiece import SentencePieceProcessor

    path, texts = public_tokenizers.path("piece_bpe_32k.model"), ["a b", None, "", "a b", "</s> <s>", "word " * 5000]
    cut, cache = SentencePieceProcessor(model_file=path), str(tmp_path / "cache")
    for _ in range(2):
        got = {r["doc_id"]: r for r in token_counts.count_tokens(table(spark, texts), path, cache).collect()}
        assert [got[i]["n_tokens"] for i in range(6)] == [len(cut.encode(t or "")) for t in texts]
    assert got[5]["over_limit"] and spark.read.parquet(cache).count() == 4
    assert token_counts.count_tokens(table(spark, []), path, cache).count() == 0


def test_exact_dedup_edges(spark):
    got = {r["doc_id"]: r for r in exact_dedup.exact_dedup(table(spark, ["a b", "ab", None, " ", "a  b", "c"]), hash_all=True).collect()}
    assert [got[i]["keep_id"] for i in range(6)] == [4, 4, 3, 3, 4, 5]
    assert [got[i]["group_size"] for i in range(6)] == [3, 3, 2, 2, 3, 1]
    assert exact_dedup.exact_dedup(table(spark, [])).count() == 0


def brute_fingerprint(text, width):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    runs = [b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_components_by_brute_force(spark, docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    prints = {d: brute_fingerprint(t, 4) for d, t in rows}
    least = {d: d for d in prints}
    moved = True
    while moved:
        moved = False
        for a in prints:
            for b in prints:
                if least[a] < least[b] and (prints[a] ^ prints[b]).bit_count() <= 4:
                    least[b], moved = least[a], True
    got = {r["doc_id"]: r for r in simhash.op5_simhash(spark, SF).collect()}
    assert {d: r["fingerprint"] for d, r in got.items()} == {d: f"{p:016x}" for d, p in prints.items()}
    assert {d: r["component_id"] for d, r in got.items()} == least


def test_simhash_edges(spark):
    got = {r["doc_id"]: r for r in simhash.near_duplicates(table(spark, [None, "", "a", "a"]), width=4).collect()}
    assert got[0]["fp"] == 0 and got[1]["component_id"] == 0 and got[3]["component_id"] == 2
    assert simhash.near_duplicates(table(spark, [])).count() == 0


def test_mix_meets_targets_and_repeats_itself(spark):
    a, b = (sorted(map(tuple, mixing.op6_mixing(spark, SF).collect())) for _ in range(2))
    assert a == b
    rows = mixing.op6_mixing(spark, SF).groupBy("source_size", "target").agg(F.sum("taken").alias("taken"), F.max(F.col("taken") - 3 * F.col("size")).alias("over"))
    for r in rows.collect():
        assert abs(r["taken"] - r["target"]) <= 0.02 * r["target"] + 50 and r["over"] <= 0
    assert mixing.mix(table(spark, [None, "", "a"], ["s", None])).count() == 3 and mixing.mix(table(spark, [])).count() == 0


def test_chat_links_calls_and_results(spark):
    call = lambda i, a: json.dumps({"tool_calls": [{"id": i, "name": "f", "arguments": a}]})
    rows = [
        (1, 0, "user", "hi"), (1, 1, "tool", json.dumps({"tool_call_id": "x"})), (1, 2, "assistant", call("x", {"n": 1})), (1, 3, "assistant", call("y", {"n": "bad"})),
        (2, 0, "tool", json.dumps({"tool_call_id": "gone"})), (None, 0, None, None),
    ]
    tools = spark.createDataFrame([("f", json.dumps({"type": "object", "properties": {"n": {"type": "integer"}}}))], "name string, schema string")
    got = {(r["conv_id"], r["turn"]): r for r in chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), tools).collect()}
    assert (got[1, 1]["order_turn"], got[1, 1]["order_step"]) == (2, 1)
    assert got[1, 3]["problem"] == "bad_arguments" and got[2, 0]["problem"] == "orphan_result" and got[1, 2]["problem"] is None
    assert got[1, 0]["json"] == '{"content":"hi","role":"user"}'


def brute_secrets(text):
    out = []
    for m in re.finditer(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.ASCII):
        out += [(m.start(), 0, "assign", m.end())] if len(m[2]) >= 6 else []
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [(k, a, b) for a, _, k, b in sorted(out)]


def test_secret_spans_by_brute_force(spark, docs):
    texts = [r["text"] for r in docs.collect()] + [None, "", "é token = 'abcdef' AKIA" + "A" * 30 + " " + "0f" * 20, "pAsSwd=abc secret: abcdefg"]
    got = {r["doc_id"]: r for r in secret_scan.scan_secrets(table(spark, texts)).collect()}
    for i, t in enumerate(texts):
        assert [(x["kind"], x["start"], x["end"]) for x in got[i]["base"]] == brute_secrets(t or "")
    assert secret_scan.scan_secrets(table(spark, [])).count() == 0


def test_decontamination_catches_reordered_passages(spark):
    words = [f"w{i}" for i in range(40)]
    item = " ".join(words)
    texts = ["x y " + item.upper(), " ".join(words[20:] + ["z"] + words[:20]), "nothing here", None, "", " ".join(words[:8])]
    bench = spark.createDataFrame([(1, item), (2, None), (3, "too short")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontamination.contaminated(table(spark, texts), bench).collect()}
    assert set(got) == {(0, 1), (1, 1)} and got[1, 1]["n_tiles"] == 2 and got[0, 1]["coverage"] == 1.0
    assert decontamination.contaminated(table(spark, []), bench).count() == 0


def test_licences(spark):
    mit = "Notes. Released under the MIT License. More.\nLicensed under the Apache License, Version 2.0."
    got = license_scan.scan_licences(table(spark, [mit, None, "", "the MIT License is nice"])).collect()
    assert sorted((r["doc_id"], r["licence"]) for r in got) == [(0, "Apache-2.0"), (0, "MIT")]


def test_pipeline_keeps_columns_and_drops_copies(spark, docs):
    import corpus_pipeline

    kept = corpus_pipeline.near(spark, corpus_pipeline.exact(spark, docs, SF), SF)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
    out = corpus_pipeline.run(spark, SF)
    assert out.select("doc_id").distinct().count() == out.count() <= kept.count()
