"""The language model's score against a plain token-by-token computation."""

from collections import Counter
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from glyphloom.llm import lm_scoring as lm

PATH = public_tokenizers.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"


def naive_log10(w, vectors, classes):
    """Class probabilities of one text's words and its end, one token at a time."""
    before = [vectors[-1], *vectors[:-1]]
    out = []
    for t, target in enumerate([*classes, lm.CLASSES - 1]):
        low = max(0, t // lm.STRIDE * lm.STRIDE - (lm.CONTEXT - lm.STRIDE))
        seen = np.array(before[low : t + 1], float)
        query = before[t] @ w.q
        scores = np.array([query @ (x @ w.k) * lm.WIDTH**-0.5 + w.r[len(seen) - 1 - j] for j, x in enumerate(seen)])
        weight = np.exp(scores - scores.max())
        logits = (before[t] + weight / weight.sum() @ (seen @ w.v)) @ w.u.T + w.b
        share = np.exp(logits - logits.max())
        share /= share.sum()
        assert abs(share.sum() - 1) < 1e-6
        out.append(np.log10(share[target]))
    return sum(out)


def test_score_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lm, "HOT_WORDS", 50)  # most words are joined
    kept = {}
    train = lm.train
    monkeypatch.setattr(lm, "train", lambda *a: kept.setdefault("scorer", train(*a)))
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 40")
    odd = spark.createDataFrame([(1000, None), (1001, ""), (1002, " \n"), (None, "the of"), (1003, "zz\u0000q " * 30)], "doc_id long, text string")
    docs = docs.select("doc_id", "text").unionByName(odd).withColumn("row", F.lit("x")).withColumn("id", F.lit(1))
    got = {r["doc_id"]: r for r in lm.score_documents(docs, PATH, F.col("doc_id") % 3 == 0).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert len(got) == len(rows) == 45
    s = kept["scorer"]
    counts = Counter(w for d, t in rows if d is not None and d % 3 == 0 for w in lm.tokens(t))
    memory = lm.Memory(s)
    size = np.zeros(lm.CLASSES)
    for w, n in counts.items():
        size[memory([w])[0][0]] += n + 1
    for d, t in rows:
        words = lm.tokens(t)
        known, codes, _ = lm.coded([words])
        classes, vectors = memory(known)
        classes = classes[codes]
        wanted = naive_log10(memory.weights, [*vectors[codes], vectors[-1]], classes)
        wanted += sum(np.log10((counts[w] + 1) / (size[c] + 1)) for w, c in zip(words, classes))
        assert abs(got[d]["score"] - wanted) < 1e-6 * abs(wanted) + 1e-4, d
        assert got[d]["n_tokens"] == len(words) + 1 and got[d]["n_known"] == sum(counts[w] > 0 for w in words) + 1


def test_gradients_by_differences():
    rng = np.random.default_rng(1)
    w = lm.Weights.start(20, lm.Classes.of_counts(np.ones(20), np.ones(20), 3))
    x, y = rng.normal(size=(2, lm.CONTEXT, lm.WIDTH)), rng.integers(-1, lm.CLASSES, (2, lm.CONTEXT))
    g, dx, loss = lm.gradients(w, x, y)
    for name in ("q", "k", "v", "u", "b", "r"):
        part = getattr(w, name)
        at = tuple(rng.integers(0, n) for n in part.shape)
        held = part[at]
        part[at] = held + 1e-5
        up = lm.gradients(w, x, y)[2]
        part[at] = held
        assert abs((up - loss) / 1e-5 - g[name][at]) < 1e-4
    x[1, 3, 5] += 1e-5
    assert abs((lm.gradients(w, x, y)[2] - loss) / 1e-5 - dx[1, 3, 5]) < 1e-4


def test_windows_cover_texts_and_know_their_ends(spark):
    docs = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(500))), (2, ""), (3, "One two"), (None, "a b"), (4, "x" * 9000)], "id long, text string")
    found = [(tuple(r["words"]), r["first"], r["last"]) for r in lm.windows(docs, 20).collect()]
    assert ((b"one", b"two"), True, True) in found or ((b"two",), False, True) in found
    for words, _, last in found:
        at = [int(w[1:]) for w in words if w.startswith(b"w")]
        assert at == list(range(at[0], at[0] + len(at))) if at else True
        assert len(words) <= lm.CONTEXT + 1 and (not last or not at or at[-1] == 499)


def test_nothing_to_learn_from(spark):
    got = lm.score_documents(spark.createDataFrame([(1, "a b"), (1, "a b")], "doc_id long, text string"), PATH, F.lit(False)).collect()
    assert [(r["n_tokens"], r["n_known"], r["train_tokens"]) for r in got] == [(3, 0, 0)] * 2
    assert lm.score_documents(spark.createDataFrame([], "doc_id long, text string"), PATH, F.lit(True)).count() == 0


def test_scores_with_large_logits_and_in_small_blocks(monkeypatch):
    """Logits too large for a plain exp give what small steps give; at most WINDOWS_AT_ONCE windows of logits are held."""
    rng = np.random.default_rng(3)
    w = lm.Weights(lm.Weights.start(50, lm.Classes.of_counts(np.ones(50), np.ones(50), 3)).rows.astype(np.float32))
    w.u[:] = rng.normal(0, 20, w.u.shape)
    vectors, classes = rng.normal(0, 1, (40, lm.WIDTH)).astype(np.float32), rng.integers(0, lm.CLASSES - 1, 39)
    codes = rng.integers(0, 39, 700)
    got = lm.attention_log10(w, vectors, classes, codes, np.array([0, 0, 9, 700]))
    for value, (low, high) in zip(got, ((0, 0), (0, 9), (9, 700))):
        wanted = naive_log10(w, [*vectors[codes[low:high]], vectors[-1]], classes[codes[low:high]])
        assert abs(value - wanted) < 1e-4 * abs(wanted) + 1e-3
    monkeypatch.setattr(lm, "WINDOWS_AT_ONCE", 3)
    assert np.allclose(got, lm.attention_log10(w, vectors, classes, codes, np.array([0, 0, 9, 700])), rtol=1e-5)


def test_a_worker_hashes_a_word_once(monkeypatch):
    """However many chunks a word is in; the rows are what one chunk gives."""
    texts = [f"the of {i % 5} the W{i} {'x' * 40}" for i in range(60)] + ["", None]
    words = {w for t in texts for w in lm.tokens(t)}
    n = np.ones(lm.Subwords(open(PATH, "rb").read()).size)
    classes = lm.Classes.of_counts(n, n, 3)
    of = sorted((xxhash.xxh64_intdigest(w, lm.SEED) + (1 << 63)) % (1 << 64) - (1 << 63) for w in (b"the", b"of"))
    rows = lm.Weights.start(len(n), classes).rows.astype(np.float32)
    found = []

    def run(chunk):
        monkeypatch.setattr(lm, "CHUNK", chunk)
        scorer = lm.Scorer(open(PATH, "rb").read(), np.array(of), np.array([7.0, 7.0]), classes, rows)
        context = SimpleNamespace(broadcast=lambda value: SimpleNamespace(value=value, _jbroadcast=None))
        docs = SimpleNamespace(sparkSession=SimpleNamespace(sparkContext=context), schema={"id": SimpleNamespace(dataType=SimpleNamespace(simpleString=lambda: "long"))}, mapInArrow=lambda f, _: f)
        lm.Memory.held.clear()
        batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.string())], names=["id", "text"])
        return [r for b in lm._scored(docs, scorer)(iter([batch])) for r in b.to_pylist()]

    whole = run(1 << 20)
    digest = xxhash.xxh64_intdigest
    monkeypatch.setattr(xxhash, "xxh64_intdigest", lambda w, seed: found.append(w) or digest(w, seed))
    cut = run(100)
    lm.Memory.held.clear()
    assert sorted(found) == sorted(words)
    assert [r["id"] for r in cut] == [r["id"] for r in whole] == list(range(len(texts)))
    for one, other in zip(cut, whole):
        assert abs(one["by_class"] - other["by_class"]) < 1e-5 * abs(other["by_class"])
        assert sorted(zip(one["cold"], one["times"])) == sorted(zip(other["cold"], other["times"]))
        assert one["n_tokens"] == other["n_tokens"] and one["hot_known"] == other["hot_known"]
    assert whole[0]["n_tokens"] == 7 and whole[0]["hot_known"] == 3 and whole[-1]["n_tokens"] == whole[-2]["n_tokens"] == 1


def test_words_in_arrow_are_the_tokens():
    """Over every low code point as a separator, nulls, spaces at the ends, and a slice."""
    texts = [None, "", " \t", "Aa\u00c9 \x0bB\x0c"] + [f"{chr(c)}Aa{chr(c)}{chr(c)}B\u00e9{chr(c)}" for c in range(0x300)] + ["a\u2028b\u3000C\U0001d400"]
    for low in (0, 1, 5):
        got = list(lm.chunks(iter([pa.RecordBatch.from_arrays([pa.array(texts[low:])], names=["text"])]), 0, 50))
        assert len(got) > 50 and [w for _, rows in got for w in rows.to_pylist()] == [lm.tokens(t) for t in texts[low:]]
    rows = lm.words_of(pa.array(texts).fill_null("").slice(3, 40))
    words, codes, ends = lm.coded(rows)
    assert [[words[c] for c in codes[a:b]] for a, b in zip(ends, ends[1:])] == [lm.tokens(t) for t in texts[3:43]]
    assert lm.tokens("".join(map(chr, range(1, 0x300)))) == [bytes(range(1, 9)), *"".join(map(chr, range(0xE, 0x20))).encode().split(b" "), "".join(map(chr, range(0x21, 0x300))).translate({c: c + 32 for c in range(65, 91)}).encode()]


def test_scores_with_large_attention(monkeypatch):
    """Weights too large for a plain exp, and larger still on words of other texts and later words, which are not seen."""
    rng = np.random.default_rng(4)
    w = lm.Weights(lm.Weights.start(50, lm.Classes.of_counts(np.ones(50), np.ones(50), 3)).rows.astype(np.float32))
    w.u[:], w.q[:], w.k[:] = rng.normal(0, 1, w.u.shape), 12 * np.eye(lm.WIDTH), 12 * np.eye(lm.WIDTH)
    vectors, classes = rng.normal(0, 1, (40, lm.WIDTH)).astype(np.float32), rng.integers(0, lm.CLASSES - 1, 39)
    codes, ends = rng.integers(0, 39, 300), np.array([0, 7, 9, 9, 40, 300])
    got = lm.attention_log10(w, vectors, classes, codes, ends)
    for value, low, high in zip(got, ends, ends[1:]):
        wanted = naive_log10(w, [*vectors[codes[low:high]], vectors[-1]], classes[codes[low:high]])
        assert abs(value - wanted) < 1e-4 * abs(wanted) + 1e-3
    monkeypatch.setattr(lm, "WINDOWS_AT_ONCE", 1)
    assert np.allclose(got, lm.attention_log10(w, vectors, classes, codes, ends), rtol=1e-5)
