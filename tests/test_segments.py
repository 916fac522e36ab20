"""Word and sentence boundaries against the rules read pair by pair, and very long runs of every class."""

import random

import pytest
from pyspark.sql import functions as F

from glyphloom.functions import segments

WORD = {"a": "A", "b": "A", "א": "H", "1": "N", "2": "N", "カ": "K", "_": "E", ":": "m", ",": "n", ".": "q", "'": "s", '"': "d", "\U0001f1e9": "R", " ": "w", "\r": "r", "\n": "l", "́": "x", "‍": "z", "\U0001f600": "P", "!": ".", "漢": "."}
SENTENCE = {"a": "a", "B": "U", "漢": "O", "1": "N", ".": "t", "!": "T", ")": "c", ",": "s", " ": "w", "\r": "r", "\n": "l", " ": "p", "́": "x", "*": "."}
LONG = 100_000


def skipped(classes, marks, hard):
    """Places whose character stands for itself: marks belong to what they follow, but after a line end."""
    return [i for i, c in enumerate(classes) if c not in marks or i == 0 or classes[i - 1] in hard and all(classes[j] in hard or j == i for j in (i - 1,))]


def word_breaks(text):
    c = [WORD[x] for x in text]
    out = [0]
    for i in range(1, len(c)):
        a, b = c[i - 1], c[i]
        if a == "r" and b == "l":
            continue
        if a in "rl" or b in "rl":
            out.append(i)
            continue
        if a == "z" and b == "P" or a == "w" and b == "w" or b in "xz":
            continue
        base = i - 1
        while base > 0 and c[base] in "xz" and c[base - 1] not in "rl":
            base -= 1
        prev = base - 1
        while prev > 0 and c[prev] in "xz" and c[prev - 1] not in "rl":
            prev -= 1
        nxt = i + 1
        while nxt < len(c) and c[nxt] in "xz":
            nxt += 1
        a, p, n = c[base], c[prev] if prev >= 0 else "", c[nxt] if nxt < len(c) else ""
        run, k = 0, base
        while k >= 0 and c[k] in "Rxz":
            run += c[k] == "R"
            if c[k] in "xz" and k > 0 and c[k - 1] not in "Rxz":
                break
            k -= 1
        keep = (
            a in "AH" and b in "AH" or a in "AH" and b in "mqs" and n and n in "AH" or a in "mqs" and b in "AH" and p and p in "AH" or a == "H" and b == "s"
            or a == "H" and b == "d" and n == "H" or a == "d" and b == "H" and p == "H" or a == "N" and b == "N" or a in "AH" and b == "N" or a == "N" and b in "AH"
            or a in "nqs" and b == "N" and p == "N" or a == "N" and b in "nqs" and n == "N" or a == "K" and b == "K" or a in "AHNKE" and b == "E" or a == "E" and b in "AHNK"
            or a == "R" and b == "R" and run % 2 == 1
        )
        if not keep:
            out.append(i)
    return [text[a:b] for a, b in zip(out, [*out[1:], len(text)])] if text else []


def sentence_breaks(text):
    c = [SENTENCE[x] for x in text]
    hard = "rlp"
    out = [0]
    for i in range(1, len(c)):
        a, b = c[i - 1], c[i]
        if a == "r" and b == "l":
            continue
        if a in hard:
            out.append(i)
            continue
        if b == "x":
            continue
        own = [k for k in range(i) if c[k] != "x" or k == 0 or c[k - 1] in hard]
        left = [c[k] for k in own]
        rest = [c[k] for k in range(i, len(c)) if c[k] != "x"]
        k = len(left)
        while k and left[k - 1] == "w":
            k -= 1
        spaces = len(left) - k
        j = k
        while j and left[j - 1] == "c":
            j -= 1
        term = left[j - 1] if j else ""
        if not term or term not in "tT":
            continue
        closes = k - j
        if term == "t" and not spaces and not closes and b == "N":
            continue
        if term == "t" and not spaces and not closes and b == "U" and j > 1 and left[j - 2] in "aU":
            continue
        if term == "t":
            ahead = next((x for x in rest if x in "OUatT" or x in hard), "")
            if ahead == "a":
                continue
        if b in "stT" or b == "c" and not spaces or b == "w" or b in hard:
            continue
        out.append(i)
    return [text[a:b] for a, b in zip(out, [*out[1:], len(text)])] if text else []


def values(spark, f, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", f(F.col("t")).alias("v"))
    return [r["v"] for r in rows.orderBy("i").collect()]


def texts_of(alphabet, seed, n=1500):
    rng = random.Random(seed)
    return ["".join(rng.choices(list(alphabet), k=rng.randrange(10))) for _ in range(n)] + [None]


def test_words_pair_by_pair(spark):
    texts = texts_of(WORD, 1)
    found = values(spark, segments.words, texts)
    assert [(t, x, word_breaks(t)) for t, x in zip(texts[:-1], found) if x != word_breaks(t)][:3] == []
    assert values(spark, segments.word_count, texts[:-1]) == [len(x) for x in found[:-1]]


def test_sentences_pair_by_pair(spark):
    texts = texts_of(SENTENCE, 2)
    found = values(spark, segments.sentences, texts)
    assert [(t, x, sentence_breaks(t)) for t, x in zip(texts[:-1], found) if x != sentence_breaks(t)][:3] == []
    assert values(spark, segments.sentence_count, texts[:-1]) == [len(x) for x in found[:-1]]


@pytest.mark.parametrize("alphabet", [WORD, SENTENCE], ids=["words", "sentences"])
def test_long_runs_of_every_class(spark, alphabet):
    each = list(alphabet)
    texts = [c * LONG for c in each] + [a + b for a in "a1B" for b in (" " * LONG, ")" * LONG, "́" * LONG)] + [("a" + c) * (LONG // 2) for c in each] + ["Hi." + " " * LONG, "a" + "́" * 51 + ".B"]
    counts, sentences = values(spark, segments.word_count, texts), values(spark, segments.sentence_count, texts)
    assert all(n >= 1 for n in counts + sentences) and sentences[-1] == 1


def test_a_text_with_the_mark_of_cuts(spark):
    assert values(spark, segments.words, ["a\U0010fffeb c"]) == [["a", "\U0010fffe", "b", " ", "c"]]
