"""The attention layer learns from every token of the training texts."""

import numpy as np
import public_tokenizers

from glyphloom.llm import lm_scoring as lm

PATH = public_tokenizers.path("piece_bpe_32k.model")


def test_each_token_is_a_target_once():
    rng = np.random.default_rng(2)
    sizes = [0, 1, lm.CONTEXT - 1, lm.CONTEXT, lm.CONTEXT + 1, 100, 0, 3 * lm.CONTEXT]
    ends = np.cumsum([0, *sizes])
    numbers = np.arange(1, ends[-1] + 1)
    classes = rng.integers(0, lm.CLASSES - 1, ends[-1])
    inputs, targets = lm.all_windows(numbers, classes, ends)
    found = [(x, y) for x, y in zip(inputs.ravel(), targets.ravel()) if y >= 0]
    wanted = []
    for low, high in zip(ends, ends[1:]):
        wanted += zip([0, *numbers[low:high]], [*classes[low:high], lm.CLASSES - 1])
    assert found == wanted
    # what has no target stands behind a text, where no target sees it
    for row in targets:
        assert not (np.diff((row >= 0).astype(int)) > 0).any()


def test_words_outside_of_the_windows_are_learnt(spark, monkeypatch):
    monkeypatch.setattr(lm, "LEAST_WINDOWS", 1)
    monkeypatch.setattr(lm, "WINDOW_CHARS", 1 << 40)
    texts = [" ".join(f"{a}{b}" for b in "abcdefghijklmnopqrst") for a in "bcdfghjklmnp"]
    model = open(PATH, "rb").read()
    cut = lm.Subwords(model)
    n = np.ones(cut.size)
    classes = lm.Classes.of_counts(n, n, len(texts))
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)
    moved = (lm.fit_attention(docs, classes, model, cut.size).rows != lm.Weights.start(cut.size, classes).rows).any(axis=1)
    ids, _ = cut.flat([w for t in texts for w in lm.tokens(t)])
    assert moved[np.unique(ids)].all()
