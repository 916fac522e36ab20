"""Language-model scoring of whole texts.

Tokens are words and one end. Two scores come from the training fold:

* ``base_score``: a smoothed unigram over the counts of all training words. The frequent
  words' counts travel with the tasks (their number is fixed); the others are joined.
* ``score``: a causal self-attention model over subword ids. A public subword tokenizer cuts
  each word; the word enters attention as the mean of its subwords' embeddings. Attention
  predicts the class of the next word's leading subword, or the end; counts of all training
  words give the word within its class, with one unknown word in each class as the
  base has one in all. So with classes in their overall shares the score is the base score,
  and what attention knows of the next word is what it gains.

Attention sees overlapping windows, of which only the last STRIDE positions are scored, so
that each token is scored once with at least CONTEXT - STRIDE tokens before it where the
text has them. It is fitted in rounds on windows of all training documents, as many as the
corpus is long, and then on every token of every training document: each task fits its own
part from common weights, Spark averages the changes, and the next round starts from the average.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, islice, repeat
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from .common import held_out, text_or_empty, written

#: Words whose counts every task holds: a fixed number, whatever the corpus.
HOT_WORDS = 1 << 16
#: Classes of leading subwords: the end, frequent subwords each, and shares of the others.
CLASSES = 256
SHARED = 15
WIDTH = 16
CONTEXT = 16
STRIDE = 8
#: One window is fitted for so many characters of training text, more often in a small corpus.
WINDOW_CHARS = 6_000
LEAST_WINDOWS = 20_000
CLOSEST_WINDOWS = 50
#: Windows that a task fits in a round, windows of a step, and rounds.
TASK_WINDOWS = 4_096
BATCH = 32
ROUNDS = 4
#: Windows of a step of the pass over all tokens, and its rate.
PASS_BATCH, PASS_RATE = 256, 0.004
#: Positions whose logits are held at once in a step: half a megabyte, which should stay in a core's cache.
LOGITS_AT_ONCE = 512
#: Bytes of text scored at once, bytes whose words are counted at once, and words a worker remembers.
CHUNK = 1 << 20
COUNTED = 1 << 21
REMEMBERED = 400_000
#: Windows scored at once: few, for their logits are half a megabyte and should stay in a core's cache.
WINDOWS_AT_ONCE = 64
SEED = 42

_TEXT_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_END = CLASSES - 1


def tokens(text: str | None) -> list[bytes]:
    """Words of a text; bytes are split at the same six characters, x20 and x09 to x0D."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()


def chunks(batches: Iterator[pa.RecordBatch], column: int, size: int) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Slices of the batches of about ``size`` bytes with their rows' words, as lists; no word is a Python object."""
    for batch in batches:
        texts = pc.fill_null(batch.column(column), "")
        before = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64) // size
        cuts = [0, *(np.flatnonzero(np.diff(before)) + 1).tolist(), len(batch)]
        for low, high in zip(cuts, cuts[1:]):
            if low < high:
                yield batch.slice(low, high - low), words_of(texts.slice(low, high - low))


def words_of(texts: pa.Array) -> pa.Array:
    """Each text's ``tokens``; Arrow's ASCII spaces are the same six characters."""
    found = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    flat = found.flatten()
    real = pc.not_equal(pc.binary_length(flat), 0)
    offsets = found.offsets.to_numpy() - found.offsets[0].as_py()
    ends = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False), dtype=np.int64)])[offsets]
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), flat.filter(real).cast(pa.binary()))


def coded(rows: pa.Array | list[list[bytes]]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct words, the words of all rows as their numbers, and where rows end."""
    lists = rows if isinstance(rows, pa.Array) else pa.array(rows, pa.list_(pa.binary()))
    words = lists.flatten().dictionary_encode()
    codes, ends = words.indices.to_numpy().astype(np.int64), lists.offsets.to_numpy().astype(np.int64)
    return words.dictionary.to_numpy(zero_copy_only=False).tolist(), codes, ends


def word_counts(texts: DataFrame) -> DataFrame:
    """``(word, n)`` over ``texts(text)``, summed by task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in chunks(batches, 0, COUNTED):
            found = rows.flatten().value_counts()
            yield pa.RecordBatch.from_arrays([found.field("values"), found.field("counts")], names=["word", "n"])

    return texts.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Subwords:
    """Subword ids of words; a word that gives none counts as one unknown subword."""

    def __init__(self, model: bytes):
        from sentencepiece import SentencePieceProcessor

        self.processor = SentencePieceProcessor(model_proto=model)
        self.size = self.processor.vocab_size()

    def __call__(self, words: list[bytes]) -> list[list[int]]:
        texts = [w.decode("utf-8", "replace") for w in words]
        return [ids or [0] for ids in self.processor.encode(texts, num_threads=1)]

    def flat(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All words' ids end to end, and where each word's start."""
        ids = self(words)
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), np.int64, int(size.sum())), np.cumsum(size) - size


@dataclass
class Classes:
    """The class of every subword id as a leading subword, and each class's size."""

    of: np.ndarray
    share: np.ndarray  # of the training tokens, smoothed
    log_size: np.ndarray  # log10 of its tokens, its distinct words and one

    @staticmethod
    def of_counts(n: np.ndarray, v: np.ndarray, ends: int) -> Classes:
        """From tokens and distinct words by leading id: frequent ids alone, the others in equal shares."""
        own = _END - SHARED
        order = np.argsort(-n, kind="stable")
        of = np.zeros(len(n), np.int64)
        of[order[:own]] = np.arange(min(own, len(n)))
        rest = order[own:]
        before = np.cumsum(n[rest] + 1.0) - (n[rest] + 1.0)
        of[rest] = own + (before / max(1.0, (n[rest] + 1.0).sum()) * SHARED).astype(np.int64).clip(0, SHARED - 1)
        tokens_in, words_in = np.bincount(of, n, CLASSES), np.bincount(of, v, CLASSES)
        share = tokens_in + words_in + 0.5
        share[_END] = ends + 0.5
        log_size = np.log10(tokens_in + words_in + 1)
        log_size[_END] = 0.0
        return Classes(of, share / share.sum(), log_size)


def lead_counts(counts: DataFrame, model: bytes) -> DataFrame:
    """``(lead, n, v)``: tokens and distinct words of ``counts`` by leading subword id."""
    shared = counts.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = Subwords(shared.value)
        for batch in batches:
            ids, starts = cut.flat(batch.column(0).to_pylist())
            lead, back = np.unique(ids[starts], return_inverse=True)
            n, v = np.bincount(back, batch.column(1).to_numpy()), np.bincount(back)
            yield pa.RecordBatch.from_arrays([pa.array(lead, pa.int32()), pa.array(n.astype(np.int64)), pa.array(v, pa.int64())], names=["lead", "n", "v"])

    each = counts.select("word", "n").mapInArrow(run, "lead int, n long, v long")
    return each.groupBy("lead").agg(F.sum("n").alias("n"), F.sum("v").alias("v"))


class Weights:
    """The layer's parameters, all views of one table of rows of WIDTH numbers.

    ``e`` embeds subword ids (the last row is the start of a text), ``q, k, v`` make queries,
    keys and values, ``u`` and ``b`` give the classes' logits and ``r`` a bias by distance.
    """

    def __init__(self, rows: np.ndarray):
        self.rows = rows
        self.ids = len(rows) - 3 * WIDTH - CLASSES - CLASSES // WIDTH - CONTEXT // WIDTH
        sizes = {"e": self.ids, "q": WIDTH, "k": WIDTH, "v": WIDTH, "u": CLASSES, "b": CLASSES // WIDTH, "r": CONTEXT // WIDTH}
        at = 0
        for name, size in sizes.items():
            part = rows[at : at + size]
            setattr(self, name, part.reshape(-1) if name in "br" else part)
            at += size

    @staticmethod
    def start(ids: int, classes: Classes, seed: int = SEED) -> Weights:
        rng = np.random.default_rng(seed)
        w = Weights(np.zeros((ids + 1 + 3 * WIDTH + CLASSES + CLASSES // WIDTH + CONTEXT // WIDTH, WIDTH)))
        w.e[:] = rng.normal(0, 0.3, w.e.shape)
        for part in (w.q, w.k, w.v):
            part[:] = rng.normal(0, 0.25, part.shape)
        w.b[:] = np.log(classes.share)
        return w

    def embed(self, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Mean embedding of each word's ids, and the start of a text last."""
        if not len(starts):
            return self.e[-1:]
        size = np.diff(np.append(starts, len(ids)))
        return np.vstack([np.add.reduceat(self.e.take(ids, axis=0), starts, axis=0) / size[:, None].astype(self.e.dtype), self.e[-1:]])


_SCALE = WIDTH**-0.5


def gradients(w: Weights, x: np.ndarray, y: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, float]:
    """Gradients of the mean loss, that of the inputs, and the loss.

    ``x`` holds the inputs' vectors (windows, CONTEXT, WIDTH), ``y`` classes with -1 for none. Under ``rows`` are
    those of all rows behind the embeddings as one table.
    """
    n, real = len(y) * CONTEXT, y.ravel() >= 0
    distance = np.arange(CONTEXT)[:, None] - np.arange(CONTEXT)[None, :]
    causal, near = distance >= 0, np.clip(distance, 0, None)
    makes = np.hstack([w.q * x.dtype.type(_SCALE), w.k, w.v])
    flat = x.reshape(n, WIDTH)
    q, k, v = (flat @ makes).reshape(-1, CONTEXT, 3, WIDTH).transpose(2, 0, 1, 3)
    a = q @ k.transpose(0, 2, 1)
    a += np.where(causal, w.r[near], -1e9).astype(x.dtype)
    a -= a.max(2, keepdims=True)
    np.exp(a, out=a)
    a /= a.sum(2, keepdims=True)
    z = np.ones((n, WIDTH + 1), x.dtype)
    np.add(x, a @ v, out=z.reshape(*x.shape[:2], WIDTH + 1)[:, :, :WIDTH])
    share = x.dtype.type(1 / max(1, int(real.sum())))
    to_classes, ones, target = np.vstack([w.u.T, w.b]), np.ones(CLASSES, x.dtype), np.maximum(y.ravel(), 0)
    held, dz, out, loss = np.empty((LOGITS_AT_ONCE, CLASSES), x.dtype), np.empty((n, WIDTH), x.dtype), np.zeros((CLASSES, WIDTH + 1), x.dtype), 0.0
    for low in range(0, n, LOGITS_AT_ONCE):
        mine = slice(low, low + LOGITS_AT_ONCE)
        inner, known = z[mine], real[mine]
        d = np.matmul(inner, to_classes, out=held[: len(inner)])
        if d.max() > 60:
            d -= d.max(1)[:, None]
        np.exp(d, out=d)
        d *= (known * share / (d @ ones)).astype(x.dtype, copy=False)[:, None]
        at = np.flatnonzero(known) * CLASSES + target[mine][known]
        loss -= float(np.log(held.reshape(-1)[at] / share + 1e-30).sum() * share)
        held.reshape(-1)[at] -= share
        out += d.T @ inner
        np.matmul(d, w.u, out=dz[mine])
    dz3 = dz.reshape(x.shape)
    da = dz3 @ v.transpose(0, 2, 1)
    ds = a * (da - (da * a).sum(2, keepdims=True))
    back = np.empty((len(y), CONTEXT, 3, WIDTH), x.dtype)
    back[:, :, 0], back[:, :, 1], back[:, :, 2] = ds @ k, ds.transpose(0, 2, 1) @ q, a.transpose(0, 2, 1) @ dz3
    back = back.reshape(n, 3 * WIDTH)
    made = flat.T @ back
    made[:, :WIDTH] *= x.dtype.type(_SCALE)
    g = Weights(np.zeros((WIDTH * 3 + CLASSES + CLASSES // WIDTH + CONTEXT // WIDTH, WIDTH), x.dtype))
    g.q[:], g.k[:], g.v[:] = made.reshape(WIDTH, 3, WIDTH).transpose(1, 0, 2)
    g.u[:], g.b[:] = out[:, :WIDTH], out[:, WIDTH]
    g.r[:] = np.bincount(near[causal], ds.sum(0)[causal], CONTEXT)
    return {"rows": g.rows} | {name: getattr(g, name) for name in "qkvubr"}, (dz + back @ makes.T).reshape(x.shape), loss


def _cut(text: str, at: int) -> tuple[list[bytes], bool, bool]:
    """Up to CONTEXT + 1 words of a text from a place on, and whether they hold its start and its end."""
    far = at + 100 * CONTEXT
    found = list(islice(_TEXT_WORD.finditer(text, at, far), CONTEXT + 3))  # with one that begins before and one that ends behind
    if at and found and found[0].start() == at and not text[at - 1].isspace():
        found = found[1:]
    if far < len(text) and found and found[-1].end() >= far:
        found = found[:-1]
    ends = far >= len(text) and len(found) <= CONTEXT
    return [tokens(m[0])[0] for m in found[: CONTEXT + 1]], at == 0, ends


def windows(texts: DataFrame, every: float) -> DataFrame:
    """``(words, first, last)``: runs of words at seeded places, one for ``every`` characters of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, size, value in zip(batch.column(0).to_pylist(), pc.utf8_length(batch.column(1)).to_pylist(), batch.column(1)):
                draw = np.random.default_rng(xxhash.xxh64_intdigest(str(key), SEED))
                places = (draw.random(int(size / every + draw.random())) * (size + 1)).astype(int).tolist()
                text = value.as_py() if places else ""
                out += [_cut(text, at if at > 5 else 0) for at in places]
            words, first, last = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.list_(pa.binary())), pa.array(first, pa.bool_()), pa.array(last, pa.bool_())], names=["words", "first", "last"])

    return texts.select("id", "text").mapInArrow(run, "words array<binary>, first boolean, last boolean")


def sequences(rows: list[tuple[list[bytes], bool, bool]], number: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Inputs and targets of windows as word numbers; -2 is the end, -1 none, and the start is the last number."""
    start = len(number)
    inputs, targets = np.full((len(rows), CONTEXT), start), np.full((len(rows), CONTEXT), -1)
    for i, (words, first, last) in enumerate(rows):
        run = ([start] if first else []) + [number[w] for w in words]
        after = run[1:] + ([-2] if last else [])
        n = min(CONTEXT, len(after), len(run))
        inputs[i, :n], targets[i, :n] = run[:n], after[:n]
    return inputs, targets


_CHANGE = "row int, n double, change array<double>"


def _change(diff: np.ndarray, n: int) -> pa.RecordBatch:
    """The rows of weights that ``n`` windows have moved, by how much, times ``n``."""
    moved = np.flatnonzero(diff.any(axis=1))
    flat = pa.array((diff[moved] * float(n)).ravel().astype(np.float64))
    return pa.RecordBatch.from_arrays(
        [pa.array(moved, pa.int32()), pa.array(np.full(len(moved), float(n))), pa.FixedSizeListArray.from_arrays(flat, WIDTH).cast(pa.list_(pa.float64()))],
        names=["row", "n", "change"],
    )


def _averaged(each: DataFrame, weights: Weights) -> Weights:
    """``weights`` moved by the average of the tasks' changes, summed by Spark row by row."""
    sums = [F.sum(F.get("change", F.lit(i))).alias(f"s{i}") for i in range(WIDTH)]
    found = each.groupBy("row").agg(F.sum("n").alias("n"), *sums).toPandas().sort_values("row")
    out = weights.rows.copy()
    out[found["row"].to_numpy(np.int64)] += found[[f"s{i}" for i in range(WIDTH)]].to_numpy(float) / found[["n"]].to_numpy(float)
    return Weights(out)


def _fitted(runs: DataFrame, weights: Weights, classes: Classes, tokenizer: bytes, rate: float) -> Weights:
    """The average of the weights that each task fits to its windows, summed by Spark row by row."""
    shared = runs.sparkSession.sparkContext.broadcast((weights.rows.astype(np.float32), classes, tokenizer))
    key = shared._jbroadcast.id() if shared._jbroadcast is not None else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, of, model = shared.value
        cuts = Cuts.of_worker(key, model, of, Weights(start).ids - 1)

        def change(rows: list) -> pa.RecordBatch:
            known = {w: i for i, w in enumerate({w: 0 for r in rows for w in r[0]})}
            numbers = cuts(list(known))
            inputs, targets = sequences(rows, known)
            lead = np.append(cuts.classes[numbers], [-1, _END, -1])
            targets = lead[np.where(targets < 0, len(known) - 1 - targets, targets)]  # none and end stand behind the words
            fitted = Pass(start, rate, BATCH)
            fitted(cuts, np.append(numbers, 0)[inputs], targets)
            return _change(fitted.w.rows - start, len(rows))

        held: list = []
        for batch in batches:
            held += zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist())
            while len(held) >= 2 * TASK_WINDOWS:
                yield change(held[:TASK_WINDOWS])
                held = held[TASK_WINDOWS:]
        if held:
            yield change(held)

    return _averaged(runs.mapInArrow(run, _CHANGE), weights)


class Cuts:
    """Leading classes and subword ids of words that a worker has met, by number; the start of a text is number 0."""

    held: dict[int, Cuts] = {}

    def __init__(self, model: bytes, classes: Classes, start: int):
        self.cut, self.of, self.start = Subwords(model), classes.of, start
        self._forget()

    @staticmethod
    def of_worker(key: int, model: bytes, classes: Classes, start: int) -> Cuts:
        if key not in Cuts.held:
            Cuts.held.clear()
            Cuts.held[key] = Cuts(model, classes, start)
        return Cuts.held[key]

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.ids, self.starts, self.classes = np.array([self.start]), np.zeros(1, np.int64), np.array([-1])

    def __call__(self, words: list[bytes]) -> np.ndarray:
        """The numbers of distinct words."""
        if len(self.known) + len(words) > REMEMBERED:
            self._forget()
        new = [w for w in words if w not in self.known]
        if new:
            ids, starts = self.cut.flat(new)
            self.known.update(zip(new, range(len(self.starts), len(self.starts) + len(new))))
            self.starts = np.append(self.starts, len(self.ids) + starts)
            self.ids = np.append(self.ids, ids)
            self.classes = np.append(self.classes, self.of[ids[starts]])
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))


def all_windows(numbers: np.ndarray, classes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inputs and targets of windows side by side, in which each token of each text, with its end, is a target once.

    ``numbers`` are all texts' words, ``classes`` theirs, ``ends`` where texts end, from zero.
    """
    sizes = np.diff(ends) + 1
    spans = -(-sizes // CONTEXT)
    first = np.concatenate([[0], np.cumsum(spans)])
    begin = first[:-1] * CONTEXT
    place = np.arange(len(numbers)) + np.repeat(begin - ends[:-1], sizes - 1)
    inputs, targets = np.zeros(first[-1] * CONTEXT + 1, np.int64), np.full(first[-1] * CONTEXT, -1)
    inputs[place + 1], targets[place] = numbers, classes
    inputs = inputs[:-1]
    inputs[begin] = 0  # not the word behind a text that fills its windows
    targets[begin + sizes - 1] = _END
    return inputs.reshape(-1, CONTEXT), targets.reshape(-1, CONTEXT)


class Pass:
    """Steps of ``batch`` windows that come in parts: Adam, and for embeddings AdaGrad by row."""

    def __init__(self, rows: np.ndarray, rate: float, batch: int):
        self.w, self.rate, self.batch, self.t, self.windows = Weights(rows.copy()), rate, batch, 0, 0
        self.dense = self.w.rows[self.w.ids :]
        self.first, self.second = np.zeros((2, *self.dense.shape), rows.dtype)
        self.grown = np.full(self.w.ids, 1e-8, rows.dtype)

    def __call__(self, cuts: Cuts, inputs: np.ndarray, targets: np.ndarray) -> None:
        size = np.diff(cuts.starts, append=len(cuts.ids))
        for low in range(0, len(inputs), self.batch):
            self._step(cuts, size, inputs[low : low + self.batch].ravel(), targets[low : low + self.batch])
        self.windows += len(inputs)

    def _step(self, cuts: Cuts, size: np.ndarray, words: np.ndarray, y: np.ndarray) -> None:
        w, rate, kind = self.w, self.rate, self.dense.dtype.type
        self.t += 1
        n = size[words]
        first = np.cumsum(n) - n
        own = cuts.ids[np.repeat(cuts.starts[words] - first, n) + np.arange(n.sum())]
        part = (1 / n).astype(kind)[:, None]
        x = np.add.reduceat(w.e.take(own, axis=0), first, axis=0) * part
        g, dx, _ = gradients(w, x.reshape(-1, CONTEXT, WIDTH), y)
        order = np.argsort(own, kind="stable")
        ordered = own[order]
        heads = np.flatnonzero(np.diff(ordered, prepend=-1))
        touched = ordered[heads]
        de = np.add.reduceat((dx.reshape(-1, WIDTH) * part).take(np.repeat(np.arange(len(n)), n)[order], axis=0), heads, axis=0)
        self.grown[touched] += (de**2).mean(axis=1)
        w.e[touched] -= kind(3 * rate) * de / np.sqrt(self.grown[touched])[:, None]
        self.first += kind(0.1) * (g["rows"] - self.first)
        self.second += kind(0.02) * (g["rows"] ** 2 - self.second)
        self.dense -= kind(rate / (1 - 0.9**self.t)) * self.first / (np.sqrt(self.second / kind(1 - 0.98**self.t)) + kind(1e-8))


def _passed(texts: DataFrame, weights: Weights, classes: Classes, tokenizer: bytes, rate: float) -> Weights:
    """The average of the weights that each task fits to every token of its texts."""
    shared = texts.sparkSession.sparkContext.broadcast((weights.rows.astype(np.float32), classes, tokenizer))
    key = shared._jbroadcast.id() if shared._jbroadcast is not None else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, of, model = shared.value
        cuts = Cuts.of_worker(key, model, of, Weights(start).ids - 1)
        fitted = Pass(start, rate, PASS_BATCH)
        for _, rows in chunks(batches, 0, CHUNK):
            words, codes, ends = coded(rows)
            numbers = cuts(words)[codes]
            fitted(cuts, *all_windows(numbers, cuts.classes[numbers], ends))
        if fitted.windows:
            yield _change(fitted.w.rows - start, fitted.windows)

    return _averaged(texts.select("text").mapInArrow(run, _CHANGE), weights)


def fit_attention(texts: DataFrame, classes: Classes, tokenizer: bytes, ids: int) -> Weights:
    """Fit the layer to all of ``texts(id, text)``: first to windows of each, ROUNDS times over, then to every token."""
    weights = Weights.start(ids, classes)
    chars = texts.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"]
    if not chars:
        return weights
    every = min(WINDOW_CHARS, max(CLOSEST_WINDOWS, chars / LEAST_WINDOWS))
    parts = max(1, round(chars / every / TASK_WINDOWS))
    runs = written(windows(texts, every).repartition(parts), "lm-windows")  # in turn, for many windows may have the same words
    for k in range(ROUNDS):
        weights = _fitted(runs, weights, classes, tokenizer, 0.02 * (1 - k / ROUNDS))
    return _passed(texts, weights, classes, tokenizer, PASS_RATE)


@dataclass
class Scorer:
    """All that a task needs; made on the driver, sent once to each executor."""

    tokenizer: bytes
    hot_hash: np.ndarray
    hot_n: np.ndarray
    classes: Classes
    rows: np.ndarray  # the weights, as float32

    def counts(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each word and its count if it is a frequent one, else -1."""
        hashes = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in words), np.uint64, len(words)).view(np.int64)
        if not len(self.hot_hash) or not words:
            return hashes, np.full(len(words), -1.0)
        at = np.minimum(np.searchsorted(self.hot_hash, hashes), len(self.hot_hash) - 1)
        return hashes, np.where(self.hot_hash[at] == hashes, self.hot_n[at], -1.0)


class Memory:
    """Classes, vectors, hashes and frequent words' counts of words that a worker has met, for one scorer."""

    held: dict[int, Memory] = {}

    def __init__(self, scorer: Scorer):
        self.scorer, self.cut, self.weights = scorer, Subwords(scorer.tokenizer), Weights(scorer.rows)
        self.known: dict[bytes, int] = {}
        self.classes = np.zeros(REMEMBERED, np.int16)
        self.vectors = np.zeros((REMEMBERED, WIDTH), np.float32)
        self.hashes, self.n = np.zeros(REMEMBERED, np.int64), np.zeros(REMEMBERED)

    @staticmethod
    def of(key: int, scorer: Scorer) -> Memory:
        if key not in Memory.held:
            Memory.held.clear()
            Cuts.held.clear()  # fitting is over
            Memory.held[key] = Memory(scorer)
        return Memory.held[key]

    def __call__(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Class and vector of each of distinct words; the vector of a text's start is last."""
        return self.look_up(words)[:2]

    def look_up(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """As a call, and with it what ``Scorer.counts`` gives for the words."""
        at = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        classes, vectors = self.classes[at].astype(np.int64), np.vstack([self.vectors[at], self.weights.e[-1:]])
        hashes, n = self.hashes[at], self.n[at]
        new = np.flatnonzero(at < 0)
        if len(new):
            fresh = [words[i] for i in new]
            ids, starts = self.cut.flat(fresh)
            classes[new], vectors[new] = self.scorer.classes.of[ids[starts]], self.weights.embed(ids, starts)[:-1]
            hashes[new], n[new] = self.scorer.counts(fresh)
            low = len(self.known)
            room = new[: REMEMBERED - low]
            self.known.update((words[i], low + j) for j, i in enumerate(room))
            for held, found in ((self.classes, classes), (self.vectors, vectors), (self.hashes, hashes), (self.n, n)):
                held[low : low + len(room)] = found[room]
        return classes, vectors, hashes, n


def attention_log10(w: Weights, vectors: np.ndarray, classes: np.ndarray, codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """log10 probability of each row's classes followed by the end.

    ``vectors`` holds the words' vectors and the start's last, ``codes`` all rows' word
    numbers, ``ends`` where rows end, from zero.
    """
    sizes = np.diff(ends) + 1  # with the end
    spans = -(-sizes // STRIDE)  # blocks of STRIDE tokens of each row; a window ends with each
    first = np.concatenate([[0], np.cumsum(spans)])
    back = CONTEXT - STRIDE
    begin = first[:-1] * STRIDE  # the place of each row's first token
    place = np.arange(len(codes)) + np.repeat(begin - ends[:-1], sizes - 1)
    target = np.full(first[-1] * STRIDE, -1, np.int64)
    target[place] = classes[codes]
    target[begin + sizes - 1] = _END
    inputs = np.full(back + len(target), len(vectors) - 1, np.int64)  # the start, also before the first token
    inputs[back + place + 1] = codes
    opening = np.arange(first[-1]) - np.repeat(first[:-1], spans)  # the number of a window in its row
    # a word's vector, query, key and value side by side; the steps' arrays are made once and refilled
    table = np.hstack([vectors, vectors @ (w.q * np.float32(_SCALE)), vectors @ w.k, vectors @ w.v])
    distance = np.arange(back, CONTEXT)[:, None] - np.arange(CONTEXT)[None, :]
    causal, near = distance >= 0, w.r[np.clip(distance, 0, CONTEXT - 1)].astype(np.float32)
    # the classes' biases are a last row of the product; without large logits or weights none has to be made smaller before exp
    out = np.ascontiguousarray(np.vstack([w.u.T, w.b]), np.float32)
    x, q, k, v = np.maximum(table.max(axis=0), -table.min(axis=0)).reshape(4, WIDTH)
    small = float((x + v) @ np.abs(w.u).max(axis=0) + np.abs(w.b).max()) < 80
    light = float(q @ k + np.abs(w.r).max()) < 40
    step = WINDOWS_AT_ONCE
    rows = np.zeros((back + step * STRIDE, 4 * WIDTH), np.float32)
    xs, qs, _, _ = rows[back:].reshape(step, STRIDE, 4, WIDTH).transpose(2, 0, 1, 3)
    windows_of = np.lib.stride_tricks.sliding_window_view(rows, CONTEXT, axis=0)[::STRIDE]
    ks, vs = windows_of[:, 2 * WIDTH : 3 * WIDTH], windows_of[:, 3 * WIDTH :].transpose(0, 2, 1)
    mixed = np.empty((step, STRIDE, WIDTH), np.float32)
    weights = np.empty((step, STRIDE, CONTEXT), np.float32)
    z = np.ones((step * STRIDE, WIDTH + 1), np.float32)
    held = np.empty((step * STRIDE, CLASSES), np.float32)
    seen, ones, at = np.ones(CONTEXT, np.float32), np.ones(CLASSES, np.float32), np.arange(step * STRIDE) * CLASSES
    chosen, total = np.zeros((2, len(target)), np.float32)
    for low in range(0, first[-1], step):
        n = min(step, first[-1] - low)
        mine = slice(low * STRIDE, (low + n) * STRIDE)
        np.take(table, inputs[low * STRIDE : back + (low + n) * STRIDE], axis=0, out=rows[: back + n * STRIDE], mode="clip")
        weight = np.matmul(qs[:n], ks[:n], out=weights[:n])
        weight += near
        unseen = [(i, back - opening[low + i] * STRIDE) for i in np.flatnonzero(opening[low : low + n] * STRIDE < back)]
        if not light:
            weight[:, ~causal] = -1e9
            for i, far in unseen:
                weight[i, :, :far] = -1e9
            weight -= weight.max(axis=2, keepdims=True)
        np.exp(weight, out=weight)
        weight *= causal
        for i, far in unseen:
            weight[i, :, :far] = 0
        weight = weight.reshape(-1, CONTEXT)
        weight /= (weight @ seen)[:, None]
        inner, logits = z[: n * STRIDE], held[: n * STRIDE]
        np.add(xs[:n], np.matmul(weights[:n], vs[:n], out=mixed[:n]), out=inner.reshape(n, STRIDE, -1)[:, :, :WIDTH])
        np.matmul(inner, out, out=logits)
        if not small:
            logits -= logits.max(axis=1)[:, None]
        chosen[mine] = logits.ravel().take(at[: n * STRIDE] + np.maximum(target[mine], 0))
        np.exp(logits, out=logits)
        np.matmul(logits, ones, out=total[mine])
    sums = np.concatenate([[0.0], np.cumsum(np.where(target >= 0, chosen - np.log(total), 0), dtype=np.float64)])
    return (sums[first[1:] * STRIDE] - sums[first[:-1] * STRIDE]) / np.log(10)


def _row_sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return sums[ends[1:]] - sums[ends[:-1]]


def _scored(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """``id, n_tokens, hot_log, hot_known, by_class`` and the words to join as two arrays."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(scorer)
    key = shared._jbroadcast.id() if shared._jbroadcast is not None else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = shared.value
        memory = Memory.of(key, s)
        for part, rows in chunks(batches, 1, CHUNK):
            words, codes, ends = coded(rows)
            classes, vectors, hashes, n = memory.look_up(words)
            hot = n >= 0
            logs = np.where(hot, np.log10(np.maximum(n, 0) + 1), 0.0)
            by_class = attention_log10(memory.weights, vectors, classes, codes, ends) - _row_sums(s.classes.log_size[classes][codes], ends)
            cold = ~hot[codes]
            row = np.repeat(np.arange(len(rows)), np.diff(ends))
            pair, times = np.unique(row[cold] * max(1, len(words)) + codes[cold], return_counts=True)
            offsets = np.searchsorted(pair // max(1, len(words)), np.arange(len(rows) + 1)).astype(np.int32)
            column = lambda x, kind: pa.ListArray.from_arrays(pa.array(offsets), pa.array(x, kind))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array(np.diff(ends) + 1),
                    pa.array(_row_sums(logs[codes], ends)),
                    pa.array(_row_sums(hot[codes], ends).astype(np.int64)),
                    pa.array(by_class),
                    column(hashes[pair % max(1, len(words))], pa.int64()),
                    column(times, pa.int64()),
                ],
                names=["id", "n_tokens", "hot_log", "hot_known", "by_class", "cold", "times"],
            )

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(run, f"id {kind}, n_tokens long, hot_log double, hot_known long, by_class double, cold array<long>, times array<long>")


def train(texts: DataFrame, counts: DataFrame, tokenizer: bytes, ends: int) -> Scorer:
    """Everything frozen: hot counts, the classes' sizes and the attention layer.

    ``texts(id, text)`` are the training documents and ``counts`` all their words'. Per
    leading subword and per row of the layer one row of sums reaches the driver, so at
    most the tokenizer's vocabulary.
    """
    hot = counts.orderBy(F.desc("n"), "word").limit(HOT_WORDS).select(F.xxhash64("word").alias("h"), "n").toPandas().sort_values("h")
    ids = Subwords(tokenizer).size
    n, v = np.zeros((2, ids))
    leads = lead_counts(counts, tokenizer).toPandas()
    n[leads["lead"].to_numpy()], v[leads["lead"].to_numpy()] = leads["n"], leads["v"]
    classes = Classes.of_counts(n, v, ends)
    weights = fit_attention(texts, classes, tokenizer, ids)
    return Scorer(tokenizer, hot["h"].to_numpy(np.int64), hot["n"].to_numpy(float), classes, weights.rows.astype(np.float32))


def score_documents(docs: DataFrame, tokenizer_path: str, training, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: id, ``n_tokens, n_known, train_tokens, base_score, score``.

    ``training`` is a condition on ``docs`` that picks the rows to learn from; null is false.

    * A null or empty text is one token, the end. With nothing to learn from all words
      are unknown and the model is as it starts. Rows repeated with one id are scored each
      and, in training, counted each. A null id is kept. An empty table gives an empty
      result; other columns are ignored, whatever their names.
    * Texts are scored whole, CHUNK bytes at a time where rows are short; one longer text
      is held in one task.
    """
    spark = docs.sparkSession
    ship(spark)
    tokenizer = Path(tokenizer_path).read_bytes()
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"), training.alias("learn"))
    learn = rows.where("learn").select("id", "text")
    counts = written(word_counts(learn.select("text")), "word-counts")
    ends = learn.count()
    known = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    total, distinct = known["n"] + ends, known["v"] + (ends > 0)
    scorer = train(learn, counts, tokenizer, ends)
    scored = written(_scored(rows.select("id", "text"), scorer).withColumn("row", F.monotonically_increasing_id()), "scored")

    cold = scored.where("size(cold) > 0").select("row", F.explode(F.arrays_zip("cold", "times")).alias("x")).select("row", F.col("x.cold").alias("h"), "x.times")
    found = cold.join(counts.select(F.xxhash64("word").alias("h"), "n"), "h")
    sums = found.groupBy("row").agg(F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("log"), F.sum("times").alias("known"))
    out = scored.drop("cold", "times").join(sums, "row", "left")
    end_log = float(np.log10(ends + 1.0))
    shift = float(np.log10(total + distinct + 1.0))
    words_log = F.col("hot_log") + F.coalesce("log", F.lit(0.0))
    return out.select(
        F.col("id").alias(id_col),
        "n_tokens",
        (F.col("hot_known") + F.coalesce("known", F.lit(0)) + F.lit(int(ends > 0))).cast("long").alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"),
        (words_log + end_log - F.col("n_tokens") * shift).alias("base_score"),
        (words_log + F.col("by_class")).alias("score"),
    )


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = score_documents(docs, public_tokenizers.path("piece_bpe_32k.model"), ~held_out(7))
    return out.select("doc_id", held_out(7).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
