"""Language identification by prediction by partial matching.

For each language a variable-order tree of byte contexts holds frozen counts. The code
length of a byte after its context is that of the longest context that has seen the
byte, plus an escape for each longer context that has been seen without it (escape
method C: a context with t symbols, d of them distinct, escapes with d / (t + d)). A text
goes to the language whose tree codes it in the fewest bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from .common import held_out, plain_names

#: Bytes of the longest context.
ORDER = 4
#: At most so many labelled documents of each language are learned from, whole.
SAMPLE_DOCS = 256
UNKNOWN = "und"
#: Bytes scored at once.
CHUNK = 1 << 19

_PAD = b" " * ORDER


def has_letter(text: str) -> bool:
    """Whether a text has a character of Unicode's category L; number signs that look like letters are none."""
    return any(map(str.isalpha, text))


def grams(data: np.ndarray, n: int) -> np.ndarray:
    """Each run of ``n`` bytes as one number, one for every byte past the first ORDER."""
    wide = data.astype(np.uint64)
    out = wide[ORDER:].copy()
    for k in range(1, n):
        out |= wide[ORDER - k : len(wide) - k] << np.uint64(8 * k)
    return out


@dataclass
class Model:
    """Frozen code lengths: ``keys[k]`` are the sorted runs of a context of k bytes and the
    byte after it, ``bits[k]`` their costs by language; ``contexts[k]`` and ``escapes[k]``
    the contexts of k bytes and the cost of escaping from them, zero where unseen."""

    languages: list[str]
    keys: list[np.ndarray]
    bits: list[np.ndarray]
    contexts: list[np.ndarray]
    escapes: list[np.ndarray]

    def costs(self, data: np.ndarray) -> np.ndarray:
        """Bits by language of every byte of ``data`` past the first ORDER."""
        full = grams(data, ORDER + 1)
        out = np.zeros((len(full), len(self.languages)), np.float32)
        rest = np.arange(len(full))
        for k in range(ORDER, -1, -1):
            gram = full[rest] & np.uint64((1 << 8 * (k + 1)) - 1)
            at = np.minimum(np.searchsorted(self.keys[k], gram), len(self.keys[k]) - 1)
            known = self.keys[k][at] == gram
            if k == ORDER:
                out[known] = self.bits[k][at[known]]
            else:
                out[rest[known]] += self.bits[k][at[known]]
            rest, gram = rest[~known], gram[~known] >> np.uint64(8)
            if not len(rest) or not k:
                break
            at = np.minimum(np.searchsorted(self.contexts[k], gram), len(self.contexts[k]) - 1)
            seen = self.contexts[k][at] == gram
            out[rest[seen]] += self.escapes[k][at[seen]]
        return out


def build(counts: pd.DataFrame) -> Model | None:
    """A model from counts ``(lang, k, gram, n)`` of runs of k + 1 bytes."""
    if counts.empty:
        return None
    languages = sorted(counts["lang"].unique())
    keys, bits, contexts, escapes = [], [], [], []
    for k in range(ORDER + 1):
        part = counts[counts["k"] == k]
        gram = part["gram"].to_numpy(np.uint64)
        which = np.searchsorted(languages, part["lang"].to_numpy(object))
        own = np.arange(256, dtype=np.uint64) if k == 0 else np.unique(gram)
        table = np.zeros((len(own), len(languages)))
        table[np.searchsorted(own, gram), which] = part["n"].to_numpy(float)
        context, back = np.unique(own >> np.uint64(8), return_inverse=True)
        total, distinct = np.zeros((2, len(context), len(languages)))
        np.add.at(total, back, table)
        np.add.at(distinct, back, table > 0)
        size = np.maximum(total + distinct, 1)
        escape = np.where(total > 0, -np.log2(np.maximum(distinct, 1) / size), 0.0)
        lower = np.full(table.shape, 8.0)
        if k:
            suffix = own & np.uint64((1 << 8 * k) - 1)
            lower = bits[k - 1][np.searchsorted(keys[k - 1], suffix)]
        hit = -np.log2(np.maximum(table, 1) / size[back])
        keys.append(own)
        bits.append(np.where(table > 0, hit, escape[back] + lower).astype(np.float32))
        contexts.append(context)
        escapes.append(escape.astype(np.float32))
    return Model(languages, keys, bits, contexts, escapes)


def gram_counts(labelled: DataFrame, text_col: str, lang_col: str) -> pd.DataFrame:
    """Counts of all runs of up to ORDER + 1 bytes by language, summed by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for lang, texts in frame.groupby("lang")["text"]:
                found: dict[int, list] = {k: [] for k in range(ORDER + 1)}
                for text in texts:
                    data = np.frombuffer(_PAD + text.encode("utf-8", "surrogatepass"), np.uint8)
                    for k in found:
                        found[k].append(grams(data, k + 1))
                for k, parts in found.items():
                    gram, n = np.unique(np.concatenate(parts), return_counts=True)
                    yield pd.DataFrame({"lang": lang, "k": k, "gram": gram.astype(np.int64), "n": n})

    ship(labelled.sparkSession)
    pairs = labelled.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    each = pairs.mapInPandas(run, "lang string, k int, gram long, n long")
    return each.groupBy("lang", "k", "gram").agg(F.sum("n").alias("n")).toArrow().to_pandas()


def sample_labelled(docs: DataFrame, id_col: str, text_col: str, lang_col: str, per_language: int) -> DataFrame:
    """At most ``per_language`` whole documents of each language, spread by a hash of the id."""
    usable = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    order = F.xxhash64(F.col(id_col).cast("string"))
    cell = F.pmod(order, F.lit(per_language))
    chosen = usable.groupBy(F.col(lang_col).alias("_lang"), cell.alias("_cell")).agg(F.min_by(F.col(id_col), F.struct(order, F.col(id_col))).alias("_id"))
    chosen = chosen.select("_id").distinct()
    return usable.join(F.broadcast(chosen), F.col(id_col) == F.col("_id"), "left_semi")


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = SAMPLE_DOCS) -> Model | None:
    return build(gram_counts(sample_labelled(docs, id_col, text_col, lang_col, per_language), text_col, lang_col))


def score_texts(model: Model | None, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, posterior probability and bits a byte of each text."""
    n = len(texts)
    if model is None:
        return [UNKNOWN] * n, np.zeros(n), np.zeros(n)
    total, size = np.zeros((n, len(model.languages))), np.zeros(n)
    parts: list[bytes] = []
    owners: list[int] = []

    def flush() -> None:
        if not parts:
            return
        data = np.frombuffer(b"".join(parts), np.uint8)
        sums = np.vstack([np.zeros((1, total.shape[1])), np.cumsum(model.costs(data), axis=0, dtype=np.float64)])
        end = np.cumsum([len(p) for p in parts]) - ORDER
        begin = end - np.array([len(p) - ORDER for p in parts])
        np.add.at(total, owners, sums[end] - sums[begin])
        np.add.at(size, owners, end - begin)
        parts.clear()
        owners.clear()

    pending = 0
    for i, text in enumerate(texts):
        if not text or not has_letter(text):
            continue
        data = _PAD + text.encode("utf-8", "surrogatepass")
        for low in range(ORDER, len(data), CHUNK):  # a slice carries the bytes before it as context
            parts.append(data[low - ORDER : low + CHUNK])
            owners.append(i)
            pending += len(parts[-1])
            if pending >= CHUNK:
                flush()
                pending = 0
    flush()
    best = total.argmin(axis=1)
    gap = np.clip(total - total.min(axis=1, keepdims=True), 0, 1000)
    score = 1 / np.exp2(-gap).sum(axis=1)
    known = size > 0
    langs = [model.languages[b] if k else UNKNOWN for b, k in zip(best, known)]
    return langs, np.where(known, score, 0.0), np.where(known, total.min(axis=1) / np.maximum(size, 1), 0.0)


def predict(docs: DataFrame, model: Model | None, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs``' columns ``keep`` (all by default), with ``lang_pred, score, bits_per_byte``.

    ``score`` is the probability of the predicted language among the learned ones.

    * A text that is null or has no letter is ``und`` with score 0, and so is every text
      when nothing could be learned. Texts are scored whole, long ones slice by slice.
    * Repeated rows each have a result; an empty table gives an empty result.
    * Columns of ``docs`` may have any names; those named like one of the three results are replaced by it.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    results = ("lang_pred", "score", "bits_per_byte")
    keep = [c for c in (docs.columns if keep is None else keep) if c not in results]
    work = docs.select(F.col(text_col).alias("_scored"), *[F.col(c).alias(f"_kept{i}") for i, c in enumerate(keep)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, score, bits = score_texts(shared.value, batch.column(0).to_pylist())
            added = [pa.array(langs, pa.string()), pa.array(score, pa.float64()), pa.array(bits, pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *added], names=[*batch.schema.names[1:], *results])

    ship(spark)
    schema = work.drop("_scored").schema.add("lang_pred", "string").add("score", "double").add("bits_per_byte", "double")
    return work.mapInArrow(run, schema).toDF(*keep, *results)


#: A text that its best language codes in more bits a byte than this is no prose of it.
REJECT_BITS = 7.5


def keep_known_language(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """``docs`` without texts of no language; columns unchanged.

    A text goes when it is ``und`` (null, empty or without letters) or is coded worse than
    ``REJECT_BITS`` bits a byte. Repeated rows each stay or go; an empty table stays empty.
    Ties between languages go to the first by name.
    """
    inner, (text,) = plain_names(docs, text_col)
    found = predict(inner, model, text)
    kept = found.where((F.col("lang_pred") != UNKNOWN) & (F.col("bits_per_byte") <= REJECT_BITS))
    return kept.select(*inner.columns).toDF(*docs.columns)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs.where(~held_out(4)).select("doc_id", "text", "lang"))
    found = predict(docs.select("doc_id", held_out(4).alias("held_out"), "text"), model, keep=["doc_id", "held_out"])
    return found.select("doc_id", "held_out", "lang_pred", "score", "bits_per_byte")
