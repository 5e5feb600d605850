"""Toxicity by a convolutional text classifier, trained and applied in numpy.

A word's embedding is the sum of hashed embeddings of the whole word and of its beginnings, so
inflected forms share what they begin with.  Filters of several widths run over the words of the
whole text, each is pooled by its maximum, and a logistic unit weighs the maxima.  A threshold is
calibrated for each language on rows that the fit has not seen; the language is guessed from the
text's own function words.  Scores are shifted so that every language's threshold lies at
``DECIDE``.  Labels, and the columns lang, source and doc_id, are never inputs of a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import plain_words, text_bytes

DECIDE = 0.7
BEGINNINGS = (None, 4, 5, 6)    # bytes; None: the whole word
BUCKET_BITS, SIZE = 15, 16
LANGUAGE_BITS = BUCKET_BITS * len(BEGINNINGS)
WIDTHS, FILTERS = (1, 2, 3), 8
#: Bounds on the labelled sample that a model is fitted on, per class and per text; scores are for all rows and whole texts.
MAX_TOXIC, MAX_CLEAN, MAX_TRAIN_BYTES = 1_500, 2_500, 65_536
#: Steps of a fit; every batch is half toxic, half clean.
STEPS, BATCH = 1_200, 32

#: Function words from which the language of a text is guessed.
LANGUAGES = {
    "en": "the of and to in that is was for with as on be at by this are from or which",
    "fr": "le la les des et est dans que une pour par sur qui du au avec ce pas plus",
    "de": "der die das und den dem ist nicht von zu mit ein eine auf im sich des als",
    "es": "el los las del que y en una por con para se su al lo como es no",
}


class WordIds(dict):
    """word -> its bucket for each beginning and, above these, a bit for each language that it is a
    function word of, packed into one integer; remembers at most ``limit`` words."""

    def __init__(self, limit: int = 200_000):
        super().__init__()
        self.limit = limit
        self.functions: dict[bytes, int] = {}
        for i, words in enumerate(LANGUAGES.values()):
            for w in words.encode().split():
                self.functions[w] = self.functions.get(w, 0) | 1 << i

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self.functions.get(word, 0) << LANGUAGE_BITS
        for i, n in enumerate(BEGINNINGS):
            value |= (xxhash.xxh3_64_intdigest(word[:n], seed=i) & ((1 << BUCKET_BITS) - 1)) << (BUCKET_BITS * i)
        self[word] = value
        return value

    def ids(self, raw: bytes) -> np.ndarray:
        words = plain_words(raw)
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def language(ids: np.ndarray) -> int:
    """Index into LANGUAGES of the language with most function words; their number if there are none."""
    bits = (ids >> np.uint64(LANGUAGE_BITS)).astype(np.int64)
    seen = [int((bits >> i & 1).sum()) for i in range(len(LANGUAGES))]
    return int(np.argmax(seen)) if any(seen) else len(LANGUAGES)


def buckets(ids: np.ndarray) -> list[np.ndarray]:
    """Rows of the embedding table for each beginning."""
    ids = (ids & np.uint64((1 << LANGUAGE_BITS) - 1)).astype(np.int64)
    return [(ids >> (BUCKET_BITS * i) & (1 << BUCKET_BITS) - 1) + (i << BUCKET_BITS) for i in range(len(BEGINNINGS))]


@dataclass
class Model:
    embed: np.ndarray           # (len(BEGINNINGS) << BUCKET_BITS, SIZE)
    filters: list[np.ndarray]   # per width: (width, SIZE, FILTERS)
    weights: np.ndarray         # (len(WIDTHS) * FILTERS,)
    bias: float
    thresholds: np.ndarray      # logit per language, and for none

    def vectors(self, ids: np.ndarray) -> np.ndarray:
        return sum(self.embed[b] for b in buckets(ids))

    def pooled(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Maxima over the text of all filters, at least 0, and where they are (-1: nowhere)."""
        best = np.zeros(len(WIDTHS) * FILTERS, np.float32)
        place = np.full(len(best), -1)
        for k, (width, f) in enumerate(zip(WIDTHS, self.filters)):
            n = len(x) - width + 1
            if n <= 0:
                continue
            y = x[:n] @ f[0]
            for j in range(1, width):
                y += x[j:j + n] @ f[j]
            at = y.argmax(axis=0)
            top = y[at, np.arange(FILTERS)]
            part = slice(k * FILTERS, (k + 1) * FILTERS)
            best[part] = np.maximum(top, 0)
            place[part] = np.where(top > 0, at, -1)
        return best, place

    def logit(self, ids: np.ndarray, step: int = 4096) -> float:
        """Pieces of ``step`` words that overlap by the widest filter bound the memory for long texts."""
        best = np.zeros(len(WIDTHS) * FILTERS, np.float32)
        for i in range(0, max(len(ids), 1), step):
            best = np.maximum(best, self.pooled(self.vectors(ids[i:i + step + max(WIDTHS) - 1]))[0])
        return float(best @ self.weights + self.bias)

    def score(self, raw: bytes, words: WordIds) -> float:
        ids = words.ids(raw)
        z = self.logit(ids) - self.thresholds[language(ids)] + np.log(DECIDE / (1 - DECIDE))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def fit(texts: list[bytes], toxic: np.ndarray, seed: int = 7) -> Model:
    """Adagrad on the logistic loss; every fifth text only calibrates the thresholds."""
    rng = np.random.default_rng(seed)
    model = Model((rng.standard_normal((len(BEGINNINGS) << BUCKET_BITS, SIZE)) * 0.1).astype(np.float32),
                  [(rng.standard_normal((w, SIZE, FILTERS)) / np.sqrt(w * SIZE)).astype(np.float32) for w in WIDTHS],
                  np.zeros(len(WIDTHS) * FILTERS, np.float32) + 0.1, 0.0, np.zeros(len(LANGUAGES) + 1))
    words = WordIds()
    ids = [words.ids(t) for t in texts]
    y = np.asarray(toxic, np.float32)
    order = rng.permutation(len(texts))
    train, held = order[len(order) // 5:], order[:len(order) // 5]
    if not len(train) or y[train].min() == y[train].max():
        model.weights[:] = 0
        model.bias = -4.0 if not len(train) or y[train].max() < 1 else 4.0
        return model
    seen = [np.full_like(p, 1e-6) for p in (model.embed, *model.filters, model.weights)]
    seen_bias = 1e-6
    classes = [train[y[train] == k] for k in (1, 0)]
    for step in range(STEPS):
        rate = 0.15 / (1 + 3 * step / STEPS)
        batch = np.concatenate([c[rng.integers(0, len(c), BATCH // 2)] for c in classes])
        g_filters = [np.zeros_like(f) for f in model.filters]
        g_weights, g_bias = np.zeros_like(model.weights), 0.0
        rows, grads = [], []
        for i in batch:
            x = model.vectors(ids[i])
            best, place = model.pooled(x)
            p = 1 / (1 + np.exp(-(best @ model.weights + model.bias)))
            d = (p - y[i]) / len(batch)
            g_weights += d * best
            g_bias += d
            for k, width in enumerate(WIDTHS):
                for c in range(FILTERS):
                    at = place[k * FILTERS + c]
                    if at < 0:
                        continue
                    own = d * model.weights[k * FILTERS + c]
                    g_filters[k][:, :, c] += own * x[at:at + width]
                    for b in buckets(ids[i][at:at + width]):
                        rows.append(b)
                        grads.append(own * model.filters[k][:, :, c])
        for p, s, g in zip((*model.filters, model.weights), seen[1:], (*g_filters, g_weights)):
            s += g * g
            p -= rate * 0.3 * g / np.sqrt(s)
        seen_bias += g_bias * g_bias
        model.bias -= rate * 0.3 * g_bias / np.sqrt(seen_bias)
        if rows:
            at, inverse = np.unique(np.concatenate(rows), return_inverse=True)
            g = np.zeros((len(at), SIZE), np.float32)
            np.add.at(g, inverse, np.concatenate(grads))
            seen[0][at] += g * g
            model.embed[at] -= rate * g / np.sqrt(seen[0][at])
    z = np.array([model.logit(ids[i]) for i in held])
    spoken = np.array([language(ids[i]) for i in held])
    overall = threshold(z, y[held])
    for i in range(len(LANGUAGES) + 1):
        own = spoken == i
        model.thresholds[i] = threshold(z[own], y[held][own]) if y[held][own].sum() >= 10 else overall
    return model


def threshold(z: np.ndarray, y: np.ndarray) -> float:
    """The logit with the best F measure that weighs precision double, in the middle between the logits around it;
    0 without both classes."""
    if not len(y) or y.min() == y.max():
        return 0.0
    by = np.argsort(-z)
    z, y = z[by], y[by]
    hit = np.cumsum(y)
    f = 1.25 * hit / (np.arange(1, len(y) + 1) + 0.25 * y.sum())
    f[:-1][z[:-1] == z[1:]] = 0
    i = int(np.argmax(f))
    return float(z[i] if i + 1 == len(z) else (z[i] + z[i + 1]) / 2)


def learns(doc_id: str = "doc_id") -> F.Column:
    """Rows whose labels may be learned: crc32 of doc_id as text, modulo 3, is not 1."""
    return ~held_out(doc_id)


def held_out(doc_id: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from a bounded sample of labelled rows, taken by hash of doc_id within each class."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & learns()).select("doc_id", F.col("toxic").cast("int").alias("y"))
    picks = [known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for y, n in ((1, MAX_TOXIC), (0, MAX_CLEAN))]
    sample = F.broadcast(picks[0].union(picks[1]))  # at most MAX_TOXIC + MAX_CLEAN rows of two numbers
    rows = (docs.select("doc_id", text_bytes().alias("t")).where(F.length("t") <= MAX_TRAIN_BYTES).join(sample, "doc_id")
            .orderBy(F.xxhash64("doc_id"), "doc_id", "t").limit(MAX_TOXIC + MAX_CLEAN).collect())
    return fit([bytes(r["t"]) for r in rows], np.array([r["y"] for r in rows], np.float32))


def score_documents(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """``docs`` with the toxicity score of every whole text (null: empty) as a further column.

    Row by row in one pass, without a shuffle; tasks hold the model, whose size is fixed."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordIds()
        for batch in batches:
            scores = pa.array([held.value.score(x.as_py(), words) for x in batch.column(len(names))], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], scores], [*names, column])

    schema = T.StructType([T.StructField(f.name, f.dataType) for f in docs.schema.fields] + [T.StructField(column, T.DoubleType())])
    return docs.select("*", text_bytes().alias("__text")).mapInArrow(score, schema)
