"""Toxicity: a linear classifier of character n-grams scaled by naive Bayes log-count ratios.

A text's features are the character n-grams (3 to 5, word edges included) of its distinct
lower-cased words; a feature's value is the number of those words that hold the n-gram.  On
the labelled sample every feature gets the ratio r = log of its smoothed share among
toxic over its share among other texts; a logistic regression is fitted on r times the
value.  The model is a dictionary of n-gram weights, at most as many as the bounded sample has.

A word's n-gram weights add up to the word's own score, so a text's score is a sum over its
distinct words, and words seen before come from a bounded dictionary in the worker.

Defined results: null and empty texts have no features and get the score of the bias alone;
with no labelled rows, or rows of one class only, every text scores the smoothed share of
class 1, a third if nothing is labelled, so that a filter keeps texts of which nothing is known; repeated rows repeat; labels, source and language are never inputs of a score.
"""

from __future__ import annotations

import math
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import common, labelled
from .linear import minimize, sigmoid, softplus

SIZES = (3, 4, 5)
LEAST_TEXTS = 3
SMOOTHING = 1.0
RIDGE = 0.3
THRESHOLD = 0.5
#: Labelled rows to fit on, at most.
SAMPLE_ROWS = 3000
CACHED_WORDS = 250_000
#: Longer "words" are read in pieces of this length, which bounds a cache entry, not the text.
LONGEST_WORD = 64


def words_of(text: str) -> set[str]:
    """Distinct lower-cased words; very long ones as overlapping pieces, so that no n-gram is lost."""
    words = set(text.lower().split())
    for w in [w for w in words if len(w) > LONGEST_WORD]:
        words.discard(w)
        step = LONGEST_WORD - max(SIZES) + 1
        words.update(w[i : i + LONGEST_WORD] for i in range(0, len(w), step))
    return words


def ngrams(word: str) -> list[str]:
    padded = f" {word} "
    return [padded[i : i + n] for n in SIZES for i in range(len(padded) - n + 1)]


class Model:
    def __init__(self, bias: float, weights: dict[str, float]):
        self.bias, self.weights = bias, weights

    def word(self, word: str) -> float:
        get = self.weights.get
        return sum(get(g, 0.0) for g in ngrams(word))


def gathered(index: np.ndarray, values: np.ndarray, source: np.ndarray, size: int) -> np.ndarray:
    """Sums of ``values[source]`` by ``index``, a million entries at a time."""
    out = np.zeros(size)
    for low in range(0, len(index), 1 << 20):
        part = slice(low, low + (1 << 20))
        out += np.bincount(index[part], values[source[part]], size)
    return out


def fit(texts: list[str], labels: list[int]) -> Model:
    y = np.array(labels, np.float64)
    share = (y.sum() + 0.5) / (len(y) + 1.5)
    prior = math.log(share / (1 - share))
    if not 0 < y.sum() < len(y):
        return Model(prior, {})
    # plain 32-bit arrays and as few objects as can be: this runs on the driver
    word_ids: dict[str, int] = {}
    doc_words, doc_at = array("i"), array("q", [0])
    for text in texts:
        doc_words.extend(word_ids.setdefault(w, len(word_ids)) for w in sorted(words_of(text)))
        doc_at.append(len(doc_words))
    a_col, a_row = np.frombuffer(doc_words, np.int32), np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(np.frombuffer(doc_at, np.int64)))
    gram_ids: dict[str, int] = {}
    grams, gram_at = array("i"), array("q", [0])
    for w in word_ids:
        grams.extend(gram_ids.setdefault(g, len(gram_ids)) for g in set(ngrams(w)))
        gram_at.append(len(grams))
    b_col, b_row = np.frombuffer(grams, np.int32), np.repeat(np.arange(len(word_ids), dtype=np.int32), np.diff(np.frombuffer(gram_at, np.int64)))
    n_words, n_grams = len(word_ids), len(gram_ids)

    def per_gram(doc_values, count):
        return gathered(b_col, gathered(a_col, doc_values, a_row, n_words), b_row, count)

    toxic, other = per_gram(y, n_grams), per_gram(1 - y, n_grams)
    ratio = np.log((toxic + SMOOTHING) / (toxic + SMOOTHING).sum()) - np.log((other + SMOOTHING) / (other + SMOOTHING).sum())
    ratio[toxic + other < LEAST_TEXTS] = 0.0
    kept = np.flatnonzero(ratio)
    used = (ratio != 0)[b_col]
    place = np.zeros(n_grams, np.int32)
    place[kept] = np.arange(len(kept))
    b_col, b_row, ratio = place[b_col[used]], b_row[used], ratio[kept]
    del used, place, toxic, other, grams

    def loss(p):
        weights = p[1:] * ratio
        z = p[0] + gathered(a_row, gathered(b_row, weights, b_col, n_words), a_col, len(y))
        slope = sigmoid(z) - y
        grad = per_gram(slope, len(kept)) * ratio + RIDGE * p[1:]
        return float((softplus(z) - y * z).sum() + RIDGE / 2 * (p[1:] @ p[1:])), np.concatenate([[slope.sum()], grad])

    p = minimize(loss, np.concatenate([[prior], np.zeros(len(kept))]), steps=30, memory=5)
    weights = p[1:] * ratio
    of_gram = np.zeros(n_grams)
    of_gram[kept] = weights
    return Model(float(p[0]), {g: w for g, w in zip(gram_ids, of_gram.tolist()) if w})


_cache: dict = {}


def scores(texts, model: Model) -> np.ndarray:
    """Scores of texts; words' scores come from the worker's dictionary."""
    global _cache
    common.take_over("toxicity")
    if _cache.get("model") is not model:
        _cache = {"model": model, "words": {}}
    known, word = _cache["words"], model.word
    z = np.empty(len(texts))
    for n, text in enumerate(texts):
        words = words_of(text.as_py())
        found = list(map(known.get, words))
        if None in found:
            if len(known) > CACHED_WORDS:
                known.clear()
            for w in words:
                if w not in known:
                    known[w] = word(w)
            found = [known[w] for w in words]
        z[n] = math.fsum(found)  # exact, so that equal texts get equal scores in any set order
    return sigmoid(z + model.bias)


def _score(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.record_batch([batch.column(0), pa.array(scores(batch.column(1), model.value))], names=["doc_id", "score"])


def keep(docs: DataFrame, model: Model) -> DataFrame:
    """The rows, all their columns, whose text scores below ``THRESHOLD``; nothing is shuffled."""
    spark = docs.sparkSession
    common.ship(spark)
    sent = spark.sparkContext.broadcast(model)

    def run(texts: pa.Array) -> pa.Array:
        from linkloom.llm import toxicity

        return pa.array(toxicity.scores(texts, sent.value), pa.float64())

    score = F.arrow_udf(run, "double")(F.coalesce(docs["text"].cast("string"), F.lit("")))
    return docs.where(score < THRESHOLD)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row."""
    spark = docs.sparkSession
    common.ship(spark)
    sent = spark.sparkContext.broadcast(model)

    def run(batches):
        from linkloom.llm.toxicity import _score

        return _score(batches, sent)

    return common.id_text(docs).mapInArrow(run, "doc_id long, score double")


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = SAMPLE_ROWS) -> Model:
    """Fit on at most ``rows`` labelled rows outside the held-out fold."""
    return fit(*labelled.sample(docs, labels, label, rows))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    scored = score(docs, train(docs, labels))
    return scored.select("doc_id", labelled.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
