"""Quality: Bradley-Terry scores learned from preference pairs, cut at a score quantile.

A document's score is linear in surface features of its whole text.  The weights minimise the
logistic loss of feature differences over pairs of a better and a worse document, i.e.
P(i over j) = 1 / (1 + exp(s_j - s_i)).  Every labelled row outside the held-out fold counts: up to
``TOGETHER`` rows are fitted on pairs drawn from all of them, more are dealt into groups where each better row
meets each worse one.  The cut is the quantile of all these rows' scores at the share labelled 0, in the middle of the gap it falls into.
Scores are reported as a rising map to 0..1 in which the cut is ``THRESHOLD``.

Defined results: null and empty texts have all features zero; with no labelled rows, or rows of
one class only, all weights are zero and every text scores above the cut; repeated rows
repeat; labels, source and language are never inputs of a score.
"""

from __future__ import annotations

import operator
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import common, labelled
from .linear import minimize, sigmoid, softplus

THRESHOLD = 0.3
PAIRS = 40_000
#: Labelled rows of which the features are fitted on the driver, at most; more are fitted where they lie.
TOGETHER = 6000
#: Rows of a group, and rows of the rarer class in it at least (rows of that class recur in several groups).
GROUP, RARER = 512, 64
#: Different scores that reach the driver at once when the cut is looked for.
SCORES = 50_000
RIDGE = 1e-3
SEED = 7
_UPPER = string.ascii_uppercase.encode()
_DIGITS = string.digits.encode()
_MARKS = b"!?"
#: Marks of prose; other ASCII punctuation counts as symbols.
_SYMBOLS = bytes(c for c in string.punctuation.encode() if c not in b".,;:'\"!?()-")
FEATURES = ("symbols", "upper", "digits", "marks", "repeats", "distinct", "lines", "bare", "word_length", "size")


def features(text: str) -> tuple[float, ...]:
    """Shares of symbols, capitals, digits and marks among bytes; repeated neighbours, distinct words, repeated lines, bare words; mean word length; log size."""
    raw = text.encode("utf-8", "replace")
    if not raw:
        return (0.0,) * len(FEATURES)
    n = len(raw)
    words = raw.split()
    m = len(words) or 1
    lines = raw.split(b"\n")
    count = lambda chars: n - len(raw.translate(None, chars))
    distinct = set(words)
    repeats = sum(map(operator.eq, words, words[1:])) / m
    bare = sum(words.count(w) for w in distinct if len(w) == 1 and w in b"|%*#&$~^_=+<>/\\@-") / m
    return (count(_SYMBOLS) / n, count(_UPPER) / n, count(_DIGITS) / n, count(_MARKS) / n, repeats, len(distinct) / m, 1 - len(set(lines)) / len(lines), bare, min(n / m, 40.0) / 10, np.log1p(m) / 10)


def expand(f: np.ndarray) -> np.ndarray:
    """Each share with its root, and steps at a few values, so that linear scores can bend."""
    shares = f[:, :8]
    expected = np.clip(1.15 - 0.75 * f[:, 9], 0.1, 1.0)  # distinct words thin out in long texts
    steps = [(shares[:, [k]] > at).astype(float) for k in (0, 1, 3, 4, 7) for at in (0.01, 0.05)]
    return np.hstack([f, np.sqrt(shares), (f[:, [5]] - expected[:, None]), *steps])


class Model:
    def __init__(self, mean: np.ndarray, spread: np.ndarray, weights: np.ndarray, cut: float, scale: float):
        self.mean, self.spread, self.weights, self.cut, self.scale = mean, spread, weights, cut, scale

    def raw(self, f: np.ndarray) -> np.ndarray:
        return ((expand(f) - self.mean) / self.spread) @ self.weights

    def score(self, f: np.ndarray) -> np.ndarray:
        shift = np.log(THRESHOLD / (1 - THRESHOLD))
        return sigmoid((self.raw(f) - self.cut) * self.scale + shift)


def fit(texts: list[str], labels: list[int], pairs: int = PAIRS, seed: int = SEED) -> Model:
    return fit_features(np.array([features(t) for t in texts], np.float64).reshape(len(texts), len(FEATURES)), labels, pairs, seed)


def fit_features(f: np.ndarray, labels: list[int], pairs: int = PAIRS, seed: int = SEED) -> Model:
    y = np.array(labels, np.int64)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    width = expand(np.zeros((1, len(FEATURES)))).shape[1]
    if not len(good) or not len(bad):
        return Model(np.zeros(width), np.ones(width), np.zeros(width), -1.0, 1.0)
    x = expand(f)
    mean, spread = x.mean(0), x.std(0) + 1e-6
    x = (x - mean) / spread
    rng = np.random.default_rng(seed)
    better, worse = rng.choice(good, pairs), rng.choice(bad, pairs)
    d = x[better] - x[worse]

    def loss(w):
        z = d @ w
        return float(softplus(-z).mean() + RIDGE / 2 * (w @ w)), -(sigmoid(-z) @ d) / len(d) + RIDGE * w

    w = minimize(loss, np.zeros(width), steps=100)
    s = np.sort(x @ w)
    k = min(len(s) - 1, max(1, len(bad)))
    cut = (s[k - 1] + s[k]) / 2
    return Model(mean, spread, w, float(cut), 4.0 / max(1e-6, float(s.std())))


def _score(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    common.take_over("quality")
    for batch in batches:
        if batch.num_rows:
            f = np.array([features(t.as_py()) for t in batch.column(1)])
            yield pa.record_batch([batch.column(0), pa.array(model.score(f))], names=["doc_id", "score"])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row."""
    common.ship(docs.sparkSession)

    def run(batches):
        from linkloom.llm.quality import _score

        return _score(batches, model)

    return common.id_text(docs).mapInArrow(run, "doc_id long, score double")


def score_column(text: Column, model: Model) -> Column:
    """The score of a text column, for decisions on whole rows where they lie."""

    def run(texts: pa.Array) -> pa.Array:
        from linkloom.llm import common, quality

        common.take_over("quality")
        return pa.array(model.score(np.array([quality.features(t.as_py()) for t in texts]).reshape(len(texts), -1)), pa.float64())

    return F.arrow_udf(run, "double")(F.coalesce(text.cast("string"), F.lit("")))


def keep(docs: DataFrame, model: Model) -> DataFrame:
    """The rows, all their columns, whose text scores at least ``THRESHOLD``; nothing is shuffled."""
    common.ship(docs.sparkSession)
    return docs.where(score_column(docs["text"], model) >= THRESHOLD)


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    common.take_over("quality")
    for batch in batches:
        if batch.num_rows:
            f = pa.array([list(map(float, features(t.as_py()))) for t in batch.column(1)], pa.list_(pa.float64()))
            yield pa.record_batch([batch.column(0), f], names=["k", "f"])


def labelled_features(docs: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """(k, f, y) of every labelled document outside the held-out fold; of several rows of an id the one with the smallest text.

    Features are joined with labels, so no text is shuffled but those of repeated ids.
    """
    common.ship(docs.sparkSession)

    def run(batches):
        from linkloom.llm.quality import _featured

        return _featured(batches)

    rows = common.id_text(docs).where(F.col("doc_id").isNotNull() & ~labelled.held_out(F.col("doc_id")))
    again = common.persist_table(rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id"))
    if not again.isEmpty():
        repeated = rows.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
        rows = rows.join(again, "doc_id", "left_anti").unionByName(repeated)
    return common.persist_table(rows.mapInArrow(run, "k long, f array<double>").join(labelled.marks(labels, label), "k"))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))


def _packed(table: pa.Table) -> pa.Table:
    """A group's features of rows labelled 1 and 0, as bytes."""
    f, y = _matrix(table["f"]), table["y"].to_numpy()
    return pa.table({"good": [f[y == 1].tobytes()], "bad": [f[y == 0].tobytes()]})


def _summed(batches: Iterator[pa.RecordBatch], of) -> Iterator[pa.RecordBatch]:
    """One row of a task: the sum of ``of`` (a vector) over its batches."""
    total = None
    for batch in batches:
        if batch.num_rows:
            now = of(batch)
            total = now if total is None else total + now
    if total is not None:
        yield pa.record_batch([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["v"])


def _total(rows: DataFrame, of) -> np.ndarray:
    def run(batches):
        from linkloom.llm.quality import _summed

        return _summed(batches, of)

    return np.sum([r["v"] for r in rows.mapInArrow(run, "v array<double>").collect()], axis=0)  # a vector for each task


def _moments(batch: pa.RecordBatch) -> np.ndarray:
    x = expand(_matrix(batch.column(0)))
    return np.concatenate([x.sum(0), (x * x).sum(0)])


def _pair_loss(batch: pa.RecordBatch, mean: np.ndarray, spread: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Pairs, loss, gradient and second derivatives of groups, all pairs of a group's better and worse rows."""
    out, d = np.zeros(2 + len(w) + len(w) ** 2), len(w)
    for cells in zip(*(batch.column(c) for c in (0, 1))):
        x, y = ((expand(np.frombuffer(c.as_py(), np.float64).reshape(-1, len(FEATURES))) - mean) / spread for c in cells)
        for lo in range(0, len(x), GROUP):
            part = x[lo : lo + GROUP]
            z = (part @ w)[:, None] - (y @ w)[None, :]
            p = sigmoid(-z)
            q = p * (1 - p)
            cross = part.T @ q @ y
            out[0] += z.size
            out[1] += softplus(-z).sum()
            out[2 : 2 + d] += p.sum(0) @ y - p.sum(1) @ part
            out[2 + d :] += ((part.T * q.sum(1)) @ part + (y.T * q.sum(0)) @ y - cross - cross.T).ravel()
    return out


def _counts(s: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """How many values lie below each edge, and at or below the last."""
    s = np.sort(s)
    return np.concatenate([np.searchsorted(s, edges, "left"), np.searchsorted(s, edges[-1:], "right")]).astype(float)


def _different(batches: Iterator[pa.RecordBatch], raw, lo: float, hi: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        s = raw(_matrix(batch.column(0)))
        values, times = np.unique(s[(s >= lo) & (s <= hi)], return_counts=True)
        yield pa.record_batch([pa.array(values), pa.array(times, pa.int64())], names=["s", "n"])


def _ranked(rows: DataFrame, raw, lo: float, hi: float, rank: int) -> float:
    """The value of that rank (from 0) among all rows' scores, exactly: ranges narrow until few different scores are left."""

    def run(batches):
        from linkloom.llm.quality import _different

        return _different(batches, raw, lo, hi)

    while True:
        found = rows.mapInArrow(run, "s double, n long").groupBy("s").agg(F.sum("n").alias("n"))
        edges = np.linspace(lo, hi, 1025)
        below = _total(rows, lambda batch, edges=edges: _counts(raw(_matrix(batch.column(0))), edges))
        if below[-1] - below[0] <= SCORES or hi - lo <= 1e-12 * (abs(lo) + abs(hi)):
            at = below[0]
            for s, n in sorted(map(tuple, found.collect())):  # at most SCORES, or what differs in the last digits alone
                at += n
                if at > rank:
                    return s
        spot = min(int(np.searchsorted(below[:-1], rank, "right")), len(edges) - 1)
        lo, hi = float(edges[spot - 1]), float(edges[spot])


def _extent(batches: Iterator[pa.RecordBatch], raw) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            s = raw(_matrix(batch.column(0)))
            yield pa.record_batch([pa.array([v]) for v in (s.sum(), (s * s).sum(), s.min(), s.max())], names=["total", "squares", "low", "high"])


def _spread(rows: DataFrame, raw) -> tuple[float, float, float, float]:
    """Sum, sum of squares, smallest and largest of all rows' scores."""

    def run(batches):
        from linkloom.llm.quality import _extent

        return _extent(batches, raw)

    return tuple(rows.mapInArrow(run, "total double, squares double, low double, high double").agg(F.sum("total"), F.sum("squares"), F.min("low"), F.max("high")).first())


def fit_rows(rows: DataFrame, good: int, bad: int) -> Model:
    """The model of rows (k, f, y) of both classes, however many, fitted where they lie by Newton steps, each a job that gives the driver a sum for each task."""
    n = good + bad
    groups = -(-n // GROUP)
    rare, fewer = (1, good) if good < bad else (0, bad)
    times = min(groups, -(-RARER * groups // fewer))
    copies = F.explode(F.sequence(F.lit(0), F.when(F.col("y") == rare, times - 1).otherwise(0)))
    dealt = rows.select("k", "f", "y", copies.alias("copy")).select("f", "y", F.pmod(F.pmod(F.xxhash64("k"), F.lit(groups)) + F.col("copy"), F.lit(groups)).alias("g"))

    def pack(table):
        from linkloom.llm.quality import _packed

        return _packed(table)

    packed = common.persist_table(dealt.groupBy("g").applyInArrow(pack, "good binary, bad binary"))
    only = rows.select("f")
    sums = _total(only, _moments)
    width = len(sums) // 2
    mean = sums[:width] / n
    spread = np.sqrt(np.maximum(sums[width:] / n - mean**2, 0)) + 1e-6

    def loss(w):
        got = _total(packed, lambda batch: _pair_loss(batch, mean, spread, w))
        grad, bend = got[2 : 2 + width] / got[0], got[2 + width :].reshape(width, width) / got[0]
        return got[1] / got[0] + RIDGE / 2 * (w @ w), grad + RIDGE * w, bend + RIDGE * np.eye(width)

    w = np.zeros(width)
    value, grad, bend = loss(w)
    for _ in range(25):
        way, size = np.linalg.solve(bend, grad), 1.0
        if np.abs(grad).max() < 1e-6:
            break
        while (new := loss(w - size * way))[0] > value - 1e-4 * size * (grad @ way) and size > 1e-4:
            size /= 2
        if new[0] >= value:
            break
        w, (value, grad, bend) = w - size * way, new
    raw = Model(mean, spread, w, 0.0, 1.0).raw

    total, squares, low, high = _spread(only, raw)
    k = min(n - 1, max(1, bad))
    cut = (_ranked(only, raw, low, high, k - 1) + _ranked(only, raw, low, high, k)) / 2
    return Model(mean, spread, w, float(cut), 4.0 / max(1e-6, float(np.sqrt(max(0.0, squares / n - (total / n) ** 2)))))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Model:
    """Fit on all labelled rows outside the held-out fold."""
    rows = labelled_features(docs, labels, label)
    counts = dict(map(tuple, rows.groupBy((F.col("y") == 1).alias("good")).count().collect()))
    good, bad = counts.get(True, 0), counts.get(False, 0)
    if good + bad > TOGETHER and good and bad:
        return fit_rows(rows.withColumn("y", (F.col("y") == 1).cast("int")), good, bad)
    few = rows.orderBy("k").collect() if good + bad <= TOGETHER else rows.limit(1).collect()  # one class only: no weights, whatever the rows
    return fit_features(np.array([r["f"] for r in few], np.float64).reshape(len(few), len(FEATURES)), [r["y"] for r in few])


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    scored = score(docs, train(docs, labels))
    return scored.select("doc_id", labelled.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
