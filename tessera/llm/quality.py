"""Quality classifier: a linear hinge-loss model over n-grams scaled by naive Bayes log-count ratios.

A text's features are the distinct hashed n-grams of its words (single words and pairs) and of their
shapes (single shapes and pairs; a shape writes a run of capitals as X, of other letters as x, of
digits as 9), and the patterns AA, A.A and AAA of words that repeat at once, whichever words they
are. An indicator is scaled
by r = log of the ratio of its smoothed shares in both classes, the vector is scaled to length one,
and a linear model with hinge loss is fitted by dual coordinate descent. Margins become
probabilities by a logistic curve fitted to margins of rows left out.

The fit uses a bounded sample (``PER_CLASS`` labelled rows of each class, the first by a hash of
their ids); the classes' true shares, counted over all labels, weigh the curve. Everything else sees
every row and the whole text.

Defined cases: a null or empty text has no features and scores the curve at the bias; labels other
than 0 and 1 and null ids teach nothing; with labels of one class only every score is that class;
repeated rows are scored alike; an empty table gives no rows; other columns pass through ``keep_good``
untouched, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.text import U64, chunks, free_name, held_out, walk

BITS = 18
PER_CLASS = 2500
THRESHOLD = 0.7
COST, EPOCHS, FOLDS = 1.0, 12, 3
_RUNS = re.compile(r"[^\W\d_]+|\d+")
_SALTS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], dtype=U64)

#: Names of the word patterns AA, A.A and AAA.
_REPEATS = np.arange(1, 4, dtype=U64) * _SALTS[0]


def _shape(word: str) -> str:
    out = _RUNS.sub(lambda m: "9" if m[0][0].isdigit() else "X" if m[0].isupper() else "Xx" if m[0][0].isupper() else "x", word)
    return re.sub(r"([^Xx9])\1+", r"\1\1", out)[:12]


class Features:
    """Distinct hashed n-grams of a text; remembers the hashes of words it has met."""

    def __init__(self, bits: int = BITS) -> None:
        self.shift, self.known = U64(64 - bits), {}

    def _hashes(self, word: str) -> tuple[int, int]:
        return xxhash.xxh3_64_intdigest(word.lower()), xxhash.xxh3_64_intdigest("\0" + _shape(word))

    def of(self, text: str) -> np.ndarray:
        words = text.split()
        if not words:
            return np.zeros(0, np.int64)
        known = self.known
        if len(known) > 80_000:
            known.clear()
        pairs = []
        for w in words:
            x = known.get(w)
            if x is None:
                x = known[w] = self._hashes(w)
            pairs.append(x)
        h = np.array(pairs, dtype=U64)
        word, shape = h[:, 0], h[:, 1]
        parts = [word * _SALTS[0], shape * _SALTS[1]]
        parts += [(x[:-1] * salt + x[1:]) * _SALTS[0] for x, salt in ((word, _SALTS[2]), (shape, _SALTS[3]))]
        again = [word[k:] == word[:-k] for k in (1, 2)]
        repeats = [again[0].any(), again[1].any(), len(word) > 2 and (again[0][1:] & again[0][:-1]).any()]
        parts.append(_REPEATS[repeats])
        return np.unique(np.concatenate(parts) >> self.shift).astype(np.int64)


@dataclass
class Model:
    """weights hold w * r; a text's margin is sum(weights) / norm(ratios) + bias."""

    weights: np.ndarray
    ratios: np.ndarray
    bias: float
    slope: float
    intercept: float

    def margin(self, features: np.ndarray) -> float:
        if not len(features):
            return self.bias
        r = self.ratios[features]
        norm = float(np.sqrt(r @ r))
        return float(self.weights[features].sum()) / norm + self.bias if norm else self.bias

    def score(self, features: np.ndarray) -> float:
        return float(1.0 / (1.0 + np.exp(-np.clip(self.slope * self.margin(features) + self.intercept, -30, 30))))


def _ratios(rows: list[np.ndarray], y: np.ndarray, size: int) -> np.ndarray:
    p, q = np.ones(size), np.ones(size)
    for x, good in zip(rows, y, strict=True):
        (p if good else q)[x] += 1
    return np.log((p / p.sum()) / (q / q.sum()))


def _descend(rows: list[np.ndarray], y: np.ndarray, size: int, cost: float, epochs: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Dual coordinate descent for hinge loss; returns w * r, r and the bias (a constant feature)."""
    r = _ratios(rows, y, size)
    sign = np.where(y, 1.0, -1.0)
    values = []
    for x in rows:
        v = r[x]
        n = np.sqrt(v @ v)
        values.append(v / n if n else v)
    square = [float(v @ v) + 1.0 for v in values]
    w, bias, alpha = np.zeros(size), 0.0, np.zeros(len(rows))
    order = np.arange(len(rows))
    rng = np.random.default_rng(7)
    for _ in range(epochs):
        rng.shuffle(order)
        for i in order:
            x, v, s = rows[i], values[i], sign[i]
            gradient = s * (float(w[x] @ v) + bias) - 1.0
            new = min(max(alpha[i] - gradient / square[i], 0.0), cost)
            step = (new - alpha[i]) * s
            if step:
                alpha[i] = new
                w[x] += step * v
                bias += step
    return w * r, r, bias


def _curve(margins: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of a logistic curve, by Newton steps on smoothed targets."""
    targets = np.where(y, 1 - 1e-3, 1e-3)
    x = np.stack([margins, np.ones_like(margins)], 1)
    b = np.array([2.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        grad = x.T @ (weight * (p - targets)) + 1e-3 * b
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        b -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(b[0]), float(b[1])


def train(rows: list[np.ndarray], y: np.ndarray, good_share: float, bits: int = BITS, cost: float = COST, epochs: int = EPOCHS, folds: int = FOLDS) -> Model:
    """Fits the model on feature rows in a fixed order; good_share is the share of label 1 among all labels."""
    size = 1 << bits
    if len(rows) == 0 or y.all() or not y.any():
        return Model(np.zeros(size), np.zeros(size), 0.0, 0.0, 30.0 if len(rows) and y.all() else -30.0 if len(rows) else 0.0)
    margins = np.zeros(len(rows))
    fold = np.arange(len(rows)) % folds
    for k in range(folds):
        rest = np.flatnonzero(fold != k)
        if y[rest].all() or not y[rest].any():
            continue
        part = Model(*_descend([rows[i] for i in rest], y[rest], size, cost, epochs), 1.0, 0.0)
        for i in np.flatnonzero(fold == k):
            margins[i] = part.margin(rows[i])
    weight = np.where(y, good_share / y.mean(), (1 - good_share) / (1 - y.mean()))
    return Model(*_descend(rows, y, size, cost, epochs), *_curve(margins, y, weight))


def _features_frame(docs: DataFrame) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in chunks(batches, "text"):
            rows = [features.of(t or "").astype(np.int32) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.list_(pa.int32()))], names=["doc_id", "quality", "features"])

    return walk(docs.select("doc_id", "quality", "text"), run, "doc_id long, quality int, features array<int>")


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", per_class: int = PER_CLASS) -> Model:
    """Fits on at most ``per_class`` labelled documents of each class outside the held-out fold."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("quality"))
    known = known.filter("doc_id is not null and quality in (0, 1)").filter(~held_out(F.col("doc_id")))
    share = known.agg(F.coalesce(F.avg("quality"), F.lit(0.5))).first()[0]
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    sample = [known.filter(F.col("quality") == c).distinct().orderBy(*order).limit(per_class) for c in (0, 1)]
    # at most 2 * per_class ids and labels, hence the broadcast
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample[0].unionByName(sample[1])), "doc_id")
    found = _features_frame(chosen).toArrow()
    ids, good, features = found.column("doc_id").to_numpy(), found.column("quality").to_numpy() == 1, found.column("features").combine_chunks()
    at, values = features.offsets.to_numpy(), features.values.to_numpy()
    rows = np.random.default_rng(11).permutation(len(ids))
    rows = np.lexsort((good, ids))[rows]
    return train([values[at[k] : at[k + 1]] for k in rows], good[rows], float(share))


def score(docs: DataFrame, model: Model, name: str, text_col: str = "text") -> DataFrame:
    """``docs`` with the score of every whole text in a new column ``name``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    out = docs.withColumn(name, F.lit(0.0))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, m = Features(), shared.value
        for batch in chunks(batches, text_col):
            names = batch.schema.names
            scores = [m.score(features.of(t or "")) for t in batch.column(names.index(text_col)).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(scores, pa.float64()) if n == name else batch.column(k) for k, n in enumerate(names)], names=names)

    return walk(out, run, out.schema)


def predict(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    scored = score(docs.select("doc_id", "text"), fit(docs, labels), "score")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the classifier doesn't reject, with their columns."""
    name = free_name(docs.columns, "score")
    return score(docs, fit(docs, labels), name).filter(F.col(name) >= threshold).drop(name)
