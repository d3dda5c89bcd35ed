"""Document quality by Naive Bayes support vectors (operator 1).

Indicators of a text (present or not, hashed to ``FEATURES`` numbers):

* one to three consecutive word shapes, a shape being the word's run-length
  collapsed classes (``a`` lower-case or non-ASCII, ``A`` upper-case, ``0``
  digit, other ASCII characters themselves), or ``=`` where a word equals
  the one before;
* one and two consecutive words.

An indicator's value is its class log-count ratio of multinomial Naive Bayes;
a text's values are scaled to length 1, so that long texts do not weigh more.
A linear hinge-loss model is fitted on them by dual coordinate descent (with
a bias and per-class costs), and a logistic curve on documents held back
turns margins into probabilities.  At most ``MAX_DOCS`` labelled documents
(of either label those of smallest id hash) are used, in a task of their own; every
text is scored whole.

Null, empty and space-only texts have no indicator and score by the bias;
repeated rows score alike; with no or one class in training every text scores
that class's share (0.5 without rows); a document whose label rows disagree
is not used for training; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenlake.llm.words import Words, gather, mix, word_blocks

FEATURES = 1 << 18
MAX_DOCS = 8_000          # half of them of either label
HELD_BACK = 4             # every fourth document of the sample fits the logistic curve
COST, ROUNDS = 1.0, 12
SMOOTH = 1.0
THRESHOLD = 0.7

_CLASS = np.arange(256, dtype=np.uint64)
_CLASS[97:123] = 97
_CLASS[128:] = 97
_CLASS[65:91] = 65
_CLASS[48:58] = 48


def _shapes(block: Words) -> np.ndarray:
    """Hash of every word's shape; words equal to the one before get one value of their own."""
    size = block.ends - block.starts
    at = gather(block.starts, size)                      # the bytes of all words
    word = np.repeat(np.arange(len(size)), size)
    data = _CLASS[block.data[at]]
    new = np.ones(len(data), bool)
    new[1:] = (data[1:] != data[:-1]) | (word[1:] != word[:-1])
    edge = np.concatenate(([0], np.cumsum(size)))
    place = np.cumsum(new)
    place = place - place[edge[:-1]][word]               # of a class in its word's shape
    term = mix(mix(place.astype(np.uint64)) + data) * new
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(term, dtype=np.uint64)))
    shape = mix(total[edge[1:]] - total[edge[:-1]])
    same = np.zeros(len(shape), bool)
    same[1:] = block.hashes[1:] == block.hashes[:-1]
    same[block.first[:-1][block.counts > 0]] = False
    shape[same] = np.uint64(61)
    return shape


def indicators(block: Words) -> list[np.ndarray]:
    """Feature numbers of every document of a block (with repeats)."""
    if not len(block.hashes):
        return [np.zeros(0, np.int64) for _ in block.counts]
    kinds = []
    for values, longest, salt in ((_shapes(block), 3, 11), (block.hashes, 2, 17)):        # shapes, words
        code = np.zeros(len(values), np.uint64)
        for n in range(1, longest + 1):
            # the n-gram that ends at a word; those over a document's start are cut below
            code = mix(np.concatenate((np.zeros(1, np.uint64), code[:-1])) + values + np.uint64(salt)) if n > 1 else mix(values + np.uint64(salt))
            kinds.append((n, (mix(code ^ np.uint64(salt * 64 + n)) % np.uint64(FEATURES)).astype(np.int64)))
    out = []
    for lo, hi in zip(block.first[:-1].tolist(), block.first[1:].tolist()):
        out.append(np.concatenate([f[lo + n - 1:hi] for n, f in kinds]) if hi > lo else np.zeros(0, np.int64))
    return out


class Model:
    """Weights of the scaled indicators, bias, and the logistic curve."""

    def __init__(self, ratio: np.ndarray, weights: np.ndarray, bias: float, slope: float, shift: float):
        self.ratio, self.weights, self.bias, self.slope, self.shift = ratio, weights, bias, slope, shift

    def margins(self, texts: pa.Array) -> np.ndarray:
        out, seen = [], np.zeros(FEATURES, bool)
        gain, square = (self.weights * self.ratio).astype(np.float64), (self.ratio * self.ratio).astype(np.float64)
        for _, _, block in word_blocks(texts, lower=False):
            for f in indicators(block):
                seen[f] = True
                own = np.flatnonzero(seen)
                seen[own] = False
                size = square[own].sum()
                out.append(self.bias + (gain[own].sum() / np.sqrt(size) if size > 0 else 0.0))
        return np.array(out)

    def scores(self, texts: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(texts) + self.shift, -40, 40)))


def log_count_ratio(docs: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """Log of the smoothed share of every indicator in class 1 over that in class 0."""
    count = np.full((2, FEATURES), SMOOTH)
    for f, y in zip(docs, labels):
        count[y, f] += 1
    share = count / count.sum(1, keepdims=True)
    return np.log(share[1] / share[0]).astype(np.float32)


def dual_descent(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, cost: float = COST, rounds: int = ROUNDS,
                 seed: int = 3) -> tuple[np.ndarray, float]:
    """Weights and bias of the L2-regularised hinge loss by dual coordinate descent; the bias is one more feature of value 1."""
    rng = np.random.default_rng(seed)
    w, bias = np.zeros(FEATURES), 0.0
    y = np.where(labels == 1, 1.0, -1.0)
    most = cost * np.where(labels == 1, 0.5 / max(1e-9, labels.mean()), 0.5 / max(1e-9, 1 - labels.mean()))
    alpha = np.zeros(len(rows))
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            f, x = rows[i]
            slope = y[i] * (w[f] @ x + bias) - 1
            fresh = min(max(alpha[i] - slope / (x @ x + 1.0), 0.0), most[i])
            if fresh != alpha[i]:
                step = (fresh - alpha[i]) * y[i]
                w[f] += step * x
                bias += step
                moved = max(moved, abs(fresh - alpha[i]))
                alpha[i] = fresh
        if moved < 1e-4:
            break
    return w, bias


def _curve(margin: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Logistic fit of labels on margins by Newton steps, with smoothed targets."""
    n1, n0 = (labels == 1).sum(), (labels == 0).sum()
    target = np.where(labels == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    p = np.array([1.0, 0.0])
    x = np.stack([margin, np.ones_like(margin)], 1)
    for _ in range(50):
        s = 1 / (1 + np.exp(-np.clip(x @ p, -40, 40)))
        step = np.linalg.solve(x.T @ (x * (s * (1 - s))[:, None]) + 1e-6 * np.eye(2), x.T @ (target - s) - 1e-6 * p)
        p += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(p[0]), float(p[1])


def fit(texts: pa.Array, labels: np.ndarray) -> Model:
    """Ratios, weights and curve from labelled texts."""
    zero = np.zeros(FEATURES, np.float32)
    if not len(labels) or labels.min() == labels.max():
        share = float(labels[0]) if len(labels) else 0.5
        return Model(zero, zero, 0.0, 0.0, {0.0: -40.0, 0.5: 0.0, 1.0: 40.0}[share])
    docs = [np.unique(f).astype(np.int32) for _, _, block in word_blocks(texts, lower=False) for f in indicators(block)]
    back = np.arange(len(labels)) % HELD_BACK == 0
    if len(np.unique(labels[back])) < 2 or len(np.unique(labels[~back])) < 2:
        back[:] = False
    own = np.flatnonzero(~back)
    ratio = log_count_ratio([docs[i] for i in own], labels[own])
    rows = []
    for i in own:
        x = ratio[docs[i]].astype(np.float64)
        size = np.sqrt(x @ x)
        rows.append((docs[i], (x / size if size else x).astype(np.float32)))
    w, bias = dual_descent(rows, labels[own])
    model = Model(ratio, w.astype(np.float32), bias, 1.0, 0.0)
    check = back if back.any() else ~back
    return Model(ratio, model.weights, bias, *_curve(model.margins(texts.filter(pa.array(check))), labels[check]))


def score(spark: SparkSession, docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, score, predicted)`` of every row; the model has a fixed size."""
    shipped = spark.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            s = shipped.value.scores(batch.column(1))
            yield pa.record_batch([batch.column(0), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))],
                                  names=["doc_id", "score", "predicted"])
    return (docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
            .mapInArrow(run, "doc_id long, score double, predicted int"))
