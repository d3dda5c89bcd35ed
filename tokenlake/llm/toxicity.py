"""Toxicity by subword-bag embeddings and a linear softmax (operator 7).

A word is lower-cased ``[^\\x20\\x09-\\x0D]+`` with ASCII punctuation at its
ends cut off; its vector is the mean of the vectors of itself (hashed) and of
its byte 3-, 5-, 6- and 8-grams between word marks, so an unseen misspelling
shares most of its vector with the spelling it comes from.  A text, without
words equal to the one before, is read in windows of ``WINDOW`` words that
overlap by half; a window's vector is the mean of its words (a shorter one is
filled up with zero vectors), a linear softmax gives its toxic probability,
and the text scores as its most toxic window (so length does not dilute it).

``fit`` trains embeddings and softmax jointly in numpy with Adam on at most
``MAX_DOCS`` labelled documents (of either label those of smallest id hash)
in a task of its own (``trained``); a document's gradient goes through its most toxic
window (at first by the n-grams' log odds, then by the model itself).
N-grams in under ``MIN_DOCS`` documents of the sample stay zero: they could
only be learnt by heart.  Since the model is linear in the n-grams, scoring needs one number
per n-gram: the logit difference.  Every distinct word of a block is scored
once, then the windows are means of numbers.

Null, empty and space-only texts score ``P(toxic)`` of an empty window (the
bias alone); repeated rows and ties get equal scores; an empty training set
gives a model that scores every text 0 (nothing is known to be toxic); a
document whose label rows disagree is not used for training; further columns
are ignored.
"""

from __future__ import annotations

import pickle
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenlake.llm.common import saved
from tokenlake.llm.words import LOWER, Words, gather, mix, word_blocks

BUCKETS = 1 << 18
DIM = 8
GRAMS = (3, 5, 6, 8)
WINDOW = 8
MAX_DOCS = 10_000            # half of them of either label
HELD_BACK = 5                # every fifth document of the sample sets the bias
MIN_DOCS = 3
EPOCHS = 12
RATE = 0.05
PRIOR = -4.0               # logit of a window without any known n-gram
THRESHOLD = 0.5

_EDGE = np.zeros(256, bool)
_EDGE[[i for i in range(33, 127) if not chr(i).isalnum()]] = True


def _trimmed(block: Words) -> tuple[np.ndarray, np.ndarray]:
    """Word bounds without ASCII punctuation at the ends (a word of nothing else keeps its first character)."""
    if not len(block.starts):
        return block.starts, block.ends
    place = np.arange(len(block.data))
    inner = ~_EDGE[block.data]
    last = np.maximum.accumulate(np.where(inner, place, -1))[block.ends - 1]
    first = np.minimum.accumulate(np.where(inner, place, len(place))[::-1])[::-1][block.starts]
    some = last >= block.starts
    return np.where(some, first, block.starts), np.where(some, last + 1, block.starts + 1)


def word_grams(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-gram buckets of words, word after word, and the number of buckets of each word."""
    length = ends - starts
    size = length + 2
    at = np.cumsum(size) - size
    marked = np.full(int(size.sum()), 1, np.uint64)                   # a mark before and after every word
    offset = np.arange(len(marked)) - np.repeat(at, size)
    inner = (offset > 0) & (offset <= np.repeat(length, size))
    source = np.repeat(starts, size) + offset - 1
    marked[inner] = LOWER[data[source[inner]]]
    owner = np.repeat(np.arange(len(starts)), size)
    grams, owners = [], []
    for n in GRAMS:
        if len(marked) < n:
            continue
        code = np.zeros(len(marked) - n + 1, np.uint64)
        for j in range(n):
            code = (code << np.uint64(8)) | marked[j:j + len(code)]
        whole = owner[:len(code)] == owner[n - 1:]
        grams.append((mix(mix(code[whole]) + np.uint64(n)) % np.uint64(BUCKETS - 1)).astype(np.int64) + 1)
        owners.append(owner[:len(code)][whole])
    # the word itself: a running hash over its bytes
    power = np.uint64(0x100000001B3)
    whole = np.zeros(len(starts), np.uint64)
    weight = np.multiply.accumulate(np.full(int(size.max(initial=1)), power, np.uint64))
    np.add.at(whole, owner, marked * weight[offset])
    grams.append((mix(whole) % np.uint64(BUCKETS - 1)).astype(np.int64) + 1)
    owners.append(np.arange(len(starts)))
    grams, owners = np.concatenate(grams), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return grams[order], np.bincount(owners, minlength=len(starts))


def _distinct(block: Words) -> tuple[np.ndarray, ...]:
    """Bounds of one occurrence of every distinct word of the block, its hash, each word's place
    among them (words equal to the one before left out), and the words left in every document."""
    new = np.ones(len(block.hashes), bool)
    new[1:] = block.hashes[1:] != block.hashes[:-1]
    new[block.first[:-1][block.counts > 0]] = True
    starts, ends = _trimmed(block)
    keys, first, place = np.unique(block.hashes, return_index=True, return_inverse=True)
    left = np.diff(np.concatenate(([0], np.cumsum(new)))[block.first])
    return starts[first], ends[first], keys, place[new], left


def _word_values(weights: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    value = np.empty(len(starts))
    for i in range(0, len(starts), 65536):
        grams, count = word_grams(data, starts[i:i + 65536], ends[i:i + 65536])
        value[i:i + 65536] = np.add.reduceat(weights[grams], np.cumsum(count) - count) / count
    return value


def _windows(counts: np.ndarray, width: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, end word and document of the half-overlapping windows of every document."""
    step = width // 2
    each = np.where(counts > 0, np.maximum(1, -(-(counts - width) // step) + 1), 0)
    doc = np.repeat(np.arange(len(counts)), each)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(each) - each, each)
    first = np.cumsum(counts) - counts
    lo = first[doc] + k * step
    return lo, np.minimum(lo + width, first[doc] + counts[doc]), doc


class Model:
    """Toxic-minus-clean logit of every n-gram bucket, and the bias."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, float(bias)

    def scores(self, texts: pa.Array) -> np.ndarray:
        """Toxic probability of every text."""
        out = np.empty(len(texts))
        for a, b, block in word_blocks(texts, lower=True):
            best = np.full(b - a, self.bias)
            if len(block.hashes):
                starts, ends, _, place, left = _distinct(block)
                value = _word_values(self.weights, block.data, starts, ends)
                total = np.concatenate(([0.0], np.cumsum(value[place])))
                lo, hi, doc = _windows(left)
                z = (total[hi] - total[lo]) / WINDOW + self.bias
                own = np.full(b - a, -np.inf)
                np.maximum.at(own, doc, z)
                best = np.where(block.counts > 0, own, best)
            out[a:b] = 1 / (1 + np.exp(-np.clip(best, -40, 40)))
        return out


def fit(texts: pa.Array, labels: np.ndarray, epochs: int = EPOCHS, dim: int = DIM, seed: int = 7) -> Model:
    """The trained model; its bias puts the best cut of the documents held back at probability 0.5 (and stays under -1)."""
    back = np.arange(len(labels)) % HELD_BACK == 0
    if len(np.unique(labels[back])) < 2 or len(np.unique(labels[~back])) < 2:
        return _train(texts, labels, epochs, dim, seed)
    model = _train(texts.filter(pa.array(~back)), labels[~back], epochs, dim, seed)
    z = np.log(np.clip(model.scores(texts.filter(pa.array(back))), 1e-12, 1 - 1e-12))
    z -= np.log1p(-np.exp(z))
    y = labels[back]
    order = np.argsort(z)
    z, y = z[order], y[order]
    # errors when everything from place k on is called toxic; the middle of the widest of the best gaps
    errors = np.concatenate(([0], np.cumsum(y == 1))) + np.concatenate((np.cumsum((y == 0)[::-1])[::-1], [0]))
    edge = np.concatenate(([z[0] - 1], z, [z[-1] + 1]))
    best = np.flatnonzero(errors == errors.min())
    k = best[np.argmax(edge[best + 1] - edge[best])]
    return Model(model.weights, min(model.bias - (edge[k] + edge[k + 1]) / 2, -1.0))


def _train(texts: pa.Array, labels: np.ndarray, epochs: int, dim: int, seed: int) -> Model:
    """Joint training of the n-gram embeddings and the softmax on labelled texts."""
    if not len(labels):
        return Model(np.zeros(BUCKETS, np.float32), -40.0)
    if labels.min() == labels.max():
        return Model(np.zeros(BUCKETS, np.float32), 40.0 if labels[0] else -40.0)
    rng = np.random.default_rng(seed)
    # the sample as word numbers, the words as n-gram buckets
    seen, number_of = np.zeros(0, np.uint64), np.zeros(0, np.int32)      # hashes of the words so far, sorted, and their numbers
    grams, counts, places, lens = [], [], [], []
    for _, _, block in word_blocks(texts, lower=True):
        starts, ends, keys, place, left = _distinct(block)
        new = ~np.isin(keys, seen, assume_unique=True)
        for i in range(0, int(new.sum()), 65536):
            own = np.flatnonzero(new)[i:i + 65536]
            g, c = word_grams(block.data, starts[own], ends[own])
            grams.append(g.astype(np.int32))
            counts.append(c.astype(np.int32))
        fresh = np.arange(len(seen), len(seen) + int(new.sum()), dtype=np.int32)
        seen, number_of = np.concatenate((seen, keys[new])), np.concatenate((number_of, fresh))
        order = np.argsort(seen)
        seen, number_of = seen[order], number_of[order]
        places.append(number_of[np.searchsorted(seen, keys)][place])
        lens.append(left)
    del seen, number_of
    grams = np.concatenate(grams)
    count, words, lens = map(np.concatenate, (counts, places, lens))
    del counts, places
    count = count.astype(np.int64)
    begin = np.cumsum(count) - count
    lo, hi, doc = _windows(lens)
    windows = np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=len(lens)))))
    # documents of every bucket by label, for the bound of MIN_DOCS and the first choice of windows
    seen = np.zeros((2, BUCKETS))
    ends = np.cumsum(lens)
    for i, n in enumerate(lens):
        own = np.unique(words[ends[i] - n:ends[i]])
        seen[labels[i], np.unique(grams[gather(begin[own], count[own])])] += 1
    known = seen.sum(0) >= MIN_DOCS
    odds = np.log((seen[1] + 0.5) / ((labels == 1).sum() + 1)) - np.log((seen[0] + 0.5) / ((labels == 0).sum() + 1))
    emb = (rng.normal(0, 0.1, (BUCKETS, dim)) * known[:, None]).astype(np.float32)
    out = rng.normal(0, 0.1, (dim, 2)).astype(np.float32)
    bias = np.array([-PRIOR / 2, PRIOR / 2], np.float32)         # not trained: without evidence a window is clean
    m_emb, v_emb = np.zeros_like(emb), np.zeros_like(emb)
    m_out, v_out = np.zeros_like(out), np.zeros_like(out)
    step, rate = 0, RATE
    balance = np.array([0.5 / max(1e-9, (labels == 0).mean()), 0.5 / (labels == 1).mean()])
    filled = np.flatnonzero(lens > 0)
    size_of_batch = min(256, max(16, len(filled) // 40))
    for epoch in range(epochs):
        # logits of all windows under the present model: the most toxic window of each document is trained
        weight = emb @ (out[:, 1] - out[:, 0]) if epoch else odds * known
        value = np.empty(len(begin))
        for i in range(0, len(begin), 65536):               # some words at a time
            part = slice(begin[i], begin[i + 65536] if i + 65536 < len(begin) else len(grams))
            value[i:i + 65536] = np.add.reduceat(weight[grams[part]], begin[i:i + 65536] - begin[i])
        value /= count
        total = np.concatenate(([0.0], np.cumsum(value[words], dtype=np.float64)))
        z = total[hi] - total[lo]
        top = np.lexsort((-z, doc))
        top = top[windows[:-1][filled]]
        order = rng.permutation(len(filled))
        for b in range(0, len(order), size_of_batch):
            pick = order[b:b + size_of_batch]
            w, y = top[pick], labels[filled[pick]].astype(np.int64)
            size = hi[w] - lo[w]
            row = np.repeat(np.arange(len(w)), size)
            word = words[gather(lo[w], size)]
            gram_row = np.repeat(np.arange(len(word)), count[word])
            bucket = grams[gather(begin[word], count[word])]
            share = (known[bucket] / (count[word] * WINDOW)[gram_row]).astype(np.float32)
            bag = np.zeros((len(w), dim), np.float32)
            np.add.at(bag, row[gram_row], emb[bucket] * share[:, None])
            logit = bag @ out + bias
            p = np.exp(logit - logit.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(w)), y] -= 1
            p *= (balance[y] / len(w)).astype(np.float32)[:, None]
            step += 1
            grad = p @ out.T
            touched, inverse = np.unique(bucket, return_inverse=True)
            g = np.zeros((len(touched), dim), np.float32)
            np.add.at(g, inverse, grad[row[gram_row]] * share[:, None])
            fix = rate * np.sqrt(1 - 0.999 ** step) / (1 - 0.9 ** step)
            m_emb[touched] = 0.9 * m_emb[touched] + 0.1 * g
            v_emb[touched] = 0.999 * v_emb[touched] + 0.001 * g * g
            emb[touched] -= fix * m_emb[touched] / (np.sqrt(v_emb[touched]) + 1e-8)
            g = bag.T @ p
            m_out = 0.9 * m_out + 0.1 * g
            v_out = 0.999 * v_out + 0.001 * g * g
            out -= fix * m_out / (np.sqrt(v_out) + 1e-8)
    return Model((emb @ (out[:, 1] - out[:, 0])).astype(np.float32), bias[1] - bias[0])


def training_sample(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """``(doc_id, text, y)`` of at most ``most`` labelled documents, of either label half of them, those of smallest id hash.

    Documents whose label rows disagree are not used.  The bound keeps the
    chosen ids small enough to broadcast, so the texts are not shuffled.
    """
    marked = (labels.select("doc_id", F.col(label).cast("int").alias("y")).where("y in (0, 1)")
              .groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("other")).where("y = other").drop("other"))
    chosen = reduce(DataFrame.unionByName, (marked.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most // 2) for y in (0, 1)))
    return (docs.select("doc_id", F.col("text").cast("string").alias("text")).where("text is not null")
            .join(F.broadcast(chosen), "doc_id").select("doc_id", "text", F.col("y").cast("long")))


def trained(sample: DataFrame, fit):
    """``fit(texts, labels)`` of a bounded sample, in one task of its own; only the model comes to the driver."""
    def run(batches):
        rows = pa.Table.from_batches(list(batches), schema)          # sorted by the query
        text, y = rows.column("text").combine_chunks(), rows.column("y").to_numpy().astype(np.int64)
        text = pa.concat_arrays(text.chunks) if isinstance(text, pa.ChunkedArray) and text.num_chunks else text if len(rows) else pa.array([], pa.string())
        del rows
        yield pa.record_batch([pa.array([pickle.dumps(fit(text, y))], pa.binary())], names=["model"])
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("y", pa.int64())])
    rows = saved(sample.select(F.col("doc_id").cast("long"), "text", "y"), "training-sample").repartition(1).sortWithinPartitions("doc_id", "text")
    made = rows.mapInArrow(run, "model binary").first()
    return pickle.loads(made["model"]) if made else fit(pa.array([], pa.string()), np.zeros(0, np.int64))


def score(spark: SparkSession, docs: DataFrame, model: Model, threshold: float = THRESHOLD, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``carry`` of every row with ``score`` and ``predicted``.

    The model has a fixed size (``BUCKETS`` numbers) and goes to the executors once.
    """
    shipped = spark.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            s = shipped.value.scores(batch.column(0))
            yield pa.record_batch([*batch.columns[1:], pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=names)
    rows = docs.select(F.col("text").cast("string").alias("text to score"), *carry)
    out = T.StructType([*rows.schema.fields[1:], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    names = out.fieldNames()
    return rows.mapInArrow(run, out)
