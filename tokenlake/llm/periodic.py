"""Periodic runs of words by recompression (operator 13).

A run is a stretch of words with smallest period q and at least
``max(MIN_LENGTH, 2 q)`` words that no neighbouring word extends keeping
period q.  In a ``collapsed`` text every run keeps its first q words.

1. ``Grammar``: the words of many documents, laid end to end with a separator
   of its own after each, are recompressed: block compression names every
   maximal repetition of one symbol (symbol, count), pair compression deals
   the symbols into left and right ones and names every neighbouring (left,
   right) pair; the two alternate until each document is one symbol.  Equal
   stretches get equal names but for a symbol at either end, whatever stands
   around them.
2. ``Grammar.after`` and ``Grammar.before`` answer longest-common-extension
   queries for arrays of position pairs: up the levels while both positions
   open a symbol of the next level (else at most one symbol or run is compared
   first), and down again to the first difference.  A constant number of array
   steps a level, no suffix array.
3. ``runs``: a run of period p covers a multiple i of p in its first p words,
   and the words i and i + p are equal.  These harmonic-grid candidates (n/1 +
   n/2 + n/3 + ... places) are extended exactly in both directions.  A stretch
   found with a multiple of its period has the same ends, so the smallest
   period of equal ends is kept; candidates inside a run whose period divides
   theirs are known to give that run and are not extended again.

Words are ``[^\\x20\\x09-\\x0D]+``, unchanged; equality of words is that of
their 64-bit hashes.  Null and empty texts have no words, no runs and an empty
collapsed text; ties and repeated rows change nothing, a null id stays null,
an empty table gives no rows, further columns are ignored.  Documents are
worked off in blocks; a longer text is a block of its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenlake.llm.words import Words, gather, mix, word_blocks

MIN_LENGTH = 12
QUERIES = 1 << 16             # extensions of one array call

SCHEMA = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


class _Level:
    """Symbols of a level, the place of each in the next one, and the first place of each of the next one's symbols."""

    def __init__(self, symbols: np.ndarray, opens: np.ndarray, blocks: bool):
        self.symbols, self.blocks = symbols, blocks
        self.up = np.cumsum(opens) - 1
        self.first = np.append(np.flatnonzero(opens), len(symbols))


class Grammar:
    """Run-length grammar of ``symbols``, whose first ``separators`` names occur once each and stay single."""

    def __init__(self, symbols: np.ndarray, separators: int):
        self.levels: list[_Level] = []
        fresh = int(symbols.max()) + 1
        least = separators + np.count_nonzero(np.diff(np.flatnonzero(symbols < separators)) > 1)
        blocks = True
        while len(symbols) > least:
            opens = np.ones(len(symbols), bool)
            if blocks:
                opens[1:] = symbols[1:] != symbols[:-1]
                count = np.diff(np.append(np.flatnonzero(opens), len(symbols)))
                named, second = count > 1, count
            else:
                left = mix(symbols.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(len(self.levels))) & np.uint64(1) == 0
                word = symbols >= separators
                opens[1:] = ~(left[:-1] & ~left[1:] & word[:-1] & word[1:])
                named = ~np.append(opens, True)[1:][opens]
                second = np.append(symbols[1:], 0)[opens]
            level = _Level(symbols, opens, blocks)
            symbols = symbols[opens]
            names, place = np.unique(symbols[named] << 32 | second[named], return_inverse=True)
            symbols[named] = fresh + place
            fresh += len(names)
            self.levels.append(level)
            blocks = not blocks
        self.top = symbols

    def after(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Number of equal symbols from ``x`` and from ``y`` on (x < y, of one document)."""
        return self._common(x, y, False)

    def before(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Number of equal symbols that end before ``x`` and before ``y``."""
        return self._common(x, y, True)

    def _reach(self, level: _Level, x: np.ndarray, back: bool) -> np.ndarray:
        """Symbols from ``x`` to the end (``back``: to the start) of the symbol of the next level there."""
        return x - level.first[level.up[x - 1]] if back else level.first[level.up[x] + 1] - x

    def _common(self, x: np.ndarray, y: np.ndarray, back: bool) -> np.ndarray:
        here, step = (1, -1) if back else (0, 1)
        origin, who, halted = x, np.arange(len(x)), []
        for level in self.levels:
            s, up = level.symbols, level.up
            both = (level.first[up[x]] == x) & (level.first[up[y]] == y)
            equal = s[x - here] == s[y - here]
            if level.blocks:
                rx, ry = self._reach(level, x, back), self._reach(level, y, back)
                on = both | equal & (rx == ry)
                move = np.where(both, 0, np.where(equal, np.minimum(rx, ry), 0))
            else:
                on = both | equal
                move = np.where(both, 0, equal.astype(np.int64))
            x, y = x + step * move, y + step * move
            halted.append((who[~on], x[~on], y[~on]))
            x, y, who = up[x[on]], up[y[on]], who[on]
            if not len(who):
                break
        # the way down: what halted above goes to the first place of its symbols, and past an equal first part
        for level, (own, a, b) in zip(reversed(self.levels[:len(halted)]), reversed(halted)):
            x, y = level.first[x], level.first[y]
            s = level.symbols
            equal = s[x - here] == s[y - here]
            move = np.minimum(self._reach(level, x, back), self._reach(level, y, back)) if level.blocks else 1
            move = np.where(equal, move, 0)
            x, y, who = np.concatenate((x + step * move, a)), np.concatenate((y + step * move, b)), np.concatenate((who, own))
        end = np.empty(len(origin), np.int64)
        end[who] = x
        return step * (end - origin)


class _Found:
    """The runs found so far, and for every place the last of them painted there."""

    def __init__(self, size: int):
        self.runs = np.zeros((0, 3), np.int64)
        self.painted = np.full(size, -1, np.int64)

    def unknown(self, x: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Candidates that are not inside a known run whose period divides theirs."""
        r = self.painted[x]
        known = np.zeros(len(x), bool)
        some = np.flatnonzero(r >= 0)
        run = self.runs[r[some]]
        known[some] = (x[some] + p[some] < run[:, 1]) & (p[some] % run[:, 2] == 0)
        return ~known

    def add(self, start: np.ndarray, end: np.ndarray, p: np.ndarray) -> None:
        order = np.lexsort((p, end, start))
        new = np.stack((start, end, p), 1)[order]
        new = new[np.append(True, (np.diff(new[:, :2], axis=0) != 0).any(1))[:len(new)]]
        first = len(self.runs)
        self.runs = np.concatenate((self.runs, new))
        for k, (a, b, _) in enumerate(new.tolist()):
            self.painted[a:b] = first + k

    def least(self) -> np.ndarray:
        """Rows (start, end, period) by start, then period; of equal ends the smallest period."""
        runs = self.runs[np.lexsort((self.runs[:, 2], self.runs[:, 1], self.runs[:, 0]))]
        runs = runs[np.append(True, (np.diff(runs[:, :2], axis=0) != 0).any(1))[:len(runs)]]
        return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def runs(words: np.ndarray, counts: np.ndarray, min_length: int = MIN_LENGTH) -> np.ndarray:
    """Rows ``(document, start, length, period)`` of documents of ``counts`` words each, laid end to end.

    ``words`` are any integers; equal words, equal numbers.
    """
    counts = counts.astype(np.int64)
    docs = len(counts)
    if not len(words) or counts.max() < min_length:
        return np.zeros((0, 4), np.int64)
    doc = np.repeat(np.arange(docs), counts)
    at = np.arange(len(words)) + doc + 1                       # a separator first, and one after every document
    symbols = np.arange(len(words) + docs + 1)
    owner = np.full(len(symbols), -1, np.int64)
    owner[at] = doc
    symbols[owner < 0] = np.arange(docs + 1)
    symbols[at] = np.unique(words, return_inverse=True)[1] + docs + 1
    grammar, found, size = Grammar(symbols, docs + 1), _Found(len(symbols)), len(symbols)
    waiting: list[tuple[np.ndarray, int]] = []
    held = 0

    def extend() -> None:
        x, p = np.concatenate([w for w, _ in waiting]), np.repeat([p for _, p in waiting], [len(w) for w, _ in waiting])
        fits = (owner[x] == owner[x + p]) & (counts[owner[x]] >= np.maximum(2 * p, min_length))
        x, p = x[fits], p[fits]
        while len(x):
            fresh = found.unknown(x, p)
            x, p = x[fresh], p[fresh]
            some, q = x[:QUERIES], p[:QUERIES]
            x, p = x[QUERIES:], p[QUERIES:]
            before, after = grammar.before(some, some + q), grammar.after(some, some + q)
            hit = before + after >= np.maximum(q, min_length - q)
            found.add((some - before)[hit], (some + q + after)[hit], q[hit])
    for p in range(1, int(counts.max()) // 2 + 1):
        x = np.flatnonzero(symbols[0:size - p:p] == symbols[p:size:p]) * p
        if len(x):
            waiting.append((x, p))
            held += len(x)
        if held and (held >= QUERIES or p & (p + 1) == 0):      # small periods first, then ever more of them together
            extend()
            waiting, held = [], 0
    if held:
        extend()
    start, end, period = found.least().T
    first = np.concatenate(([0], np.cumsum(counts + 1)))[owner[start]] + 1
    return np.stack((owner[start], start - first, end - start, period), 1)


def _collapsed(words: Words, kept: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Kept words of every document joined by one space, document after document, and their byte edges."""
    doc = words.owner()[kept]
    start, size = words.starts[kept], words.ends[kept] - words.starts[kept]
    last = np.append(doc[1:] != doc[:-1], True)[:len(doc)]
    text = np.append(words.data, np.uint8(0x20))[gather(start, size + 1)]
    text[np.cumsum(size + 1) - 1] = 0x20
    stay = np.ones(len(text), bool)
    stay[(np.cumsum(size + 1) - 1)[last]] = False
    width = np.bincount(doc, size + 1, len(words.first) - 1).astype(np.int64)
    return text[stay].tobytes(), np.concatenate(([0], np.cumsum(width - (width > 0))))


def _block(doc_ids: pa.Array, words: Words, min_length: int) -> pa.RecordBatch:
    counts, docs = words.counts, len(doc_ids)
    found = [np.zeros((0, 4), np.int64)]
    # documents of like size together, as a block's longest one sets the largest period tried
    scale = np.where(counts >= min_length, np.log2(np.maximum(counts, 1)).astype(np.int64) // 2, -1)
    for k in np.unique(scale[scale >= 0]):
        own = np.flatnonzero(scale == k)
        rows = runs(words.hashes[gather(words.first[own], counts[own])], counts[own], min_length)
        rows[:, 0] = own[rows[:, 0]]
        found.append(rows)
    rows = np.concatenate(found)
    rows = rows[np.argsort(rows[:, 0], kind="stable")]
    doc, start, length, period = rows.T
    # covered from the first period on
    cover = np.zeros(len(words.starts) + 1, np.int64)
    np.add.at(cover, words.first[doc] + start + period, 1)
    np.add.at(cover, words.first[doc] + start + length, -1)
    data, edge = _collapsed(words, np.flatnonzero(np.cumsum(cover[:-1]) == 0))
    texts = pa.Array.from_buffers(pa.large_string(), docs, [None, pa.py_buffer(edge.astype(np.int64)), pa.py_buffer(data)])
    lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(docs + 1)), pa.int32()),
                                     pa.StructArray.from_arrays([pa.array(start), pa.array(length), pa.array(period)], names=["start", "length", "period"]))
    return pa.record_batch([doc_ids, pa.array(counts.astype(np.int64)), lists, texts.cast(pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])


def periodic_runs(docs: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """One row per document: ``doc_id, n_words, runs, collapsed``.

    ``runs`` are structs (start, length, period) in words, by start, then
    period; ``collapsed`` is the text without the words that a run holds after
    its first period, joined by one space.
    """
    def run(batches):
        for batch in batches:
            for a, b, words in word_blocks(batch.column(1)):
                yield _block(batch.column(0).slice(a, b - a), words, min_length)
    return docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).mapInArrow(run, SCHEMA)
