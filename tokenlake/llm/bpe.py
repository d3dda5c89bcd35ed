"""Byte-level BPE encoding and decoding by corpus-level merge replay (operator 4).

A text is split by the pattern; every different match of a block is a word,
written as its bytes in one flat array of tokens with links to the next and
the previous token of the word.  An inverted index keeps, for every merge
rank, the positions of the pairs that merge into it.  The ranks are taken from
the smallest up and each is applied to all its positions at once: both tokens
become one, and only the pairs with the two neighbours are looked up again
and filed under their ranks.  For every word this is the order in which a
word-by-word encoder merges (its smallest rank first, the leftmost of equals),
also where a merge creates a pair of smaller rank: such a rank is taken up
next, and tokens of which the vocabulary has such a pair are merged one
position a word at a time.

Decoding concatenates the bytes of the ids.  Null and empty texts have no
ids; repeated rows encode alike; pairs of one rank merge from the left; an
empty table gives no rows; further columns are ignored; texts are whole;
memory holds the texts of a block (or one longer text), its different words
and a number for every match; decoded texts are handed on in blocks too.
"""

from __future__ import annotations

import base64
import heapq
from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenlake.llm.words import gather

RANKS = "byte_bpe_multi_50k.tiktoken"
BLOCK_CHARS = 1 << 22
DECODED_BYTES = 1 << 23
_NONE = np.iinfo(np.int64).max


def default_path() -> str:
    import public_tokenizers
    return public_tokenizers.path(RANKS)


def default_pattern() -> str:
    import public_tokenizers
    return public_tokenizers.PATTERN


class Ranks:
    """A rank file: token bytes by id, and the merge of every pair of ids."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            ids = {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, f))}
        self.size = max(ids.values()) + 1
        self.tokens = [b""] * self.size
        for token, i in ids.items():
            self.tokens[i] = token
        self.lens = np.array([len(t) for t in self.tokens], np.int64)
        self.bytes = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.first = np.cumsum(self.lens) - self.lens
        self.single = np.array([ids[bytes([i])] for i in range(256)], np.int64)
        pairs = {}
        for token, i in ids.items():
            for k in range(1, len(token)):
                a, b = ids.get(token[:k]), ids.get(token[k:])
                if a is not None and b is not None:
                    pairs[a * self.size + b] = i
        self.keys = np.array(sorted(pairs), np.int64)
        self.merged = np.array([pairs[k] for k in self.keys.tolist()], np.int64)
        # tokens with a pair of smaller rank than their own
        self.early = np.zeros(self.size, bool)
        for part in (self.keys // self.size, self.keys % self.size):
            self.early[part[self.merged < part]] = True

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.merged[at], _NONE)

    def decode(self, ids: np.ndarray) -> bytes:
        return self.bytes[gather(self.first[ids], self.lens[ids])].tobytes()


def replay(ranks: Ranks, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words, word after word, and the number of ids of each."""
    size = np.array([len(w) for w in words], np.int64)
    token = ranks.single[np.frombuffer(b"".join(words), np.uint8)]
    n = len(token)
    if not n:
        return token, size
    word = np.repeat(np.arange(len(words)), size)
    after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
    last = np.cumsum(size)[size > 0] - 1
    after[last] = n                                  # n: no neighbour
    before[(last + 1)[:-1]] = n
    before[0] = n
    alive = np.ones(n + 1, bool)
    alive[n] = False
    current = np.full(n + 1, _NONE)                  # rank of the pair that starts here
    index: dict[int, list[np.ndarray]] = {}
    heap: list[int] = []

    def file(positions: np.ndarray) -> None:
        """Looks the pairs at ``positions`` up and adds them to the index."""
        linked = positions[after[positions] < n]
        r = ranks.rank(token[linked], token[after[linked]])
        current[positions] = _NONE
        current[linked] = r
        found = linked[r < _NONE]
        r = r[r < _NONE]
        order = np.argsort(r, kind="stable")
        found, r = found[order], r[order]
        cut = np.flatnonzero(np.concatenate(([True], r[1:] != r[:-1]))) if len(r) else []
        for lo, hi in zip(cut, [*cut[1:], len(r)]):
            key = int(r[lo])
            if key not in index:
                index[key] = []
                heapq.heappush(heap, key)
            index[key].append(found[lo:hi])

    file(np.arange(n))
    while heap:
        r = heapq.heappop(heap)
        at = np.concatenate(index.pop(r))
        at = at[alive[at] & (current[at] == r)]
        if not len(at):
            continue
        at.sort()
        at = at[np.concatenate(([True], at[1:] != at[:-1]))]
        rest = at[:0]
        if ranks.early[r]:
            lead = np.concatenate(([True], word[at[1:]] != word[at[:-1]]))
            at, rest = at[lead], at[~lead]
        else:
            # of overlapping pairs (runs of one token) every second, from the left
            joined = np.concatenate(([False], after[at[:-1]] == at[1:]))
            if joined.any():
                start = np.maximum.accumulate(np.where(joined, 0, np.arange(len(at))))
                at = at[(np.arange(len(at)) - start) % 2 == 0]
        gone = after[at]
        token[at] = r
        alive[gone] = False
        after[at] = after[gone]
        follow = after[at]
        inner = follow < n
        before[follow[inner]] = at[inner]
        lead = before[at]
        file(np.concatenate((at, lead[lead < n])))
        if len(rest):
            if r not in index:
                index[r] = []
                heapq.heappush(heap, r)
            index[r].append(rest)
    kept = alive[:n]
    return token[kept], np.bincount(word[kept], minlength=len(words))


class Encoder:
    """Splits and encodes texts; one per Python worker."""

    def __init__(self, path: str, pattern: str):
        self.ranks, self.split = Ranks(path), regex.compile(pattern)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, text after text, and the number of ids of each."""
        number = defaultdict(count().__next__)           # a different word's number; the matches themselves aren't kept
        places = []
        for t in texts:
            own = self.split.findall(t)
            places.append(np.fromiter(map(number.__getitem__, own), np.int32, len(own)))
        counts = np.fromiter(map(len, places), np.int64, len(places))
        place = np.concatenate([np.zeros(0, np.int32), *places])
        ids, lens = replay(self.ranks, [w.encode() for w in number])
        first = np.cumsum(lens) - lens
        total = np.concatenate(([0], np.cumsum(lens[place])))
        edge = np.cumsum(counts)
        return ids.astype("<u4")[gather(first[place], lens[place])], total[edge] - total[edge - counts]


_encoders: dict[tuple, Encoder] = {}


def encoder(path: str, pattern: str) -> Encoder:
    if (path, pattern) not in _encoders:
        _encoders[path, pattern] = Encoder(path, pattern)
    return _encoders[path, pattern]


def _blocks(texts: pa.Array):
    size = np.array([0 if v is None else v for v in pc.binary_length(texts).to_pylist()], np.int64)
    total, a = np.concatenate(([0], np.cumsum(size))), 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(total, total[a] + BLOCK_CHARS, "right")) - 1)
        yield a, b, [t or "" for t in texts.slice(a, b - a).to_pylist()]
        a = b


def encoded(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``(doc_id, n_tokens, ids)`` of every row, ``ids`` as little-endian unsigned 32-bit integers."""
    path, pattern = path or default_path(), pattern or default_pattern()

    def run(batches):
        enc = encoder(path, pattern)
        for batch in batches:
            for a, b, texts in _blocks(batch.column(1)):
                ids, sizes = enc.encode(texts)
                edges = np.concatenate(([0], np.cumsum(sizes)))
                data = pa.py_buffer(ids)
                yield pa.record_batch([batch.column(0).slice(a, b - a), pa.array(sizes),
                                       pa.Array.from_buffers(pa.large_binary(), b - a, [None, pa.py_buffer(edges * 4), data]).cast(pa.binary())],
                                      names=["doc_id", "n_tokens", "ids"])
    return (docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
            .mapInArrow(run, "doc_id long, n_tokens long, ids binary"))


def _with_bytes(ranks: Ranks, batch: pa.RecordBatch):
    """The rows with what their ids stand for, in batches of about ``DECODED_BYTES`` or one longer text."""
    a, held, out = 0, 0, []
    for i, v in enumerate(batch.column(2)):
        out.append(ranks.decode(np.frombuffer(v.as_buffer(), "<u4").astype(np.int64)))
        held += len(out[-1])
        if held >= DECODED_BYTES or i == len(batch) - 1:
            yield pa.record_batch([*batch.slice(a, len(out)).columns, pa.array(out, pa.binary())], names=["doc_id", "n_tokens", "ids", "bytes"])
            a, held, out = i + 1, 0, []


def decoded(rows: DataFrame, path: str | None = None) -> DataFrame:
    """The rows ``(doc_id, n_tokens, ids)`` with ``bytes``, what the ids stand for (UTF-8 of the text)."""
    path = path or default_path()

    def run(batches):
        enc = encoder(path, default_pattern())
        for batch in batches:
            yield from _with_bytes(enc.ranks, batch)
    return rows.select("doc_id", "n_tokens", "ids").mapInArrow(run, "doc_id long, n_tokens long, ids binary, bytes binary")
