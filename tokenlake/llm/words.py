"""Words of whole texts as numpy arrays.

A word is a maximal run of bytes outside the six ASCII space characters
(0x20, 0x09-0x0D), the class ``[^\\x20\\x09-\\x0D]+`` of the contracts; the
separators are ASCII, so byte positions are safe in UTF-8.

Word hashes are 64-bit: every byte maps to a fixed random 64-bit value, a
word's hash is the polynomial of these values (mod 2**64) passed through a
bijective mixer.  Two different words share a hash with a chance of about
2**-64.  Work is done in blocks of ``BLOCK`` bytes, so that memory does not
depend on the batch; a longer single text is cut between words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 21
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BYTE_VALUE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse mod 2**64."""
    if len(_powers.get("up", ())) < n:
        size = max(n, BLOCK + 64)
        for name, base in (("up", _BASE), ("down", _BASE_INVERSE)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[name] = np.multiply.accumulate(p)
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (two multiply-xorshift rounds)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial hash of ``values[start:end]`` for every pair, mixed."""
    up, down = powers(len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts])


def word_bounds(data: np.ndarray, doc_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends of the words of ``data``; no word crosses a document start."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    space = SPACE[data]
    before = np.empty(len(data), bool)
    before[0] = True
    before[1:] = space[:-1]
    inner = doc_starts[doc_starts < len(data)]
    before[inner] = True
    after = np.empty(len(data), bool)
    after[-1] = True
    after[:-1] = space[1:]
    after[inner[inner > 0] - 1] = True
    word = ~space
    return np.flatnonzero(word & before), np.flatnonzero(word & after) + 1


class Words:
    """The words of a run of documents: ``first[i]:first[i + 1]`` are those of document ``i``."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, hashes: np.ndarray):
        self.data, self.starts, self.ends, self.first, self.hashes = data, starts, ends, first, hashes

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owner(self) -> np.ndarray:
        """Document index of every word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def text(self, i: int) -> bytes:
        return self.data[self.starts[i]:self.ends[i]].tobytes()


def _hashed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    """Hashes of words, block by block (cut between words)."""
    out = np.empty(len(starts), np.uint64)
    a = 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + BLOCK, "right")))
        lo, hi = int(starts[a]), int(ends[b - 1])
        piece = data[lo:hi]
        out[a:b] = range_hashes(_BYTE_VALUE[LOWER[piece] if lower else piece], starts[a:b] - lo, ends[a:b] - lo)
        a = b
    return out


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the byte offset of every row (nulls: empty)."""
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def word_blocks(texts: pa.Array, lower: bool = False, hashes: bool = True) -> Iterator[tuple[int, int, Words]]:
    """Yield ``(a, b, words of rows a..b-1)``; a block holds about ``BLOCK`` bytes, or one longer text."""
    data, offsets = text_buffer(texts)
    a, n = 0, len(texts)
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + BLOCK, "right")) - 1)
        piece = data[offsets[a]:offsets[b]]
        doc_starts = offsets[a:b + 1] - offsets[a]
        starts, ends = word_bounds(piece, doc_starts)
        first = np.searchsorted(starts, doc_starts)
        yield a, b, Words(piece, starts, ends, first, _hashed(piece, starts, ends, lower) if hashes else np.zeros(0, np.uint64))
        a = b


def gather(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Concatenated index ranges ``first[i] .. first[i] + count[i] - 1``."""
    total = int(count.sum())
    if not total:
        return np.zeros(0, np.int64)
    begin = np.cumsum(count) - count
    return np.arange(total) + np.repeat(first - begin, count)
