"""Packing into training sequences by order-preserving dynamic programming (operator 5).

The documents of an input partition form one token stream, in their order: a
document's ids, then id 1.  The stream is cut into sequences of at most
``CAPACITY`` ids.  Cuts may stand at document ends (free), sentence ends
(penalty ``SENTENCE_CUT``) or, inside long stretches without either, at every
``HARD_STEP``-th id (penalty ``HARD_CUT``).  The chosen cuts minimise padding
plus penalties over the stream:

    cost[j] = cut[j] + min over i of cost[i] + CAPACITY - (at[j] - at[i]),   at[j] - at[i] <= CAPACITY

and as ``cost[i] + at[i]`` does not depend on j, the minimum over the sliding
range is kept in a monotone queue: constant work for each possible cut.  The
stream is optimised in stretches of ``STRETCH`` ids, whose last sequence is
left to the next stretch; memory holds one stretch and one document.  What
remains at the end of a partition is padded, or cut into powers of two
(which need no padding) where the cuts cost less than the padding.

Every partition works alone: no shuffle, and a retried task gives the same
rows; ``sequence_id`` is the partition number times 2**33 plus a counter.
Null and empty texts are their id 1 alone; repeated rows are packed as often
as they occur; of cuts of equal cost the earliest start of a sequence counts;
an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenlake.llm.tokenize import default_path, encoder

CAPACITY = 2048
END = 1
SENTENCE_CUT, HARD_CUT, HARD_STEP = 16, 96, 64
STRETCH = 1 << 18

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def candidates(size: int, doc_ends: np.ndarray, sentence_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Possible cuts in ``(0, size]`` and their penalties."""
    cost = np.full(size + 1, -1, np.int64)
    cost[sentence_ends] = SENTENCE_CUT
    cost[doc_ends] = 0
    cost[0], cost[size] = 0, max(0, cost[size])
    at = np.flatnonzero(cost >= 0)
    gap = np.diff(at)
    wide = np.flatnonzero(gap > HARD_STEP)
    for a, g in zip(at[wide].tolist(), gap[wide].tolist()):
        cost[a + HARD_STEP:a + g:HARD_STEP] = HARD_CUT
    at = np.flatnonzero(cost >= 0)[1:]
    return at, cost[at]


def best_cuts(at: np.ndarray, penalty: np.ndarray, capacity: int = CAPACITY, whole: bool = True) -> list[int]:
    """Ends of the sequences of a stream with possible cuts ``at``.

    Without ``whole`` the stream goes on: the last sequence may end at any
    cut of the last ``capacity`` ids, whichever costs least.
    """
    pos, pen = [0, *at.tolist()], [0, *penalty.tolist()]
    cost, back = [0] * len(pos), [0] * len(pos)
    queue = deque([0])                                   # places with rising cost + position
    for j in range(1, len(pos)):
        p = pos[j]
        while p - pos[queue[0]] > capacity:
            queue.popleft()
        i = queue[0]
        back[j] = i
        cost[j] = c = cost[i] + pos[i] + capacity - p + pen[j]
        key = c + p
        while queue and cost[queue[-1]] + pos[queue[-1]] >= key:
            queue.pop()
        queue.append(j)
    j = len(pos) - 1
    if not whole:
        first = int(np.searchsorted(at, pos[-1] - capacity, "right")) + 1
        j = min(range(min(first, j), len(pos)), key=cost.__getitem__)
    cuts = []
    while j:
        cuts.append(pos[j])
        j = back[j]
    return cuts[::-1]


def tail_cuts(length: int, capacity: int = CAPACITY) -> list[int]:
    """Ends of the sequences of a last stretch of under ``capacity`` ids."""
    if length.bit_count() * HARD_CUT >= capacity - length:
        return [length]
    ends, at = [], 0
    for bit in range(length.bit_length() - 1, -1, -1):
        if length >> bit & 1:
            at += 1 << bit
            ends.append(at)
    return ends


class _Stream:
    """The ids of a partition that are not yet in a sequence, and their documents."""

    def __init__(self, ends_sentence: np.ndarray, first_sequence: int):
        self.ends_sentence, self.sequence = ends_sentence, first_sequence
        self.ids = np.zeros(0, np.int32)
        self.doc, self.begin, self.total = (np.zeros(0, np.int64) for _ in range(3))
        self.new: list[tuple] = []
        self.waiting = 0

    def add(self, doc_ids: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        self.new.append((doc_ids, ids, sizes))
        self.waiting += len(ids)

    def _join(self) -> None:
        held = len(self.ids)
        sizes = np.concatenate([np.zeros(0, np.int64), *(n[2] for n in self.new)])
        self.begin = np.concatenate((self.begin, held + np.cumsum(sizes) - sizes))
        self.total = np.concatenate((self.total, sizes))
        self.doc = np.concatenate([self.doc, *(n[0] for n in self.new)])
        self.ids = np.concatenate([self.ids, *(n[1] for n in self.new)])
        self.new, self.waiting = [], 0

    def flush(self, last: bool) -> pa.RecordBatch | None:
        self._join()
        size = len(self.ids)
        if not size:
            return None
        ends = self.begin + self.total
        at, penalty = candidates(size, ends[ends <= size], np.flatnonzero(self.ends_sentence[self.ids]) + 1)
        cuts = best_cuts(at, penalty, whole=last)
        if last:
            before = cuts[-2] if len(cuts) > 1 else 0
            cuts[-1:] = [before + e for e in tail_cuts(size - before)] if size - before < CAPACITY else [size]
        cuts = np.array(cuts, np.int64)
        done = int(cuts[-1])
        edges = np.unique(np.concatenate(([0, done], cuts, self.begin[(self.begin > 0) & (self.begin < done)])))
        start, length = edges[:-1], np.diff(edges)
        doc = np.searchsorted(self.begin, start, "right") - 1
        seq = np.searchsorted(cuts, start, "right")
        seq_start = np.concatenate(([0], cuts))[seq]
        data = self.ids[:done].astype("<i4").tobytes()
        batch = pa.record_batch([pa.array(self.doc[doc]), pa.array(start - self.begin[doc]), pa.array(length),
                                 pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer((edges * 4).astype(np.int32)), pa.py_buffer(data)]),
                                 pa.array(self.total[doc]), pa.array(self.sequence + seq), pa.array(start - seq_start)],
                                names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])
        self.sequence += len(cuts)
        live = ends > done
        self.ids = self.ids[done:]
        self.doc, self.begin, self.total = self.doc[live], self.begin[live] - done, self.total[live]
        return batch


def packed(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Pieces of sequences: ``doc_id, start, length, ids, doc_tokens, sequence_id, offset``.

    ``ids`` are little-endian 32-bit integers; ``path`` is the tokenizers file.
    """
    path = path or default_path()

    def run(batches):
        enc = encoder(path)
        stream = _Stream(enc.ends_sentence, TaskContext.get().partitionId() << 33)
        for batch in batches:
            doc_ids = batch.column(0).to_numpy(zero_copy_only=False)
            for a, b, ids, sizes in enc.batches(batch.column(1)):
                with_end = np.full(len(ids) + b - a, END, np.int32)
                ends = np.cumsum(sizes + 1) - 1
                keep = np.ones(len(with_end), bool)
                keep[ends] = False
                with_end[keep] = ids
                stream.add(doc_ids[a:b], with_end, sizes + 1)
                if stream.waiting >= STRETCH:
                    yield stream.flush(False)
        if (rest := stream.flush(True)) is not None:
            yield rest
    return docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).mapInArrow(run, SCHEMA)
