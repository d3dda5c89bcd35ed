"""Best-fit packing with swap-based local search (operator 12).

Every document (its ids, then id 0) is one item; only one of more than
``CAPACITY`` ids is cut, into pieces of ``CAPACITY`` and a rest.  Full pieces
are sequences of their own.  The other items of an input partition are packed
pool by pool (about ``POOL`` ids):

1. ``best_fit``: items by falling size, each into the fullest bin that takes it;
2. ``improve``: while there are more bins than the ids need, the emptiest bin
   gives to the others: it moves an item, exchanges one for one, or two for one,
   always so that the receiving bin gains what the emptiest one loses.  Each
   step increases the sum of squared fills, as the receiver is the fuller bin,
   and bins empty.  A pool ends at the least possible number of bins, where no
   step is left for ``GIVE_UP`` bins in turn, or after ``EFFORT`` steps a bin;
3. the emptiest bins (at most ``REST`` with more than ``SLACK`` free ids) stay
   open: their items go to the next pool.

The open bins of the last pools are written with the rest, marked, and packed
again in groups of ``FAN`` partitions, these in groups of ``FAN`` groups, until
one group is left: a group holds at most ``FAN * REST`` bins, however large
the table.

Null and empty texts are their id 0 alone; repeated rows are packed as often as
they occur; ties are packed in the order of the rows; ids of documents may be
null; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenlake.llm.common import saved
from tokenlake.llm.tokenize import default_path, encoder

CAPACITY = 2048
END = 0
POOL = 1 << 20
SLACK, REST, FAN = 16, 16, 64
GIVE_UP, EFFORT = 8, 8

PIECES = "doc_id long, piece int, start long, length long, ids binary, sequence_id long, offset long"
MARKED = f"{PIECES}, part long, open boolean"


def best_fit(sizes: np.ndarray, capacity: int = CAPACITY) -> list[list[int]]:
    """Items (places in ``sizes``) of every bin: by falling size, each into the fullest bin that takes it."""
    bins: list[list[int]] = []
    free: list[list[int]] = [[] for _ in range(capacity + 1)]      # bins by free space
    spaces = 0                                                     # bit r: a bin with r free
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fitting = spaces >> size
        if fitting:
            space = size + (fitting & -fitting).bit_length() - 1
            k = free[space].pop()
            if not free[space]:
                spaces ^= 1 << space
            bins[k].append(i)
        else:
            space, k = capacity, len(bins)
            bins.append([i])
        free[space - size].append(k)
        spaces |= 1 << space - size
    return bins


class _Search:
    """Local search over the bins of a pool."""

    def __init__(self, sizes: np.ndarray, bins: list[list[int]], capacity: int):
        self.sizes, self.capacity = sizes.astype(np.int64), capacity
        self.bin = np.empty(len(sizes), np.int64)
        for k, own in enumerate(bins):
            self.bin[own] = k
        self.fill = np.bincount(self.bin, self.sizes, len(bins)).astype(np.int64)

    def _shift(self, into: int, out: int, given: list[int], taken: list[int]) -> None:
        self.bin[given], self.bin[taken] = into, out
        gain = int(self.sizes[given].sum() - self.sizes[taken].sum())
        self.fill[into] += gain
        self.fill[out] -= gain

    def step(self, out: int) -> bool:
        """The best step that takes from bin ``out``, the emptiest; False if there is none."""
        own = np.flatnonzero(self.bin == out)
        own = own[np.argsort(self.sizes[own], kind="stable")]
        y = self.sizes[own]
        free = np.where((self.fill > 0) & (self.fill >= self.fill[out]), self.capacity - self.fill, 0)
        free[out] = 0
        # move: the largest item that some bin takes, into the fullest of them
        k = int(np.searchsorted(y, free.max(), "right")) - 1
        if k >= 0:
            fits = np.flatnonzero(free >= y[k])
            self._shift(int(fits[np.argmin(free[fits])]), out, [own[k]], [])
            return True
        # exchange for one item of an underfull bin: one, then two
        others = np.flatnonzero(free[self.bin] > 0)
        x, room = self.sizes[others], free[self.bin[others]]
        i, j = np.triu_indices(len(own), 1)
        for value, members in ((y, own[:, None]), (y[i] + y[j], np.stack((own[i], own[j]), 1))):
            if not len(value) or not len(others):
                continue
            order = np.argsort(value, kind="stable")
            at = np.searchsorted(value[order], x + room, "right") - 1
            gain = np.where(at >= 0, value[order][at] - x, 0)
            best = int(np.argmax(gain))
            if gain[best] > 0:
                self._shift(int(self.bin[others[best]]), out, members[order[at[best]]].tolist(), [int(others[best])])
                return True
        return False

    def improve(self) -> None:
        least = -(-int(self.sizes.sum()) // self.capacity)
        stuck: list[int] = []
        steps = EFFORT * len(self.fill)
        while np.count_nonzero(self.fill) > least and len(stuck) < GIVE_UP and steps:
            steps -= 1
            fill = np.where(self.fill > 0, self.fill, self.capacity + 1)
            fill[stuck] = self.capacity + 1
            out = int(np.argmin(fill))
            if fill[out] >= self.capacity:
                break
            if not self.step(out):
                stuck.append(out)


def pack(sizes: np.ndarray, capacity: int = CAPACITY) -> list[list[int]]:
    """Items of every bin after best fit and local search, the fullest bin first."""
    search = _Search(sizes, best_fit(sizes, capacity), capacity)
    search.improve()
    order = np.lexsort((np.arange(len(sizes)), search.bin, -search.fill[search.bin]))
    cuts = np.flatnonzero(np.diff(search.bin[order])) + 1
    return [own.tolist() for own in np.split(order, cuts)]


class _Packer:
    """Items that wait for a bin, and the numbers of the next sequences."""

    def __init__(self, part: int, first_sequence: int):
        self.part, self.sequence = part, first_sequence
        self.items: list[tuple] = []              # doc_id, piece, start, length, ids
        self.waiting = 0

    def add(self, item: tuple) -> None:
        self.items.append(item)
        self.waiting += item[3]

    def _rows(self, bins: list[list[tuple]], is_open: bool) -> list[tuple]:
        rows = []
        for own in bins:
            offset = 0
            for item in own:
                rows.append((*item, self.sequence, offset, self.part, is_open))
                offset += item[3]
            self.sequence += 1
        return rows

    def alone(self, item: tuple) -> tuple:
        return self._rows([[item]], False)[0]

    def flush(self, last: bool, whole: bool = False) -> list[tuple]:
        """Rows of packed bins; the open ones wait on, or at the ``last`` flush are marked (``whole``: not)."""
        if not self.items:
            return []
        bins = [[self.items[i] for i in own] for own in pack(np.array([x[3] for x in self.items]))]
        loose = [k for k, own in enumerate(bins) if sum(x[3] for x in own) < CAPACITY - SLACK][-REST:]
        held = [] if whole else [bins[k] for k in loose]
        rows = self._rows([own for k, own in enumerate(bins) if whole or k not in set(loose)], False)
        self.items = []
        if last:
            return rows + self._rows(held, True)
        self.items = [x for own in held for x in own]
        self.waiting = sum(x[3] for x in self.items)
        return rows


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


ARROW = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()),
                   ("sequence_id", pa.int64()), ("offset", pa.int64()), ("part", pa.int64()), ("open", pa.bool_())])


def _first_round(docs: DataFrame, path: str) -> DataFrame:
    def run(batches):
        enc, part = encoder(path), TaskContext.get().partitionId()
        packer = _Packer(part, part << 33)
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for a, b, ids, sizes in enc.batches(batch.column(1)):
                rows, data, at = [], ids.astype("<i4").tobytes(), 0
                for doc_id, n in zip(doc_ids[a:b], (sizes * 4).tolist()):
                    raw = data[at:at + n] + END.to_bytes(4, "little")
                    at += n
                    for piece, start in enumerate(range(0, len(raw) // 4, CAPACITY)):
                        own = raw[start * 4:(start + CAPACITY) * 4]
                        item = (doc_id, piece, start, len(own) // 4, own)
                        if item[3] == CAPACITY:
                            rows.append(packer.alone(item))
                        else:
                            packer.add(item)
                    if packer.waiting >= POOL:
                        rows += packer.flush(False)
                if rows:
                    yield _batch(rows, ARROW)
        if rows := packer.flush(True):
            yield _batch(rows, ARROW)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, MARKED)


def _next_round(rest: DataFrame, number: int, groups: int) -> DataFrame:
    def run(table: pa.Table) -> pa.Table:
        group = table.column("group")[0].as_py()
        packer = _Packer(group, (number << 58) + (group << 30))
        table = table.sort_by([(c, "ascending") for c in ("part", "sequence_id", "offset")])
        for row in zip(*(table.column(c).to_pylist() for c in ("doc_id", "piece", "start", "length", "ids"))):
            packer.add(row)
        return pa.Table.from_batches([_batch(packer.flush(True, whole=groups == 1), ARROW)])
    return rest.withColumn("group", F.expr(f"part div {FAN}")).groupBy("group").applyInArrow(run, MARKED)


def packed(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Pieces of sequences: ``doc_id, piece, start, length, ids, sequence_id, offset``.

    ``ids`` are little-endian 32-bit integers; ``path`` is the tokenizers file.
    """
    made = saved(_first_round(docs, path or default_path()), "packed")
    done = [made.where("not open")]
    parts, number = (made.agg(F.max("part")).first()[0] or 0) + 1, 0
    while made is not None:
        groups, number = -(-parts // FAN), number + 1
        made = saved(_next_round(made.where("open"), number, groups), "packed-again")
        done.append(made.where("not open"))
        parts, made = groups, made if groups > 1 else None
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select("doc_id", "piece", "start", "length", "ids", "sequence_id", "offset")
