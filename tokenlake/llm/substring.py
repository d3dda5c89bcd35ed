"""Removal of passages that an earlier document already has (operator 8).

A window is 50 consecutive words of one document; a word goes if some window
over it also starts in a document with a smaller id.

1. ``pieces``: one pass over the texts.  Every window is assigned to the
   ten-word gram of smallest hash inside it (the leftmost of equals), so equal
   windows agree on that anchor wherever they stand.  Consecutive windows of
   one anchor form a piece, about 70 words long.
2. Anchors seen in one document only cannot matter and are dropped; of equal
   pieces only the one of the smallest document is read again.
3. Pieces are dealt to shards by anchor, so equal windows meet in one shard.
   An anchor with very many different pieces (a common line, each time between
   other words) would fill a shard: its windows are compared as 64-bit hashes
   in an aggregation instead, one short row a window (``_common_windows``), so
   the work stays in proportion to the text that holds it.
4. Every shard builds a compressed FM-index of its pieces: the Burrows-Wheeler
   transform in 64-word order, held as a wavelet matrix of packed bits with
   block ranks.  The pieces stream through it from right to left in
   lockstep: one backward-search step per word; after a window is matched its
   interval is widened to the 49-word parent by the marked class borders, so
   that the next step needs no restart.  Of the matched interval the smallest
   document is the window's owner.
5. Windows with an owner before the document give the spans to remove.

Null and empty texts have no words and come back empty; shorter documents
than a window lose nothing; repeated rows lose all their words but those of
the smallest id; an empty table gives an empty result; further columns are
ignored.  doc_id must be unique; rows with null doc_id are kept whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenlake.llm.common import saved
from tokenlake.llm.words import gather, mix, powers, range_hashes, text_buffer, word_blocks, word_bounds

WINDOW = 50
GRAM = 10
SHARD_WORDS = 400_000        # words of a shard, about
ANCHOR_PIECES = 2_000        # different pieces of an anchor that go to a shard
_POSITION = np.uint64((1 << 20) - 1)
_STEP = 1 << 19


def _anchors(h: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: first window, number of windows, gram hash.

    ``end[i]`` is the end of the document of word ``i``; under 2**20 words.
    """
    n = len(h) - WINDOW + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),)
    up, _ = powers(64)
    grams = np.zeros(len(h) - GRAM + 1, np.uint64)
    for j in range(GRAM):
        grams += h[j:j + len(grams)] * up[j + 1]
    grams = mix(grams)
    low = (grams & ~_POSITION) | np.arange(len(grams), dtype=np.uint64)
    span = WINDOW - GRAM + 1
    width = 1
    while 2 * width <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    low = np.minimum(low[:n], low[span - width:span - width + n])
    at = (low & _POSITION).astype(np.int64)
    ok = np.arange(n) + WINDOW <= end[:n]
    begin = ok.copy()
    begin[1:] &= ~ok[:-1] | (at[1:] != at[:-1])
    last = ok.copy()
    last[:-1] &= ~ok[1:] | (at[1:] != at[:-1])
    first = np.flatnonzero(begin)
    return first, np.flatnonzero(last) - first + 1, grams[at[first]]


def pieces(docs: DataFrame) -> DataFrame:
    """``(anchor, piece, doc_id, start, windows)``: content keys of the pieces of every document."""
    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for a, _, block in word_blocks(batch.column(1)):
                h, total = block.hashes, len(block.hashes)
                end = np.repeat(block.first[1:], block.counts)
                # a text of over half a million words: in steps that overlap by a window
                for lo in range(0, max(1, total - WINDOW + 1), _STEP) if total >= 1 << 20 else (0,):
                    hi = min(total, lo + _STEP + WINDOW - 1) if total >= 1 << 20 else total
                    first, windows, gram = _anchors(h[lo:hi], np.minimum(end[lo:hi], hi) - lo)
                    if not len(first):
                        continue
                    first = first + lo
                    doc = np.searchsorted(block.first, first, "right") - 1
                    content = range_hashes(h, first, first + windows + WINDOW - 1)
                    yield pa.record_batch([pa.array(gram.view(np.int64)), pa.array(content.view(np.int64)), pa.array(ids[a + doc]),
                                           pa.array((first - block.first[doc]).astype(np.int32)), pa.array(windows.astype(np.int32))],
                                          names=["anchor", "piece", "doc_id", "start", "windows"])
    return (docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
            .mapInArrow(run, "anchor long, piece long, doc_id long, start int, windows int"))


def _piece_texts(rows: DataFrame, shards: int) -> DataFrame:
    """Words of the wanted pieces, dealt to shards by anchor."""
    def run(batches):
        for batch in batches:
            wanted = batch.column(2)
            ids = batch.column(0).to_pylist()
            out = {k: [] for k in ("shard", "anchor", "piece", "owner", "words")}
            for a, b, block in word_blocks(batch.column(1)):
                for i in range(a, b):
                    at = int(block.first[i - a])
                    for w in wanted[i].as_py():
                        x = at + w["start"]
                        y = x + w["windows"] + WINDOW - 1
                        key = mix(np.array([w["anchor"]], np.int64).view(np.uint64))
                        out["shard"].append(int(key[0] % np.uint64(shards)))
                        out["anchor"].append(w["anchor"])
                        out["piece"].append(w["piece"])
                        out["owner"].append(ids[i])
                        out["words"].append(b" ".join(block.data[block.starts[x]:block.ends[y - 1]].tobytes().split()).decode())
            yield pa.record_batch([pa.array(out["shard"], pa.int32()), pa.array(out["anchor"], pa.int64()), pa.array(out["piece"], pa.int64()),
                                   pa.array(out["owner"], pa.int64()), pa.array(out["words"], pa.string())], names=list(out))
    return rows.mapInArrow(run, "shard int, anchor long, piece long, owner long, words string")


def _window_hashes(rows: DataFrame) -> DataFrame:
    """``(anchor, piece, owner, last, first, hash)``: every window of the wanted pieces."""
    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for a, b, block in word_blocks(batch.column(1)):
                flat = [(i - a, w) for i in range(a, b) for w in batch.column(2)[i].as_py()]
                if not flat:
                    continue
                doc = np.array([i for i, _ in flat], np.int64)
                start, windows, anchor, piece, last = (np.array([w[k] for _, w in flat], np.int64) for k in ("start", "windows", "anchor", "piece", "last"))
                row = np.repeat(np.arange(len(flat)), windows)
                at = gather(block.first[doc] + start, windows)
                hashes = range_hashes(block.hashes, at, at + WINDOW)
                yield pa.record_batch([pa.array(anchor[row]), pa.array(piece[row]), pa.array(ids[a + doc][row]), pa.array(last[row]),
                                       pa.array((at - (block.first[doc] + start)[row]).astype(np.int32)), pa.array(hashes.view(np.int64))],
                                      names=["anchor", "piece", "owner", "last", "first", "hash"])
    return rows.mapInArrow(run, "anchor long, piece long, owner long, last long, first int, hash long")


def _common_windows(rows: DataFrame) -> DataFrame:
    """``(anchor, piece, first, n, owner)`` for pieces of anchors with very many pieces: windows that two documents hold, by hash."""
    windows = saved(_window_hashes(rows), "common-windows")
    # written, so that the join can be split at a window that very many documents hold
    shared = saved(windows.groupBy("hash").agg(F.min("owner").alias("lowest"), F.max("last").alias("hi")).where("lowest < hi").select("hash", "lowest"),
                   "shared-windows")
    return windows.join(shared, "hash").select("anchor", "piece", "first", F.lit(1).alias("n"), F.col("lowest").alias("owner"))


class FMIndex:
    """Wavelet-matrix FM-index of an integer text in ``DEPTH``-symbol suffix order.

    Patterns of up to ``DEPTH`` symbols are matched exactly by backward
    search; suffixes that agree on ``DEPTH`` symbols may stand in any order.
    """

    DEPTH = 64

    def __init__(self, text: np.ndarray):
        n = self.n = len(text)
        rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
        self.symbols = int(text.max()) + 1
        width = 1
        while width < self.DEPTH:
            follow = np.zeros(n, np.int64)
            follow[:-width] = rank[width:] + 1
            key = rank * (n + 1) + follow
            order = np.argsort(key, kind="stable")
            ordered = key[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.concatenate(([0], np.cumsum(ordered[1:] != ordered[:-1])))
            width *= 2
            if width == 32:
                self._rank32 = rank
        self.suffixes = order
        symbols = text[order - 1]                       # the transform
        self.before = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=self.symbols))))[:-1]
        self.levels = max(1, int(self.symbols - 1).bit_length())
        self.bits, self.ranks, self.zeros = [], [], []
        for level in range(self.levels - 1, -1, -1):
            bit = (symbols >> level) & 1
            packed = np.packbits(bit.astype(np.uint8), bitorder="little")
            packed = np.concatenate((packed, np.zeros(-len(packed) % 8 + 8, np.uint8))).view(np.uint64)
            self.bits.append(packed)
            self.ranks.append(np.concatenate(([0], np.cumsum(np.bitwise_count(packed).astype(np.int64))))[:-1])
            self.zeros.append(n - int(bit.sum()))
            symbols = np.concatenate((symbols[bit == 0], symbols[bit == 1]))
        self.base = self._descend(np.zeros(self.symbols, np.int64), np.arange(self.symbols))

    def _descend(self, at: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        for k in range(self.levels):
            word = at >> 6
            mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
            ones = self.ranks[k][word] + np.bitwise_count(self.bits[k][word] & mask)
            at = np.where((symbol >> (self.levels - 1 - k)) & 1, self.zeros[k] + ones, at - ones)
        return at

    def extend(self, lo: np.ndarray, hi: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of ``symbol`` + pattern from the intervals of the patterns."""
        both = self._descend(np.concatenate((lo, hi)), np.concatenate((symbol, symbol)))
        shift = self.before[symbol] - self.base[symbol]
        return both[:len(lo)] + shift, both[len(lo):] + shift

    def class_starts(self, length: int) -> np.ndarray:
        """Marks the suffixes whose first ``length`` (33 to 64) symbols differ from the one before."""
        far = np.full(self.n, -1, np.int64)
        far[:self.n - (length - 32)] = self._rank32[length - 32:]
        a, b = self._rank32[self.suffixes], far[self.suffixes]
        return np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))


def window_owners(words: pa.Array, owners: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Smallest owner of every window of every piece, by matching the pieces against their FM-index.

    Returns the owners of all windows, piece after piece, and the number of windows of each piece.
    """
    split = pc.split_pattern(words, " ")
    if isinstance(split, pa.ChunkedArray):
        split = split.combine_chunks()
    length = pc.list_value_length(split).to_numpy().astype(np.int64)
    codes = split.flatten().dictionary_encode().indices.to_numpy().astype(np.int64) + 2
    m = len(length)
    place = np.cumsum(length + 1) - (length + 1)             # a separator (1) ends every piece
    text = np.ones(int(length.sum()) + m + 1, np.int64)
    text[-1] = 0
    text[gather(place, length)] = codes
    index = FMIndex(text)
    piece_of = np.repeat(np.arange(m), length + 1)
    piece_of = np.concatenate((piece_of, [0]))
    owner_at = owners[piece_of][index.suffixes]
    starts = np.flatnonzero(index.class_starts(window))
    smallest = np.minimum.reduceat(owner_at, starts)
    parents = np.flatnonzero(index.class_starts(window - 1))
    parent_end = np.append(parents[1:], index.n)

    windows = length - window + 1
    first = np.cumsum(windows) - windows
    result = np.zeros(int(windows.sum()), np.int64)
    by_length = np.argsort(-length, kind="stable")
    ordered = length[by_length]
    lo, hi = np.zeros(m, np.int64), np.full(m, index.n, np.int64)
    for step in range(int(ordered[0])):
        live = int(np.searchsorted(-ordered, -step, "left"))  # pieces longer than step
        lo, hi, who = lo[:live], hi[:live], by_length[:live]
        if step >= window:
            parent = np.searchsorted(parents, lo, "right") - 1
            lo, hi = parents[parent], parent_end[parent]
        lo, hi = index.extend(lo, hi, text[place[who] + length[who] - 1 - step])
        if step >= window - 1:
            found = smallest[np.searchsorted(starts, lo, "right") - 1]
            result[first[who] + windows[who] - 1 - (step - window + 1)] = found
    return result, windows


def _owners(texts: DataFrame) -> DataFrame:
    """``(anchor, piece, first, windows, owner)``: runs of windows of one owner within a piece."""
    def run(key, table):
        owners, windows = window_owners(table.column("words").combine_chunks(), table.column("owner").to_numpy())
        row = np.repeat(np.arange(len(windows)), windows)
        new = np.flatnonzero(np.concatenate(([True], (owners[1:] != owners[:-1]) | (row[1:] != row[:-1]))))
        count = np.diff(np.append(new, len(owners)))
        begin = np.cumsum(windows) - windows
        at = row[new]
        offset = new - begin[at]
        return pa.table({"anchor": table.column("anchor").take(pa.array(at)), "piece": table.column("piece").take(pa.array(at)),
                         "first": pa.array(offset.astype(np.int32)), "n": pa.array(count.astype(np.int32)), "owner": pa.array(owners[new])})
    return texts.groupBy("shard").applyInArrow(run, "anchor long, piece long, first int, n int, owner long")


def repeated_spans(docs: DataFrame) -> DataFrame:
    """``(doc_id, spans)``: word intervals ``[from, to)`` to remove, one per run of windows; may overlap."""
    found = saved(pieces(docs), "pieces")
    # aggregates are written before they are joined, so that a join can be split at a very common key
    shared = saved(found.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
                   .where("lo < hi").select("anchor"), "shared-anchors")
    found = saved(found.join(shared, "anchor"), "shared-pieces")
    first = (found.groupBy("anchor", "piece").agg(F.min(F.struct("doc_id", "start", "windows")).alias("f"), F.max("doc_id").alias("last"))
             .select("anchor", "piece", "f.*", "last"))
    first = saved(first, "first-pieces")
    common = saved(first.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > ANCHOR_PIECES).select("anchor"), "common-anchors")

    def texts(own: DataFrame, *columns: str) -> DataFrame:
        wanted = own.groupBy("doc_id").agg(F.collect_list(F.struct("anchor", "piece", "start", "windows", *columns)).alias("wanted"))
        return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(wanted, "doc_id")
    own = first.join(common, "anchor", "left_anti")
    words = own.agg(F.sum(F.col("windows") + WINDOW - 1)).first()[0] or 0
    owners = (_owners(_piece_texts(texts(own), 1 + words // SHARD_WORDS))
              .unionByName(_common_windows(texts(first.join(common, "anchor", "left_semi"), "last"))))
    return (found.join(owners, ["anchor", "piece"]).where("owner < doc_id")
            .groupBy("doc_id").agg(F.collect_list(F.struct((F.col("start") + F.col("first")).alias("from"),
                                                           (F.col("start") + F.col("first") + F.col("n") + WINDOW - 1).alias("to"))).alias("spans")))


def without_repeats(docs: DataFrame, layout: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept)`` of every row, and the columns ``carry``.

    ``kept`` holds the kept words joined by one space or, with ``layout``,
    the text with the removed words and the space after them cut out
    (untouched texts stay as they are, null stays null).
    """
    def run(batches):
        for batch in batches:
            spans = batch.column(2)
            n_words, n_removed, kept = [], [], []
            data, offsets = text_buffer(batch.column(1))
            valid = batch.column(1).is_valid().to_pylist()
            for i in range(batch.num_rows):
                piece = data[offsets[i]:offsets[i + 1]]
                cut = spans[i].as_py()
                if not cut:
                    words = piece.tobytes().split()
                    n_words.append(len(words))
                    n_removed.append(0)
                    kept.append((piece.tobytes() if valid[i] else None) if layout else b" ".join(words))
                    continue
                starts, ends = word_bounds(piece, np.zeros(1, np.int64))
                edge = np.zeros(len(starts) + 1, np.int64)
                np.add.at(edge, [s["from"] for s in cut], 1)
                np.add.at(edge, [s["to"] for s in cut], -1)
                gone = np.cumsum(edge)[:-1] > 0
                n_words.append(len(starts))
                n_removed.append(int(gone.sum()))
                if layout:
                    follow = np.append(starts[1:], len(piece))
                    mark = np.zeros(len(piece) + 1, np.int64)
                    np.add.at(mark, starts[gone], 1)
                    np.add.at(mark, follow[gone], -1)
                    kept.append(piece[np.cumsum(mark)[:-1] == 0].tobytes())
                else:
                    raw = piece.tobytes()
                    kept.append(b" ".join([raw[s:e] for s, e in zip(starts[~gone].tolist(), ends[~gone].tolist())]))
            yield pa.record_batch([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
                                   pa.array([None if k is None else k.decode() for k in kept], pa.string()), *batch.columns[3:]], names=names)
    spans = saved(repeated_spans(docs), "spans").withColumnRenamed("doc_id", "doc_id with spans")
    rows = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text to cut"), *carry)
            .join(spans, F.col("doc_id") == F.col("doc_id with spans"), "left")
            .select("doc_id", "text to cut", "spans", *carry))
    out = T.StructType([*(T.StructField(k, T.LongType()) for k in ("doc_id", "n_words", "n_removed")), T.StructField("kept", T.StringType()),
                        *rows.schema.fields[3:]])
    names = out.fieldNames()
    return rows.mapInArrow(run, out)
