"""Cross-tokenizer alignment by interval coalescing (operator 11).

Two public vocabularies encode the same bytes, a space and the text: A by the
tokenizers library (byte-level BPE, control-token literals taken as text), B
by sentencepiece (which adds the space itself).  Every token is the interval
of the bytes it covers.

1. ``coalesce``: the intervals of both sides are lexsorted by start; a running
   maximum of their ends (``maximum.accumulate``) breaks them into groups
   wherever a start reaches it.  Within the groups every A token is expanded
   into the B tokens it overlaps: the links.
2. ``encoded``: every input partition is aligned in blocks of about ``BLOCK``
   bytes.  One table (written once) holds the documents with their different
   id pairs, and for every block the number of its documents that hold a pair.
3. ``aligned``: these numbers are summed by pair over the corpus, the highest
   of every A id is taken, and both go back to the blocks by a join on
   (block, pair): a pair costs one row a block however many documents hold it.
   A cogroup by block gives every document its sums.

A space or line feed that follows something else starts a new token in both
vocabularies, so a text is the concatenation of chunks that start with it, and
each different chunk is encoded once for a while (``Encoder``).  Where a
vocabulary does not have that property a whole text is one chunk.

Texts that are null, empty, or whose joined token bytes differ from the space
and the text (U+2581 in a text is one reason) have no tokens: counts 0, empty
``groups``.  Repeated rows and ids count as often as they occur; ties for the
highest count all count; very long texts are worked off in parts; an empty
table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenlake.llm.common import saved, shared_folder
from tokenlake.llm.words import gather, text_buffer

VOCABULARY_A, VOCABULARY_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
BLOCK = 8 << 20               # bytes of text whose pairs are counted together
PART = 1 << 20                # bytes that are aligned in one numpy call
CHUNKS = 1 << 16              # chunks of a long text that are aligned in one numpy call
MOST_CHUNKS = 400_000         # remembered chunks; then the memory starts anew

DOCUMENT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string"
_CHUNK = re.compile(r"[ \n]\s*\S*(?:[^\S \n]\s*\S*)*")


def default_paths() -> tuple[str, str]:
    import public_tokenizers
    return public_tokenizers.path(VOCABULARY_A), public_tokenizers.path(VOCABULARY_B)


def coalesce(a_len: np.ndarray, b_len: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Groups and links of two tokenisations of the same bytes, given their tokens' lengths.

    Returns the group number of every A and of every B token and the links as
    places ``(a, b)``, ordered by a, then b.
    """
    a_end, b_end = np.cumsum(a_len), np.cumsum(b_len)
    start, end = np.concatenate((a_end - a_len, b_end - b_len)), np.concatenate((a_end, b_end))
    order = np.lexsort((end, start))
    reach = np.maximum.accumulate(end[order])
    new = np.ones(len(order), bool)
    new[1:] = start[order][1:] >= reach[:-1]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(new) - 1
    first = np.searchsorted(b_end, a_end - a_len, "right")
    count = np.searchsorted(b_end - b_len, a_end, "left") - first
    return group[:len(a_len)], group[len(a_len):], np.repeat(np.arange(len(a_len)), count), gather(first, count)


def rendered(ids: np.ndarray, group: np.ndarray, is_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``a1,a2|b1;a3|b2,b3`` of tokens ordered by group, A before B: its bytes and every token's first byte.

    Every token is followed by its separator, the last one by ``;``.
    """
    digits = len(str(int(ids.max()))) if len(ids) else 1
    text = np.empty((len(ids), digits + 1), np.uint8)
    rest = ids.copy()
    for k in range(digits - 1, -1, -1):
        text[:, k] = 48 + rest % 10
        rest //= 10
    text[:, -1] = ord(",")
    text[:-1, -1][is_b[1:] & ~is_b[:-1]] = ord("|")
    text[:-1, -1][group[1:] != group[:-1]] = ord(";")
    text[-1:, -1] = ord(";")
    used = np.ones(text.shape, bool)
    for k in range(digits - 1):
        used[:, k] = ids >= 10 ** (digits - 1 - k)
    width = used.sum(1)
    return text[used], np.cumsum(width) - width


class Encoder:
    """Ids and byte lengths of both tokenisations; one per Python worker."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"       # the cores belong to Spark's tasks
        import sentencepiece
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        byte = {c: i for i, c in enumerate(_byte_characters())}
        size = self.a.get_vocab_size()
        written = [self.a.id_to_token(i) for i in range(size)]
        self.bytes = ([bytes(map(byte.__getitem__, t)) if all(c in byte for c in t) else b"" for t in written],
                      [self._piece(i) for i in range(self.b.get_piece_size())])
        self.a_len, self.b_len = (np.array([len(t) for t in x], np.int64) for x in self.bytes)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size()) if not self.b.is_byte(i)]
        self.splits = not any(re.search(r"[^\s▁]▁|\n", p) for p in pieces)
        self.space = self.b.piece_to_id("▁")
        self._forget()

    def _piece(self, i: int) -> bytes:
        p = self.b.id_to_piece(i)
        return bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else b"" if self.b.is_control(i) or self.b.is_unknown(i) else p.replace("▁", " ").encode()

    def _forget(self) -> None:
        self.places: dict[str, int] = {}
        none = np.zeros(0, np.int32)
        self.known = [(none, none.astype(np.int64)), (none, none.astype(np.int64))]      # ids, ids a chunk, of A and B
        self.first = [none.astype(np.int64), none.astype(np.int64)]
        self.equal = np.zeros(0, bool)

    def _one(self, chunk: str) -> tuple[list[int], list[int], bool]:
        """A chunk's ids of both sides, as they are inside a text, and whether their bytes are the chunk's."""
        a = self.a.encode(chunk, add_special_tokens=False).ids
        if chunk == " ":
            b = [self.space]
        else:
            b = self.b.encode(chunk.removeprefix(" "), num_threads=1)[chunk[0] != " ":]
        return a, b, all(b"".join(map(t.__getitem__, ids)) == chunk.encode() for t, ids in zip(self.bytes, (a, b)))

    def _many(self, chunks: list[str]) -> list | None:
        """Ids and ids a chunk of either side by one call for all (none ends with white space); None where bytes differ."""
        text = "".join(chunks)
        whole = text.encode()
        ends = np.cumsum([len(c.encode()) for c in chunks])
        a = self.a.encode_batch_fast([text], add_special_tokens=False)[0].ids
        b = self.b.encode("\n" + text, num_threads=1)[2:]                # without the added space and the line feed
        out = []
        for ids, t, size in zip((a, b), self.bytes, (self.a_len, self.b_len)):
            ids = np.array(ids, np.int32)
            at = np.cumsum(size[ids])
            last = np.searchsorted(at, ends)
            if b"".join(map(t.__getitem__, ids.tolist())) != whole or (at[last] != ends).any():
                return None
            out.append((ids, np.diff(last, prepend=-1)))
        return out

    def _learn(self, chunks: list[str]) -> None:
        chunks = sorted(chunks, key=lambda c: c[-1].isspace())
        joined = sum(not c[-1].isspace() for c in chunks) if self.splits else 0
        parts: list[list] = [[self.known[side]] for side in (0, 1)]
        equal = [self.equal]
        for i in range(0, len(chunks), 1024):
            some = chunks[i:i + 1024]
            made = self._many(some) if i + len(some) <= joined else None
            if made is None:
                own = [self._one(c) for c in some]
                made = [(np.array([t for x in own for t in x[side]], np.int32), np.array([len(x[side]) for x in own], np.int64)) for side in (0, 1)]
                equal.append(np.array([x[2] for x in own], bool))
            else:
                equal.append(np.ones(len(some), bool))
            for side in (0, 1):
                parts[side].append(made[side])
        for side in (0, 1):
            ids, count = (np.concatenate(x) for x in zip(*parts[side]))
            self.known[side] = (ids, count)
            self.first[side] = np.cumsum(count) - count
        self.equal = np.concatenate(equal)
        self.places.update(zip(chunks, range(len(self.places), len(self.places) + len(chunks))))

    def look_up(self, chunks: list[str]) -> np.ndarray:
        """Places of chunks, valid until the next call."""
        if len(self.places) > MOST_CHUNKS:
            self._forget()
        place = list(map(self.places.get, chunks))
        if None in place:
            self._learn(list(dict.fromkeys(c for c, p in zip(chunks, place) if p is None)))
            place = list(map(self.places.__getitem__, chunks))
        return np.array(place, np.int64)

    def chunks(self, text: str) -> list[str]:
        return _CHUNK.findall(" " + text) if self.splits else [" " + text]

    def tokens(self, side: int, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks, and the number of ids of each."""
        ids, count = self.known[side]
        return ids[gather(self.first[side][place], count[place])], count[place]


def _byte_characters() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte (fixed values).

    Printable Latin-1 characters stand for themselves, the other bytes are
    written, in order, as the characters from U+0100 on.
    """
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(i) if i in own else chr(next(others)) for i in range(256)]


class _Aligned:
    """Alignment of some documents laid end to end."""

    def __init__(self, enc: Encoder, place: np.ndarray, chunks_of: np.ndarray):
        """``chunks_of``: number of chunks of every document; ``place`` are theirs in turn."""
        n = len(chunks_of)
        (a, a_count), (b, b_count) = enc.tokens(0, place), enc.tokens(1, place)
        edge = np.concatenate(([0], np.cumsum(chunks_of)))
        a_edge, b_edge = (np.concatenate(([0], np.cumsum(c)))[edge] for c in (a_count, b_count))
        self.n_a, self.n_b = np.diff(a_edge), np.diff(b_edge)
        a_group, b_group, link_a, link_b = coalesce(enc.a_len[a], enc.b_len[b])
        groups = np.append(a_group, a_group[-1:] + 1)
        g_edge = groups[a_edge] if len(a) else np.zeros(n + 1, np.int64)
        self.n_groups = np.diff(g_edge)
        doc = np.repeat(np.arange(n), self.n_a)[link_a]
        self.n_links = np.bincount(doc, minlength=n)
        # the different pairs of every document, and how often it links them
        key = doc << 32 | a[link_a].astype(np.int64) * len(enc.b_len) + b[link_b]
        key.sort()
        new = np.flatnonzero(np.diff(key, prepend=-1))
        self.times = np.diff(new, append=len(key))
        self.pairs = key[new] & 0xFFFFFFFF
        self.pair_edge = np.searchsorted(key[new] >> 32, np.arange(n + 1))
        # text of the groups
        group = np.concatenate((a_group, b_group))
        order = np.argsort(group * 2 + (np.arange(len(group)) >= len(a)), kind="stable")
        data, first = rendered(np.concatenate((a, b))[order].astype(np.int64), group[order], order >= len(a))
        self.data = data.tobytes()
        self.text_edge = np.append(first, len(data))[a_edge + b_edge]

    def text(self, i: int) -> bytes:
        """Groups of document ``i``, each followed by ``;``."""
        return self.data[self.text_edge[i]:self.text_edge[i + 1]]


def _long(enc: Encoder, text: str, digest: bool):
    """A document of its own: ``(n_a, n_b, n_groups, n_links, groups, pairs, times)``, worked off in parts."""
    counts, parts, pairs, times = np.zeros(4, np.int64), [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    sha, rest = hashlib.sha256(), b""
    chunks = (m.group() for m in _CHUNK.finditer(" " + text)) if enc.splits else iter([" " + text])
    while own := list(islice(chunks, CHUNKS)):
        place = enc.look_up(own)
        if not enc.equal[place].all():
            return None
        some = _Aligned(enc, place, np.array([len(place)]))
        counts += [some.n_a[0], some.n_b[0], some.n_groups[0], some.n_links[0]]
        pairs.append(some.pairs)
        times.append(some.times)
        if digest:
            sha.update(rest + some.text(0)[:-1])
            rest = b";"
        else:
            parts.append(some.text(0))
    code, where = np.unique(np.concatenate(pairs), return_inverse=True)
    total = np.bincount(where, np.concatenate(times), len(code)).astype(np.int64)
    return (*counts.tolist(), sha.hexdigest() if digest else b"".join(parts)[:-1].decode(), code, total)


def _blocks(enc: Encoder, batches, digest: bool):
    """``(doc_ids, rows, codes, n_docs)``: the documents of a block, and the pairs they hold with their numbers."""
    rows: list[tuple] = []
    doc_ids: list = []
    size = 0

    def finished():
        code, where = np.unique(np.concatenate([np.zeros(0, np.int64), *(r[5] for r in rows)]), return_inverse=True)
        return doc_ids, rows, code, np.bincount(where, minlength=len(code))

    none = (0, 0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int64))
    for batch in batches:
        offsets = text_buffer(batch.column(1))[1]
        a = 0
        while a < batch.num_rows:
            b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + PART, "right")) - 1)
            texts = batch.column(1).slice(a, b - a).to_pylist()
            made: list = [none] * len(texts)
            if offsets[b] - offsets[a] > PART:
                made[0] = _long(enc, texts[0], digest) or none
            else:
                own = [enc.chunks(t) if t else [] for t in texts]
                place, of = enc.look_up([c for x in own for c in x]), np.fromiter(map(len, own), np.int64, len(own))
                bad = np.zeros(len(own), bool)
                bad[np.repeat(np.arange(len(own)), of)[~enc.equal[place]]] = True
                place = place[np.repeat(~(bad | (of == 0)), of)]
                good = np.flatnonzero(~bad & (of > 0))
                if len(good):
                    some = _Aligned(enc, place, of[good])
                    for k, i in enumerate(good.tolist()):
                        groups = some.text(k)[:-1]
                        p, q = some.pair_edge[k], some.pair_edge[k + 1]
                        made[i] = (some.n_a[k], some.n_b[k], some.n_groups[k], some.n_links[k],
                                   hashlib.sha256(groups).hexdigest() if digest else groups.decode(), some.pairs[p:q], some.times[p:q])
            rows += made
            doc_ids += batch.column(0).slice(a, b - a).to_pylist()
            size += offsets[b] - offsets[a]
            a = b
            if size >= BLOCK:
                yield finished()
                rows, doc_ids, size = [], [], 0
    if rows:
        yield finished()


_encoders: dict[tuple[str, str], Encoder] = {}


def _encoder(paths: tuple[str, str]) -> Encoder:
    if paths not in _encoders:
        _encoders[paths] = Encoder(*paths)
    return _encoders[paths]


def encoded(docs: DataFrame, paths: tuple[str, str] | None = None, digest: bool = False) -> DataFrame:
    """Documents and block counts in one table: ``kind`` 0 has a document's columns with its pairs as
    ascending differences (``codes``, ``times``: little-endian 32-bit integers), ``kind`` 1 the pairs of a
    block and how many of its documents hold each (``pairs``, ``n_docs``)."""
    paths = paths or default_paths()

    def run(batches):
        enc, block = _encoder(paths), TaskContext.get().partitionId() << 33
        for doc_ids, rows, code, n_docs in _blocks(enc, batches, digest):
            n = len(rows)
            columns = [pa.array([x[k] for x in rows], pa.int64()) for k in range(4)]
            yield pa.record_batch(
                [pa.array([0] * n, pa.int32()), pa.array([block] * n), pa.array(doc_ids, pa.int64()), *columns,
                 pa.array([x[4] for x in rows], pa.string()),
                 pa.array([np.diff(x[5], prepend=0).astype("<i4").tobytes() for x in rows], pa.binary()),
                 pa.array([x[6].astype("<i4").tobytes() for x in rows], pa.binary()),
                 pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.list_(pa.int32()))], names=names)
            if len(code):
                lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, t)) for x, t in ((code, pa.int64()), (n_docs, pa.int32()))]
                yield pa.record_batch([pa.array([1], pa.int32()), pa.array([block]), *(pa.nulls(1, pa.int64()) for _ in range(5)), pa.nulls(1, pa.string()),
                                       *(pa.nulls(1, pa.binary()) for _ in range(2)), *lists], names=names)
            block += 1
    schema = f"kind int, block long, {DOCUMENT}, codes binary, times binary, pairs array<long>, n_docs array<int>"
    names = [c.split()[0] for c in schema.split(", ")]
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def pair_counts(blocks: DataFrame, size_b: int) -> DataFrame:
    """``(pair, n, best)`` of all pairs: documents that hold it, and whether that is the highest number of its A id."""
    counts = saved(blocks.groupBy("pair").agg(F.sum("n_docs").alias("n")), "pair-counts")
    a = F.expr(f"pair div {size_b}")
    highest = counts.groupBy(a.alias("a")).agg(F.max("n").alias("highest"))
    return counts.withColumn("a", a).join(highest, "a").select("pair", "n", (F.col("n") == F.col("highest")).alias("best"))


def aligned(docs: DataFrame, paths: tuple[str, str] | None = None, digest: bool = False) -> DataFrame:
    """One row per document: ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups``.

    ``groups`` is the alignment as text (``a1,a2|b1;a3|b2,b3``: decimal A ids,
    then B ids, group after group); with ``digest`` the SHA-256 of it, so that
    long texts need not travel ('' where there are no tokens).
    """
    spark, paths = docs.sparkSession, paths or default_paths()
    folder = shared_folder(spark, "alignment")
    made = encoded(docs, paths, digest)
    made.write.option("compression", "zstd").partitionBy("kind").parquet(folder)
    made = spark.read.schema(made.schema).parquet(folder)
    blocks = (made.where("kind = 1").select("block", F.explode(F.arrays_zip("pairs", "n_docs")).alias("e"))
              .select("block", F.col("e.pairs").alias("pair"), F.col("e.n_docs").alias("n_docs")))
    counts = saved(pair_counts(blocks, len(_encoder(paths).b_len)), "pairs")
    found = blocks.select(F.col("block").alias("of"), "pair").join(counts, "pair")

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        pair, n, best = (right.column(c).to_numpy() for c in ("pair", "n", "best"))
        order = np.argsort(pair)
        pair, n, best = pair[order], n[order], best[order].astype(np.int64)
        n_best, count_sum = [], []
        for codes, times in zip(left.column("codes"), left.column("times")):
            at = np.searchsorted(pair, np.cumsum(np.frombuffer(codes.as_buffer(), "<i4"), dtype=np.int64))
            t = np.frombuffer(times.as_buffer(), "<i4").astype(np.int64)
            n_best.append(int((t * best[at]).sum()))
            count_sum.append(int((t * n[at]).sum()))
        return pa.table([*(left.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")), pa.array(n_best, pa.int64()),
                         pa.array(count_sum, pa.int64()), left.column("groups")], names=out)
    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"
    out = [c.split()[0] for c in schema.split(", ")]
    left = made.where("kind = 0").select("block", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "codes", "times")
    return left.groupBy("block").cogroup(found.groupBy("of")).applyInArrow(finish, schema)
