"""Near-duplicate documents by HyperMinHash sketches (operator 6).

A document's set holds its distinct five-word shingles (A-Z lower-cased);
with one to four words, the whole word sequence is its one shingle; without
words or with null text the set is empty and links with nothing.

1. ``sketches``: one pass over the texts.  A shingle is a 64-bit hash; its
   top seven bits choose one of 128 buckets and the smallest remainder of a
   bucket is stored as leading-zero count plus ten mantissa bits (two bytes).
   A small set would leave most buckets empty, so sets under 512 (86)
   shingles are sketched with 8 (64) seeds per shingle; sets near a border
   get both sketches, so that any two sets within the threshold share one.
2. Copies (equal set size and 128-bit set digest) collapse to the smallest id.
3. Bands of four registers (exactly 64 bits) are the candidate buckets:
   two sets of similarity 0.75 share none of the 32 bands with a chance of
   5e-6.  Each representative is paired with the smallest id of its buckets
   (no pairs within a bucket), the register estimate, corrected for chance
   collisions, drops pairs under ``ESTIMATE``, and the best pair of each
   document is verified on full sets.
4. Buckets that still hold several components are finished exactly: their
   members are dealt into small blocks, every pair of blocks compares
   members of different components (each two documents only in the first band
   they share).  Sets under 128 shingles are compared exactly there; of other
   pairs, what passes the estimate of a finer sketch (1024 one-byte
   registers) is verified on full sets.  No cap on members or partners.
5. Components of the verified links; ``component_id`` is the smallest id.

Nulls, empty texts, repeated rows of equal text, empty tables and further
columns are fine; doc_id must be unique and not null (rows with null doc_id
are returned as their own component with null ids).  The bands and estimates are
made for a threshold of 75 per cent: a higher one loses nothing, a lower one
is refused.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenlake.llm.common import components, saved
from tokenlake.llm.words import mix, powers, word_blocks

WORDS = 5
THRESHOLD = 75            # per cent
BUCKETS = 128
ROWS = 4
MANTISSA = 10
ESTIMATE = 0.55           # five standard deviations of the estimate below 0.75
FINE = 1024
FINE_ESTIMATE = 0.68      # nearly five standard deviations below 0.75, for sets of 96 shingles or more
EXACT = 128               # smaller sets go to step 4 whole, in no more bytes than the sketch; with one of this size, both have 96 within the threshold
FINE_CHANCE = 1 / 48      # that different smallest hashes agree in a one-byte register
SCHEMES = ((512, 1 << 62, 1), (64, 683, 8), (1, 86, 64))   # sizes from, under; seeds per shingle
BLOCK_ROWS = 512          # members of a block in step 4
GROUP = 32                # members verified against one set in a task group

_SEEDS = mix(np.arange(1, 65, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def shingle_sets(texts: pa.Array, words: int = WORDS) -> Iterator[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of every text."""
    up, _ = powers(64)
    for a, b, block in word_blocks(texts, lower=True):
        h = block.hashes
        grams = np.zeros(max(0, len(h) - words + 1), np.uint64)
        for j in range(words):
            grams += h[j:j + len(grams)] * up[j + 1]
        grams = mix(grams)
        for i in range(b - a):
            lo, hi = int(block.first[i]), int(block.first[i + 1])
            if hi - lo >= words:
                s = np.sort(grams[lo:hi - words + 1])
                yield s[np.concatenate(([True], s[1:] != s[:-1]))]
            elif hi > lo:
                whole = (h[lo:hi] * up[1:hi - lo + 1]).sum(dtype=np.uint64, keepdims=True)
                yield mix(whole ^ np.uint64(hi - lo))
            else:
                yield np.zeros(0, np.uint64)


def registers(shingles: np.ndarray, seeds: int) -> np.ndarray:
    """128 registers of a set: 0 if empty, else leading zeros and mantissa bits, plus 1."""
    draws = mix(shingles) if seeds == 1 else mix((shingles[:, None] ^ _SEEDS[None, :seeds]).ravel())
    draws.sort()
    bucket = (draws >> np.uint64(57)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
    rest = (draws[first] & np.uint64((1 << 57) - 1)) >> np.uint64(5)              # 52 bits: exact as a double
    zeros = 52 - np.frexp(rest.astype(np.float64))[1].astype(np.int64)
    mantissa = ((rest << (zeros + 1).astype(np.uint64)) & np.uint64((1 << 52) - 1)) >> np.uint64(52 - MANTISSA)
    out = np.zeros(BUCKETS, np.uint16)
    out[bucket[first]] = (zeros << MANTISSA) + mantissa.astype(np.int64) + 1
    return out


def fine_registers(shingles: np.ndarray) -> np.ndarray:
    """1024 one-byte registers of a set (one seed): 0 if empty, else four bits of leading zeros and of mantissa, plus 1."""
    bucket = (shingles >> np.uint64(54)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
    rest = (shingles[first] & np.uint64((1 << 54) - 1)) >> np.uint64(2)
    zeros = 52 - np.frexp(rest.astype(np.float64))[1].astype(np.int64)
    mantissa = ((rest << (zeros + 1).astype(np.uint64)) & np.uint64((1 << 52) - 1)) >> np.uint64(48)
    out = np.zeros(FINE, np.uint8)
    out[bucket[first]] = np.minimum(zeros, 14) * 16 + mantissa.astype(np.int64) + 1
    return out


def fine_estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard estimate of fine register rows, without the matches expected by chance."""
    has_a, has_b = a > 0, b > 0
    equal = ((a == b) & has_a).sum(-1)
    differ = (has_a & has_b).sum(-1) - equal
    return (equal - differ * (FINE_CHANCE / (1 - FINE_CHANCE))) / np.maximum(1, (has_a | has_b).sum(-1))


def shared_counts(sets: np.ndarray, sizes: np.ndarray, own: np.ndarray) -> np.ndarray:
    """How many members of a sorted set every row of ``sets`` (distinct hashes, ``sizes`` of them, padded) has."""
    pos = np.minimum(np.searchsorted(own, sets), len(own) - 1)
    return ((own[pos] == sets) & (np.arange(sets.shape[1]) < sizes[:, None])).sum(-1)


def estimate(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Jaccard estimate of register rows, without the matches expected by chance."""
    filled = ((a > 0) | (b > 0)).sum(-1)
    equal = ((a == b) & (a > 0)).sum(-1)
    ratio = size_a / np.maximum(size_b, 1)
    chance = 0.169919487159739 * BUCKETS / 2 ** MANTISSA * 4 * ratio / (1 + ratio) ** 2
    return np.maximum(0, equal - chance) / np.maximum(1, filled)


SKETCH = "doc_id long, n_shingles long, digest1 long, digest2 long, r0 binary, r1 binary, r2 binary, fine binary"


def sketches(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_shingles, digest1, digest2, r0, r1, r2, fine)`` of every row; ``fine`` of a set under ``EXACT`` is the set."""
    def run(batches):
        for batch in batches:
            rows = []
            for s in shingle_sets(batch.column(1)):
                n = len(s)
                regs = [registers(s, k).tobytes() if lo <= n < hi else None for lo, hi, k in SCHEMES]
                rows.append((n, int(mix(s).sum(dtype=np.uint64)), int(np.bitwise_xor.reduce(mix(s ^ _SEEDS[3]))) if n else 0, *regs,
                             (s if n < EXACT else fine_registers(s)).tobytes() if n else None))
            n, d1, d2, r0, r1, r2, fine = zip(*rows) if rows else [()] * 7
            yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()),
                                   pa.array(np.array(d1, np.uint64).view(np.int64)), pa.array(np.array(d2, np.uint64).view(np.int64)),
                                   pa.array(r0, pa.binary()), pa.array(r1, pa.binary()), pa.array(r2, pa.binary()), pa.array(fine, pa.binary())],
                                  names=["doc_id", "n_shingles", "digest1", "digest2", "r0", "r1", "r2", "fine"])
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SKETCH)


def band_rows(reps: DataFrame) -> DataFrame:
    """``(band, value, id)``: band number over the schemes, and the four registers as a long."""
    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for k in range(len(SCHEMES)):
                col = batch.column(1 + k)
                has = np.flatnonzero(np.asarray(col.is_valid()))
                if not len(has):
                    continue
                values = np.frombuffer(b"".join(col.take(pa.array(has)).to_pylist()), np.int64).reshape(len(has), BUCKETS // ROWS)
                at, band = np.nonzero(values)
                yield pa.record_batch([pa.array((band + k * (BUCKETS // ROWS)).astype(np.int32)),
                                       pa.array(values[at, band]), pa.array(ids[has[at]])], names=["band", "value", "id"])
    return reps.select("doc_id", "r0", "r1", "r2").mapInArrow(run, "band int, value long, id long")


def _estimated(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` with the register estimate, those under ``ESTIMATE`` left out."""
    sk = reps.select("doc_id", "n_shingles", "r0", "r1", "r2")
    named = [sk.select(*(F.col(c).alias(f"{c}_{side}") for c in sk.columns)) for side in "ab"]
    both = (pairs.join(named[0], F.col("a") == F.col("doc_id_a")).join(named[1], F.col("b") == F.col("doc_id_b")))

    def run(batches):
        for batch in batches:
            t = batch.to_pydict()
            keep, est = [], []
            for i in range(batch.num_rows):
                for k in ("r0", "r1", "r2"):
                    x, y = t[f"{k}_a"][i], t[f"{k}_b"][i]
                    if x is not None and y is not None:
                        e = float(estimate(np.frombuffer(x, np.uint16), np.frombuffer(y, np.uint16),
                                           np.float64(t["n_shingles_a"][i]), np.float64(t["n_shingles_b"][i])))
                        if e >= ESTIMATE:
                            keep.append(i)
                            est.append(e)
                        break
            yield pa.record_batch([pa.array([t["a"][i] for i in keep], pa.int64()), pa.array([t["b"][i] for i in keep], pa.int64()),
                                   pa.array(est, pa.float64())], names=["a", "b", "estimate"])
    return both.drop("doc_id_a", "doc_id_b").mapInArrow(run, "a long, b long, estimate double")


def verified(pairs: DataFrame, docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Pairs ``(a, b)`` whose full shingle sets reach the threshold, as ``(a, b, shared, union)``.

    Every set travels to the smaller id of its pair; the members of one
    group are dealt into lots of about ``GROUP`` by a hash of their id, and
    the set of the group's own document goes to every lot.
    """
    pairs = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    pairs = saved(pairs, "pairs")
    # written, so that both sides of the join below are plain exchanges, which can be split for a centre of many pairs
    lots = saved(pairs.groupBy("b").agg(F.count(F.lit(1)).alias("n")).select("b", F.ceil(F.col("n") / GROUP).cast("int").alias("lots")), "lots")
    dealt = pairs.join(lots, "b").select(F.col("a").alias("member"), F.col("b").alias("centre"),
                                         F.pmod(F.xxhash64("a"), F.col("lots")).cast("int").alias("lot"))
    centres = lots.select(F.col("b").alias("member"), F.col("b").alias("centre"),
                          F.explode(F.sequence(F.lit(0), F.col("lots") - 1)).alias("lot"))
    wanted = saved(dealt.unionByName(centres), "dealt-pairs")
    # texts of the documents in question only; merged at every size, as the ids grow with the table
    ids = wanted.select(F.col("member").alias("doc_id")).distinct().hint("merge")
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(ids, "doc_id", "left_semi")

    def sets(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                yield pa.record_batch([part.column(0), pa.array([s.tobytes() for s in shingle_sets(part.column(1))], pa.binary())],
                                      names=["member", "shingles"])
    held = wanted.join(texts.mapInArrow(sets, "member long, shingles binary"), "member")

    def compare(key, table):
        centre, member = key[0].as_py(), table.column("member")
        shingles = table.column("shingles")
        out = {"a": [], "b": [], "shared": [], "union": []}
        at = np.flatnonzero(np.asarray(member.to_numpy()) == centre)
        if len(at):
            own = np.frombuffer(shingles[int(at[0])].as_py(), np.uint64)
            for m, s in zip(member, shingles):
                m = m.as_py()
                if m == centre:
                    continue
                s = np.frombuffer(s.as_py(), np.uint64)
                small, large = (s, own) if len(s) < len(own) else (own, s)
                pos = np.searchsorted(large, small)
                shared = int((large[np.minimum(pos, len(large) - 1)] == small).sum()) if len(small) else 0
                union = len(own) + len(s) - shared
                if union and 100 * shared >= threshold * union:
                    for k, v in zip(out, (m, centre, shared, union)):
                        out[k].append(v)
        return pa.table({k: pa.array(v, pa.int64()) for k, v in out.items()})
    return held.groupBy("centre", "lot").applyInArrow(compare, "a long, b long, shared long, union long")


def _cross_block_pairs(buckets: DataFrame, label: DataFrame, reps: DataFrame, threshold: int) -> DataFrame:
    """Pairs of different components that share a bucket and pass the estimate, or the threshold if both sets are small.

    ``buckets (band, value, id)`` has the shared buckets, ``label (id, component)`` the nodes with links.
    """
    named = (buckets.join(label, "id", "left")
             .select("band", "value", "id", F.coalesce("component", "id").alias("component")))
    open_ = (named.groupBy("band", "value").agg(F.min("component").alias("lo"), F.max("component").alias("hi"),
                                                F.count(F.lit(1)).alias("n")).where("lo <> hi")
             .select("band", "value", "n"))
    sizes = named.join(open_.drop("n"), ["band", "value"], "left_semi").groupBy("band", "value", "component").agg(F.count(F.lit(1)).alias("m"))
    top = sizes.groupBy("band", "value").agg(F.max_by("component", F.struct("m", "component")).alias("top"), F.max("m").alias("m"))
    plan = (open_.join(top, ["band", "value"])
            .select("band", "value", "top", F.ceil((F.col("n") - F.col("m")) / BLOCK_ROWS).cast("int").alias("rest_blocks"),
                    F.ceil(F.col("m") / BLOCK_ROWS).cast("int").alias("top_blocks")))
    members = saved(named.join(plan, ["band", "value"]), "open-buckets")
    # blocks 0..r-1 hold the other components, r..r+t-1 the largest one; a task group is a pair of blocks, one of them of the others
    other = F.col("component") != F.col("top")
    spread = F.xxhash64("id")
    block = F.when(other, F.pmod(spread, F.col("rest_blocks"))).otherwise(F.col("rest_blocks") + F.pmod(spread, F.col("top_blocks"))).cast("int")
    partners = F.when(other, F.sequence(F.lit(0), F.col("rest_blocks") + F.col("top_blocks") - 1)).otherwise(F.sequence(F.lit(0), F.col("rest_blocks") - 1))
    dealt = (members.withColumn("block", block).withColumn("partner", F.explode(partners))
             .select("band", "value", "id", "component", "block", F.least("block", "partner").alias("i"), F.greatest("block", "partner").alias("j")))
    sk = reps.select(F.col("doc_id").alias("id"), "n_shingles", "r0", "r1", "r2", "fine")
    regs = members.select("id").distinct().join(sk, "id")
    rows = dealt.join(regs, "id").select("band", "value", "i", "j", "block", "id", "component", "n_shingles", "fine",
                                         F.when(F.col("band") < 32, F.col("r0")).when(F.col("band") < 64, F.col("r1")).otherwise(F.col("r2")).alias("r"))

    def compare(key, table):
        i, j = key[2].as_py(), key[3].as_py()
        block = table.column("block").to_numpy()
        ids, comp = table.column("id").to_numpy(), table.column("component").to_numpy()
        size = table.column("n_shingles").to_numpy().astype(np.float64)
        regs = np.frombuffer(b"".join(table.column("r").to_pylist()), np.uint16).reshape(len(ids), BUCKETS)
        bands, band = regs.view(np.int64), key[0].as_py() % (BUCKETS // ROWS)
        fine, sets, small = np.zeros((len(ids), FINE), np.uint8), np.zeros((len(ids), EXACT - 1), np.uint64), size < EXACT
        for k, held in enumerate(table.column("fine").to_pylist()):
            if small[k]:
                sets[k, :int(size[k])] = np.frombuffer(held, np.uint64)
                fine[k] = 0 if small.all() else fine_registers(sets[k, :int(size[k])])
            else:
                fine[k] = np.frombuffer(held, np.uint8)
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        a, b = [], []
        for x in left:
            y = right[(comp[right] != comp[x]) & ((ids[right] > ids[x]) if i == j else True)]
            if len(y):
                y = y[~((bands[y, :band] == bands[x, :band]) & (bands[x, :band] != 0)).any(1)]
                y = y[estimate(regs[y], regs[x], size[y], size[x]) >= ESTIMATE]
                exact, rough = (y[small[y]], y[~small[y]]) if small[x] else (y[:0], y)
                if len(exact):
                    both = shared_counts(sets[exact], size[exact], sets[x, :int(size[x])])
                    exact = exact[100 * both >= threshold * (size[exact] + size[x] - both)]
                y = np.concatenate((exact, rough[fine_estimate(fine[rough], fine[x]) >= FINE_ESTIMATE]))
                a += [ids[x]] * len(y)
                b += ids[y].tolist()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})
    return rows.groupBy("band", "value", "i", "j").applyInArrow(compare, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id, kept``."""
    if not THRESHOLD <= threshold <= 100:
        raise ValueError(f"threshold must be from {THRESHOLD} to 100 per cent: the sketches would lose pairs of less")
    sk = saved(sketches(docs), "sketches")
    filled = sk.where("n_shingles > 0")
    digest = ["n_shingles", "digest1", "digest2"]
    # aggregates are written before they are joined, so that a join can be split at a very common key
    classes = saved(filled.groupBy(*digest).agg(F.min("doc_id").alias("rep")), "classes")
    member = saved(sk.join(classes, digest, "left").select("doc_id", "n_shingles", F.coalesce("rep", "doc_id").alias("rep")), "members")
    reps = filled.join(classes.select("rep"), F.col("doc_id") == F.col("rep"), "left_semi")
    bands = band_rows(reps)
    centre = saved(bands.groupBy("band", "value").agg(F.min("id").alias("centre"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "centres")
    buckets = saved(bands.join(centre, ["band", "value"]), "buckets")
    candidates = buckets.where("id <> centre").select(F.col("id").alias("a"), F.col("centre").alias("b")).distinct()
    best = (_estimated(candidates, reps).groupBy("a").agg(F.max_by("b", F.struct("estimate", "b")).alias("b")))
    links = saved(verified(best, docs, threshold).select("a", "b"), "verified")
    label = components(links)
    rest = saved(_cross_block_pairs(buckets.select("band", "value", "id"), label, reps, threshold), "rest")
    if not rest.isEmpty():
        links = links.unionByName(verified(rest, docs, threshold).select("a", "b"))
        label = components(links)
    return (member.join(label.select(F.col("id").alias("rep"), "component"), "rep", "left")
            .select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))
