"""Near-duplicate vectors by an epsilon grid order join (operator 10).

Vectors are compared when their labels are equal and not null, by cosine in
double precision; null, zero, and vectors with null or non-finite components
link with nothing, nor do vectors of different length.  Cosine c of unit
vectors is a distance of sqrt(2 - 2c), so a threshold is an epsilon.

1. Equal vectors of a label collapse to the smallest id with a count.
2. Unit vectors are projected on ``DIMS`` leading principal directions
   (fitted on at most ``SAMPLE`` vectors; any orthonormal directions give the
   same result, only more or less pruning) and sorted by label and by the grid
   cells of width epsilon of these coordinates: the epsilon grid order.
3. The order is cut into blocks of ``BLOCK`` vectors with their bounding
   boxes.  Blocks of a label whose cells in the first two directions are
   neighbours meet, and pairs of blocks farther apart than epsilon go.
4. Each remaining pair of blocks is joined recursively: halves of the
   sequence intervals whose boxes are provably distant are skipped, small
   intervals are compared by one matrix product.  Per pair of blocks and
   vector only a link count and one edge of a spanning forest leave the task,
   never the pairs.
5. Counts are summed (weighted by copies) and components found on the edges.

Repeated rows are copies; a tie for the smallest id of a class or component
can't occur but between rows of one id; an empty table gives an empty result;
further columns are ignored.  A row with null vec_id links with nothing and is
kept, its component null.  Rows that share a vec_id are separate vectors that
are reported under that id: different ones share its links and component.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenlake.llm.common import components, saved

THRESHOLD = 0.98
DIMS = 12
BLOCK = 256
LEAF = 32
SAMPLE = 20_000


def _units(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a list column of one length as double, and their norms."""
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(lists), -1)
    return x, np.sqrt((x * x).sum(1))


def directions(vectors: DataFrame, sample: int = SAMPLE) -> dict[int, np.ndarray]:
    """Leading principal directions of the unit vectors of a bounded sample, by vector length."""
    rows = vectors.select("vec_id", "embedding").orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toArrow()
    by: dict[int, list] = {}
    for v in rows.column("embedding").to_pylist():
        by.setdefault(len(v), []).append(v)
    out = {}
    for size, own in by.items():
        x = np.array(own, np.float64)
        with np.errstate(over="ignore"):
            x /= np.abs(x).max(1, keepdims=True)
        x /= np.sqrt((x * x).sum(1, keepdims=True))
        x -= x.mean(0)
        out[size] = np.linalg.eigh(x.T @ x)[1][:, ::-1][:, :DIMS]
    return out


def _scaled(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows divided by their largest component, and the norms of these (no overflow)."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x, np.sqrt((x * x).sum(1))


def projected(reps: DataFrame, basis: dict[int, np.ndarray], epsilon: float) -> DataFrame:
    """The rows with their coordinates ``y`` and grid cells ``cell``."""
    def run(batches):
        for batch in batches:
            vectors = batch.column(3)
            ys = np.zeros((batch.num_rows, DIMS))
            sizes = np.array(pc.list_value_length(vectors).to_pylist(), np.int64)
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                x, norm = _scaled(_units(vectors.take(pa.array(at)))[0])
                turn = basis.get(int(size), np.eye(int(size))[:, :DIMS])
                ys[at[:, None], np.arange(turn.shape[1])] = (x / norm[:, None]) @ turn
            cells = np.floor(ys / epsilon).astype(np.int32)
            yield pa.record_batch([*batch.columns, pa.array(ys.tolist(), pa.list_(pa.float64())), pa.array(cells.tolist(), pa.list_(pa.int32()))],
                                  names=["id", "label", "copies", "vector", "y", "cell"])
    return reps.select("id", "label", "copies", "vector").mapInArrow(
        run, "id long, label string, copies long, vector array<double>, y array<double>, cell array<int>")


def blocks(rows: DataFrame, size: int = BLOCK) -> DataFrame:
    """Blocks of consecutive rows of the grid order, one row per block."""
    # the id last: rows of one cell can be dealt to several partitions
    order = ["label", F.size("vector"), "cell", "id"]
    partitions = rows.sparkSession.conf.get("spark.sql.shuffle.partitions")
    ordered = rows.repartitionByRange(int(partitions), *order).sortWithinPartitions(*order)

    def cut(part: pa.Table, number: int):
        y = np.array(part.column("y").to_pylist(), np.float64)
        flat = pa.concat_arrays([c.flatten() for c in part.column("vector").chunks]).to_numpy(zero_copy_only=False).astype("<f8")
        return pa.record_batch([pa.array([number], pa.int64()), pa.array([part.column("label")[0].as_py()], pa.string()),
                                pa.array([len(flat) // part.num_rows], pa.int32()), pa.array([part.column("id").to_pylist()], pa.list_(pa.int64())),
                                pa.array([part.column("copies").to_pylist()], pa.list_(pa.int64())), pa.array([flat.tobytes()], pa.binary()),
                                pa.array([y.tobytes()], pa.binary()), pa.array([y.min(0).tolist()], pa.list_(pa.float64())),
                                pa.array([y.max(0).tolist()], pa.list_(pa.float64()))],
                               names=["block", "label", "dim", "ids", "copies", "vectors", "ys", "lo", "hi"])

    def run(batches):
        number, held = TaskContext.get().partitionId() << 32, None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            held = t if held is None else pa.concat_tables([held, t])
            keys = list(zip(held.column("label").to_pylist(), pc.list_value_length(held.column("vector")).to_pylist()))
            at = 0
            while True:
                end = at
                while end < len(keys) and end - at < size and keys[end] == keys[at]:
                    end += 1
                if end == len(keys):
                    break
                yield cut(held.slice(at, end - at), number)
                number, at = number + 1, end
            held = held.slice(at)
        if held is not None and held.num_rows:
            yield cut(held, number)
    return ordered.mapInArrow(run, "block long, label string, dim int, ids array<long>, copies array<long>, vectors binary, "
                                   "ys binary, lo array<double>, hi array<double>")


def near_blocks(made: DataFrame, epsilon: float) -> DataFrame:
    """Pairs of blocks ``(a, b)``, a <= b, that may hold vectors within epsilon."""
    def cells(i: int, wider: int) -> Column:
        return F.sequence((F.floor(F.get("lo", F.lit(i)) / epsilon) - wider).cast("int"), (F.floor(F.get("hi", F.lit(i)) / epsilon) + wider).cast("int"))

    box = made.select("block", "label", "dim", "lo", "hi")
    side = {}
    for name, wider in (("a", 0), ("b", 1)):
        side[name] = (box.withColumn("c0", F.explode(cells(0, wider))).withColumn("c1", F.explode(cells(1, wider)))
                      .select("label", "dim", "c0", "c1", *(F.col(c).alias(f"{c}_{name}") for c in ("block", "lo", "hi"))))
    gap = F.aggregate(F.zip_with(F.arrays_zip("lo_a", "hi_a"), F.arrays_zip("lo_b", "hi_b"),
                                 lambda p, q: F.greatest(p["lo_a"] - q["hi_b"], q["lo_b"] - p["hi_a"], F.lit(0.0))),
                      F.lit(0.0), lambda s, x: s + x * x)
    return (side["a"].join(side["b"], ["label", "dim", "c0", "c1"]).where((F.col("block_a") <= F.col("block_b")) & (gap <= epsilon * epsilon))
            .select(F.col("block_a").alias("a"), F.col("block_b").alias("b")).distinct())


def interval_links(ya: np.ndarray, yb: np.ndarray, xa: np.ndarray, xb: np.ndarray, threshold: float, epsilon: float) -> np.ndarray:
    """Boolean matrix of links between two sequence intervals, by recursive halving of both."""
    out = np.zeros((len(xa), len(xb)), bool)
    todo = [(0, len(xa), 0, len(xb))]
    while todo:
        i, j, k, m = todo.pop()
        p, q = ya[i:j], yb[k:m]
        gap = np.maximum(np.maximum(p.min(0) - q.max(0), q.min(0) - p.max(0)), 0)
        if (gap * gap).sum() > epsilon * epsilon:
            continue
        if j - i <= LEAF and m - k <= LEAF:
            out[i:j, k:m] = xa[i:j] @ xb[k:m].T >= threshold
        else:
            rows = ((i, (i + j) // 2), ((i + j) // 2, j)) if j - i > LEAF else ((i, j),)
            cols = ((k, (k + m) // 2), ((k + m) // 2, m)) if m - k > LEAF else ((k, m),)
            todo += [(*r, *c) for r in rows for c in cols]
    return out


def _smallest_linked(link: np.ndarray, ids_a: np.ndarray, ids_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each side the smallest id reachable inside the pair of blocks."""
    a, b, big = ids_a.copy(), ids_b.copy(), np.iinfo(np.int64).max
    while True:
        to_a = np.minimum(a, np.where(link, b[None, :], big).min(1, initial=big))
        to_b = np.minimum(b, np.where(link, to_a[:, None], big).min(0, initial=big))
        if (to_a == a).all() and (to_b == b).all():
            return a, b
        a, b = to_a, to_b


def block_links(pairs: DataFrame, made: DataFrame, threshold: float, epsilon: float) -> DataFrame:
    """``(id, links, root)`` per pair of blocks and linked vector: weighted link count, and one edge."""
    payload = made.select("block", "dim", "ids", "copies", "vectors", "ys")
    both = pairs
    for k in "ab":
        both = both.join(payload.select(*(F.col(c).alias(f"{c}_{k}") for c in payload.columns)), F.col(k) == F.col(f"block_{k}"))
    both = both.select("a", "b", *(f"{c}_{k}" for k in "ab" for c in ("dim", "ids", "copies", "vectors", "ys")))

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(c)[i].as_py() for c, n in enumerate(batch.schema.names)}
                own = {}
                for k in "ab":
                    x, norm = _scaled(np.frombuffer(row[f"vectors_{k}"], "<f8").reshape(-1, row[f"dim_{k}"]))
                    own[k] = (x / norm[:, None], np.frombuffer(row[f"ys_{k}"]).reshape(len(x), -1),
                              np.array(row[f"ids_{k}"], np.int64), np.array(row[f"copies_{k}"], np.int64))
                (xa, ya, ia, ca), (xb, yb, ib, cb) = own["a"], own["b"]
                link = interval_links(ya, yb, xa, xb, threshold, epsilon)
                same = row["a"] == row["b"]
                if same:
                    np.fill_diagonal(link, False)
                    link |= link.T
                root_a, root_b = _smallest_linked(link, ia, ib)
                found = [(ia, link @ cb, root_a)] if same else [(ia, link @ cb, root_a), (ib, ca @ link, root_b)]
                for ids, links, root in found:
                    at = np.flatnonzero(links)
                    if len(at):
                        yield pa.record_batch([pa.array(ids[at]), pa.array(links[at].astype(np.int64)), pa.array(root[at])], names=["id", "links", "root"])
    return both.mapInArrow(run, "id long, links long, root long")


def near_vectors(table: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per vector: ``vec_id, n_links, component_id, kept``."""
    epsilon = math.sqrt(2 - 2 * threshold) + 1e-6
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = (F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~F.coalesce(bad, F.lit(True))
              & F.coalesce(F.exists("embedding", lambda x: x != 0), F.lit(False)))
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"),
                        F.col("embedding").cast("array<double>").alias("embedding"))
    good = rows.where(usable)
    classes = saved(good.groupBy("label", "embedding").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("copies")), "vector-classes")
    member = good.join(classes.select("label", "embedding", "id"), ["label", "embedding"]).select("vec_id", "id")
    reps = classes.withColumnRenamed("embedding", "vector")
    basis = directions(reps.select(F.col("id").alias("vec_id"), F.col("vector").alias("embedding")))
    made = saved(blocks(projected(reps, basis, epsilon)), "vector-blocks")
    found = saved(block_links(near_blocks(made, epsilon), made, threshold, epsilon), "vector-links")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    label = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")).where("a <> b"))
    counted = (classes.select("id", "copies").join(links, "id", "left").join(label, "id", "left")
               .select("id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component")))
    joined = member.join(counted, "id").select("vec_id", "n_links", F.col("component").alias("component_id"))
    lone = rows.where(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return joined.unionByName(lone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
