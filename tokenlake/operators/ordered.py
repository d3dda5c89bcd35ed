"""Ordered per-key scans that stay balanced when one key is huge.

``row_number() / lag() / running max`` over ``Window.partitionBy(key)``
put every row of a key into one task.  When a single request, run or
user may hold a third of all rows that task dominates the job.  The
helpers here split each key into time buckets:

1. ``bucket = floor(ts / width)``; a per-(key, bucket) summary (count,
   last row, max value) is a partial+final hash aggregate, so it never
   concentrates a key's rows;
2. a window over the *summary* (one row per key and bucket, tiny compared
   with the input) yields, per bucket, the number of rows and the last
   row / running max of all earlier buckets;
3. the per-row window is partitioned by ``(key, bucket)`` -- the hot key
   is now spread over as many tasks as it has buckets -- and joined back
   with the summary on ``(key, bucket)``; the window output is already
   hash-partitioned on those columns, so only the small side moves.

The result is exact: bucketing only changes where rows are processed.

``prefix_scan`` gives the same columns by rows instead of time buckets, for
keys that are hot within a bucket (see there).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tokenlake.functions.common import micros
from tokenlake.session import materialize

DEFAULT_BUCKET_SECONDS = 3600


def _keys(key) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def sequence_scan(df: DataFrame, key: str | Sequence[str], ts: str, tiebreak: str,
                  bucket_seconds: int = DEFAULT_BUCKET_SECONDS,
                  idx: str | None = "seq_idx", prev_ts: str | None = "prev_ts",
                  running_max: str | None = None, running_max_out: str = "running_max",
                  running_sum: str | None = None, running_sum_out: str = "sum_before",
                  bucket_col=None, total_out: str | None = None) -> DataFrame:
    """Add 0-based position, previous ``ts`` and optional running max per key.

    Order inside a key is ``(ts, tiebreak)``; ``tiebreak`` must make it
    total.  ``prev_ts`` is NULL on the first row of a key; ``running_sum``
    gives the sum of that column over all *earlier* rows of the key.  The
    bucket is ``floor(ts / bucket_seconds)`` unless ``bucket_col`` (any
    column monotone in the order, e.g. ``floor(id / 100000)``) is given.
    ``total_out`` adds the number of rows of the key (from the summary).
    """
    keys = _keys(key)
    width = F.lit(bucket_seconds * 1_000_000)
    bkt = bucket_col if bucket_col is not None else F.floor(micros(ts) / width)
    d = df.withColumn("_bkt", bkt.cast("bigint"))

    aggs = [F.count(F.lit(1)).alias("_n"), F.max(F.col(ts)).alias("_last_ts")]
    if running_max is not None:
        aggs.append(F.max(F.col(running_max)).alias("_bmax"))
    if running_sum is not None:
        aggs.append(F.sum(F.col(running_sum)).alias("_bsum"))
    summary = d.groupBy(*keys, "_bkt").agg(*aggs)
    ws = Window.partitionBy(*keys).orderBy("_bkt")
    before = ws.rowsBetween(Window.unboundedPreceding, -1)
    cols = [*keys, "_bkt",
            F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"),
            F.lag("_last_ts").over(ws).alias("_prev_bkt_ts")]
    if running_max is not None:
        cols.append(F.max("_bmax").over(before).alias("_prev_bkt_max"))
    if running_sum is not None:
        cols.append(F.coalesce(F.sum("_bsum").over(before), F.lit(0)).alias("_prev_bkt_sum"))
    if total_out is not None:
        cols.append(F.sum("_n").over(Window.partitionBy(*keys)).alias(total_out))
    summary = summary.select(*cols)

    wl = Window.partitionBy(*keys, "_bkt").orderBy(F.col(ts), F.col(tiebreak))
    local = d.withColumn("_rn", F.row_number().over(wl))
    if prev_ts is not None:
        local = local.withColumn("_lag_ts", F.lag(ts).over(wl))
    if running_max is not None:
        local = local.withColumn(
            "_lmax", F.max(running_max).over(wl.rowsBetween(Window.unboundedPreceding, 0)))
    if running_sum is not None:
        local = local.withColumn(
            "_lsum", F.coalesce(F.sum(running_sum).over(wl.rowsBetween(Window.unboundedPreceding, -1)),
                                F.lit(0)))

    # null keys form one group, rows without an order value one bucket (first in the order)
    named = summary.select(*(F.col(c).alias(f"_s_{c}") if c in (*keys, "_bkt") else F.col(c) for c in summary.columns))
    same = [local[c].eqNullSafe(named[f"_s_{c}"]) for c in (*keys, "_bkt")]
    out = local.join(named, on=same, how="inner").drop(*(f"_s_{c}" for c in (*keys, "_bkt")))
    if idx is not None:
        out = out.withColumn(idx, F.col("_offset") + F.col("_rn") - 1)
    if prev_ts is not None:
        out = out.withColumn(prev_ts, F.coalesce(F.col("_lag_ts"), F.col("_prev_bkt_ts")))
    if running_max is not None:
        out = out.withColumn(running_max_out,
                             F.greatest(F.col("_lmax"), F.col("_prev_bkt_max")))
    if running_sum is not None:
        out = out.withColumn(running_sum_out, F.col("_prev_bkt_sum") + F.col("_lsum"))
    drop = ["_bkt", "_rn", "_offset", "_prev_bkt_ts", "_lag_ts", "_lmax", "_prev_bkt_max",
            "_lsum", "_prev_bkt_sum"]
    return out.drop(*[c for c in drop if c in out.columns])


def prefix_scan(df: DataFrame, key: str | Sequence[str], ts: str, tiebreak: str, partitions: int | None = None,
                idx: str | None = "seq_idx", prev_ts: str | None = "prev_ts",
                running_max: str | None = None, running_max_out: str = "running_max",
                running_sum: str | None = None, running_sum_out: str = "sum_before") -> DataFrame:
    """The columns of ``sequence_scan`` as a parallel prefix scan over partitions of equal size.

    1. The rows are range-partitioned by (key, ts, tiebreak) and written with
       the number of their partition, so every key is a chain of neighbouring
       partitions however its rows lie in time;
    2. a summary per (key, partition) -- count, last ``ts``, max, sum -- is
       scanned over the partitions of each key.  Only the first key of a
       partition can go on from an earlier one, so what is carried in is at
       most one row a partition: it is broadcast with that bound;
    3. the rows go back to their partition by its number, where the windows by
       (partition, key) need no further shuffle, and the carry is added.

    ``tiebreak`` must make the order total; null keys form one group, null
    ``ts`` come first.  ``partitions`` (default: the session's shuffle
    partitions) bounds a task to about ``rows / partitions``.
    """
    keys = _keys(key)
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = materialize(df.repartitionByRange(n, *keys, ts, tiebreak).withColumn("_part", F.spark_partition_id()), "ordered-rows")
    totals = {"_n": F.count(F.lit(1)), "_last": F.max(ts)}
    if running_max is not None:
        totals["_max"] = F.max(running_max)
    if running_sum is not None:
        totals["_sum"] = F.sum(running_sum)
    summary = rows.groupBy(*keys, "_part").agg(*(c.alias(k) for k, c in totals.items()))
    chain = Window.partitionBy(*keys).orderBy("_part")
    before = chain.rowsBetween(Window.unboundedPreceding, -1)
    carried = {"_c_n": F.sum("_n").over(before), "_c_last": F.lag("_last").over(chain)}
    if running_max is not None:
        carried["_c_max"] = F.max("_max").over(before)
    if running_sum is not None:
        carried["_c_sum"] = F.sum("_sum").over(before)
    carry = (summary.select(*(F.col(k).alias(f"_s_{k}") for k in keys), F.col("_part").alias("_s_part"), *(c.alias(k) for k, c in carried.items()))
             .where(F.col("_c_n") > 0))

    own = Window.partitionBy("_part", *keys).orderBy(F.col(ts), F.col(tiebreak))
    local = rows.repartitionById(n, F.col("_part"))
    added = {}
    if idx is not None:
        local = local.withColumn("_rn", F.row_number().over(own))
        added[idx] = F.coalesce("_c_n", F.lit(0)) + F.col("_rn") - 1
    if prev_ts is not None:
        local = local.withColumn("_lag", F.lag(ts).over(own)).withColumn("_first", F.row_number().over(own) == 1)
        added[prev_ts] = F.when(F.col("_first"), F.col("_c_last")).otherwise(F.col("_lag"))
    if running_max is not None:
        local = local.withColumn("_lmax", F.max(running_max).over(own.rowsBetween(Window.unboundedPreceding, 0)))
        added[running_max_out] = F.greatest("_lmax", "_c_max")
    if running_sum is not None:
        local = local.withColumn("_lsum", F.sum(running_sum).over(own.rowsBetween(Window.unboundedPreceding, -1)))
        added[running_sum_out] = F.coalesce("_c_sum", F.lit(0)) + F.coalesce("_lsum", F.lit(0))
    same = F.col("_part") == F.col("_s_part")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_s_{k}"))
    joined = local.join(F.broadcast(carry), same, "left")
    return joined.select(*df.columns, *(c.alias(k) for k, c in added.items()))


def first_k(df: DataFrame, key: str | Sequence[str], order: Sequence, k: int,
            rank_col: str = "rk") -> DataFrame:
    """First ``k`` rows per key.

    ``row_number() <= k`` lets Catalyst plan a WindowGroupLimit on the map
    side, so at most k rows per key and map task cross the shuffle, however
    large the key.
    """
    w = Window.partitionBy(*_keys(key)).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).filter(F.col(rank_col) <= k)
