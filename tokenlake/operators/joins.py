"""Interval join (J1): attach points to the intervals that contain them.

``point.key = iv.key AND iv.start < point.ts AND point.ts <= iv.end``; an
interval without an end is open.

With only a low-cardinality equi key (a handful of hosts) a hash join would
send all samples of a host to one task, and with no equi key Spark falls back
to a nested-loop join.  So the keys are cut into buckets of equal depth: a
histogram of the points by key and time slot is summed up along each key, and
a bucket ends wherever the sum passes the next multiple of
``points / partitions``.  A busy hour has many buckets, a quiet month one.
Points fall into exactly one bucket, an interval is repeated for the buckets
it overlaps (an open one up to the last), and the join is an equi join on
``(key, bucket)`` with the exact range as residual -- no duplicates.

The bounds of all keys together are at most ``partitions`` numbers (a bucket
but the first of its key holds that many points), so they reach the tasks as
one value of a scalar subquery.  Whether the interval side is broadcast is
left to Spark's size estimate / AQE runtime statistics, never forced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenlake.functions.common import micros

SLOT_SECONDS = 10


def depth_bounds(points: DataFrame, keys: list[str], ts: str, slot_seconds: int, partitions: int) -> DataFrame:
    """One row with ``bounds``: key struct -> ascending first slots of its buckets but the first one."""
    slots = (points.where(F.col(ts).isNotNull()).groupBy(*keys, _slot(F.col(ts), slot_seconds).alias("slot")).agg(F.count(F.lit(1)).alias("n")))
    depth = F.greatest(F.lit(1), F.ceil(slots.agg(F.sum("n")).scalar() / F.lit(partitions)))
    along = Window.partitionBy(*keys).orderBy("slot")
    cut = (slots.withColumn("bucket", F.floor(F.coalesce(F.sum("n").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) / depth))
           .withColumn("last", F.lag("bucket").over(along)).where(F.col("bucket") > F.col("last")))
    each = cut.groupBy(F.struct(*keys).alias("key")).agg(F.sort_array(F.collect_list("slot")).alias("first_slots"))
    return each.agg(F.map_from_entries(F.collect_list(F.struct("key", "first_slots"))).alias("bounds"))


def _slot(ts: Column, slot_seconds: int) -> Column:
    return F.floor(micros(ts) / F.lit(slot_seconds * 1_000_000)).cast("bigint")


def interval_join(points: DataFrame, intervals: DataFrame, key: str | Sequence[str],
                  ts: str, start: str, end: str, bucket_seconds: int = SLOT_SECONDS,
                  how: str = "inner", start_inclusive: bool = False, partitions: int | None = None) -> DataFrame:
    """Points with the columns of every interval that contains them.

    ``bucket_seconds`` is the histogram's slot, below which a bucket is not
    cut; ``partitions`` (default: the session's shuffle partitions) the number
    of equal parts aimed at.
    """
    keys = [key] if isinstance(key, str) else list(key)
    parts = partitions or int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = depth_bounds(points, keys, ts, bucket_seconds, parts)

    def bucket(first_slots: Column, when: Column) -> Column:
        at = _slot(when, bucket_seconds)
        return F.coalesce(F.size(F.filter(first_slots, lambda b: b <= at)), F.lit(0)).cast("bigint")

    def own(df: DataFrame) -> DataFrame:
        return (df.withColumn("_bounds", bounds.scalar())
                .withColumn("_own", F.coalesce(F.try_element_at("_bounds", F.struct(*keys)), F.array().cast("array<bigint>"))).drop("_bounds"))
    p = own(points).withColumn("_jb", bucket(F.col("_own"), F.col(ts))).drop("_own")
    iv = own(intervals)
    first = bucket(F.col("_own"), F.col(start))
    last = F.when(F.col(end).isNull(), F.size("_own").cast("bigint")).otherwise(bucket(F.col("_own"), F.col(end)))
    iv = iv.withColumn("_jb", F.explode(F.sequence(first, F.greatest(first, last)))).drop("_own")
    cond = [p[k] == iv[k] for k in keys] + [p["_jb"] == iv["_jb"]]
    lower = (p[ts] >= iv[start]) if start_inclusive else (p[ts] > iv[start])
    cond += [lower, iv[end].isNull() | (p[ts] <= iv[end])]
    joined = p.join(iv, on=cond, how=how)
    return joined.drop(p["_jb"]).drop(iv["_jb"]).drop(*[iv[k] for k in keys])
