"""Exact-size random split (O3) by distributed selection.

The k rows of smallest (hash, id) are the test part.  The hash is 52 bits of
md5(salt, id); its k-th smallest value is found by histograms, 13 bits at a
time: each pass counts the rows of the one open range by their next 13 bits
(at most 8192 short rows reach the driver) and goes on in the range that the
k-th row falls into.  No global sort, no window over all rows; every pass
reads the id column only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS, LEVELS = 13, 4


def split_hash(salt: str, key: Column) -> Column:
    """52 bits of md5(salt:key) as a bigint."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(salt), key.cast("string"))), 1, 13), 16, 10).cast("bigint")


def duck_split_hash(salt: str, key: str) -> str:
    """DuckDB text of ``split_hash``."""
    return f"('0x' || substr(md5(concat_ws(':', '{salt}', CAST({key} AS VARCHAR))), 1, 13))::BIGINT"


def exact_split(df: DataFrame, key: str, fraction: float, salt: str = "exact-split:42") -> DataFrame:
    """``df`` with ``is_test``: true for exactly ``floor(fraction * n)`` of its n rows, whatever the partitions.

    ``key`` must be unique and not null; the same keys always give the same split.
    """
    k = int(df.count() * fraction)
    h = split_hash(salt, F.col(key))
    keys = df.select(F.col(key).alias("key"), h.alias("h"))
    prefix, left = 0, k                       # rows below the open range: k - left
    for level in range(LEVELS):
        if left == 0:
            break
        shift = BITS * (LEVELS - 1 - level)
        inside = keys.where(F.shiftright("h", shift + BITS) == prefix)
        counts = dict(inside.groupBy(F.shiftright("h", shift).alias("b")).agg(F.count(F.lit(1)).alias("n")).collect())
        for b in sorted(counts):
            if counts[b] >= left:
                prefix = b
                break
            left -= counts[b]
    if left == 0:
        return df.withColumn("is_test", F.lit(False))
    # rows that share the whole hash of the k-th row: the smallest keys of them
    edge = keys.where(F.col("h") == prefix).orderBy("key").limit(left).agg(F.max("key")).first()[0]
    return df.withColumn("is_test", (h < prefix) | ((h == prefix) & (F.col(key) <= F.lit(edge))))
