"""Helpers that the operators of this package share."""

from __future__ import annotations

import os
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenlake.session import checkpoint_dir
from tokenlake.sources.tables import table


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(*(columns or ("doc_id", "text")))


def shared_folder(spark: SparkSession, name: str) -> str:
    """URI of a new folder under that of spark.checkpoint.dir."""
    path = os.path.join(checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}")
    return path if re.match(r"[a-z][a-z0-9+.-]*:", path) else f"file://{os.path.abspath(path)}"


def saved(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """``df`` written as Parquet under the folder of spark.checkpoint.dir and read again.

    Cuts the lineage: a lost executor costs a re-read of files, and several
    readers share one computation.
    """
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def held_out(doc_id: str, parts: int, part: int) -> Column:
    """Whether crc32 of the id as text has remainder ``part``."""
    return F.crc32(F.col(doc_id).cast("string")) % parts == part


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges (a, b)`` as rows ``(id, component)``, component the smallest id.

    Alternating large-star and small-star steps on the edge table: every
    step is an aggregation and a join on the node.  A node with very many
    neighbours is pre-aggregated map-side; the aggregate is written before it
    is joined, so that the join's partition of such a node can be split.
    Every round is written to the shared folder.  Ends when a round
    changes nothing; the number of rounds grows with the logarithm of the
    longest chain.
    """
    links = saved(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                  .where("u <> v").distinct(), "links")
    state = _state(links)
    while state[0]:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = saved(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m")), "lowest")
        large = (both.where("v > u").join(low, F.col("u") == F.col("k"))
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        large = saved(large, "large-star")
        low = saved(large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m"), "lowest")
        small = (large.join(low, F.col("u") == F.col("k"))
                 .select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")),
                                           F.struct(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")))).alias("e"))
                 .select("e.u", "e.v").where("u <> v").distinct())
        links = saved(small, "links")
        before, state = state, _state(links)
        if before == state:
            break
    # settled: every node but the smallest points straight at the smallest
    return links.select(F.col("u").alias("id"), F.col("v").alias("component"))


def _state(links: DataFrame) -> tuple:
    row = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("v", "u"))).first()
    return tuple(row)
