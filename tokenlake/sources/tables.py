"""Scans of the input tables.

Every reader returns a lazy DataFrame; callers select the columns they use
so Catalyst prunes the Parquet ``ReadSchema`` and pushes filters down.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def table_path(sf_dir: str, name: str) -> str:
    p = os.path.join(sf_dir, f"{name}.parquet")
    return p


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    return spark.read.parquet(table_path(sf_dir, name))


def register_views(spark: SparkSession, sf_dir: str) -> None:
    """Expose every table as a temp view (for SQL-first callers)."""
    for t in TABLES:
        table(spark, sf_dir, t).createOrReplaceTempView(t)
