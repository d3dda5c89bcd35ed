"""Session construction and cluster-shared locations.

On a cluster the session already exists and carries its own settings; we
only fill in what is unset.  ``checkpoint_dir`` reads
``spark.checkpoint.dir`` from the session and only invents a local one
when nothing is configured (local tests).
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every job relies on; applied only where the session has none.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Broadcast only tables whose size is known to be small; Spark checks
    # the estimated plan size against this bound before broadcasting.
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
}


def get_spark(master: str | None = None, app: str = "tokenlake",
              shuffle_partitions: int | None = None) -> SparkSession:
    """Return the active session, or build a local one (tests, bench)."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    b = SparkSession.builder.appName(app)
    b = b.master(master or os.environ.get("TOKENLAKE_MASTER", "local[*]"))
    b = b.config("spark.ui.enabled", "false")
    b = b.config("spark.ui.showConsoleProgress", "false")
    b = b.config("spark.driver.memory", os.environ.get("TOKENLAKE_DRIVER_MEM", "8g"))
    if shuffle_partitions is not None:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in DEFAULTS.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_defaults(spark)
    return spark


def ensure_defaults(spark: SparkSession) -> None:
    """Apply DEFAULTS to an existing session where a key is unset."""
    for k, v in DEFAULTS.items():
        if spark.conf.get(k, None) is None:
            spark.conf.set(k, v)


def bound_methods(spark: SparkSession) -> None:
    """For queries with very wide projections: HotSpot never compiles a method
    of more than 8000 bytes, so past that size Spark had better run a stage's
    operators one by one, in methods it can split.  A session's own value stays."""
    key = "spark.sql.codegen.hugeMethodLimit"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, "8000")


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints / materialised intermediates.

    Reads ``spark.checkpoint.dir`` from the session (the cluster names a
    shared, fault-tolerant folder there).  Only when it is unset in local
    mode (tests) a scratch folder is created; on a cluster an unset value
    is an error rather than a machine-local folder.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = spark.sparkContext.getCheckpointDir()
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            # a machine-local folder would be lost with its executor
            raise RuntimeError("set spark.checkpoint.dir to a shared folder for this cluster")
        d = tempfile.mkdtemp(prefix="tokenlake-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    spark.sparkContext.setCheckpointDir(d)
    return spark.sparkContext.getCheckpointDir() or d


def materialize(df, name: str):
    """Write ``df`` as Parquet under the shared checkpoint folder and read it
    back: cuts the lineage for several consumers, and a lost executor only
    costs re-reading files instead of recomputing the whole job.  Uses the
    folder the cluster names in ``spark.checkpoint.dir`` (``checkpoint_dir``
    only invents one when unset, as in local tests)."""
    import os
    import uuid

    spark = df.sparkSession
    base = checkpoint_dir(spark)
    path = os.path.join(base, "tokenlake", f"{name}-{uuid.uuid4().hex}")
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
