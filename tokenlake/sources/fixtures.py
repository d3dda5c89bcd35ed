"""Derived views that bind the operators to the input tables (FIXTURES B*).

Everything here is a lazy, narrow projection of the scanned tables (plus
the shuffles the definition itself needs), so its cost grows with the
tables.  The ``*_sql`` companions are the DuckDB text of the same views,
used by the oracle queries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenlake.functions.common import micros
from tokenlake.operators.ordered import prefix_scan
from tokenlake.sources.tables import table

# ---- fixed values (FIXTURES B1) -------------------------------------------
# Concurrency levels of the sweep, in order.
LEVELS = [1, 2, 4, 8, 16, 32, 48, 64, 96, 128, 192, 256]
# Backends of the comparison report, in report order.
BACKENDS = ["Hugging Face", "vLLM", "SGLang"]
# ---------------------------------------------------------------------------


def _levels_col(c):
    return F.element_at(F.array(*[F.lit(v) for v in LEVELS]), (F.pmod(c, F.lit(12)) + 1).cast("int"))


def _backend_col(c):
    return F.element_at(F.array(*[F.lit(v) for v in BACKENDS]), (F.pmod(c, F.lit(3)) + 1).cast("int"))


def request_dims(request_id) -> list:
    """Per-request attributes of B1 as column expressions of the id."""
    r = F.col(request_id)
    return [
        _backend_col(r).alias("backend"),
        _levels_col(r).alias("concurrency"),
        F.when(F.pmod(r, F.lit(17)) == 0, F.lit(500)).otherwise(F.lit(200)).alias("http_status"),
    ]


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B1 request attributes: request_id, backend, concurrency, http_status and
    the reported usage (0 for ids divisible by 13, 1 by 11, else not reported)."""
    r = F.col("request_id")
    ids = events(spark, sf_dir).select(F.col("user_id").alias("request_id")).distinct()
    usage = F.when(F.pmod(r, F.lit(13)) == 0, F.lit(0)).when(F.pmod(r, F.lit(11)) == 0, F.lit(1))
    return ids.select("request_id", *request_dims("request_id"), usage.cast("bigint").alias("usage_tokens"))


def backend_hosts(spark: SparkSession) -> DataFrame:
    """B2: the host that each backend ran on (one row per backend)."""
    return spark.createDataFrame([(b, i) for i, b in enumerate(BACKENDS)], "backend string, host int")


def token_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B1 ``token_events``: one row per event of a user, in (ts, event_id) order.

    token_idx 0 is the prompt phase, 1 the first generated token.
    """
    ev = events(spark, sf_dir).select(
        F.col("user_id").alias("request_id"), "event_id", "ts",
        F.col("event_type").alias("text"), "value")
    out = prefix_scan(ev, "request_id", "ts", "event_id", idx="token_idx", prev_ts="prev_ts")
    return out.withColumn(
        "phase", F.when(F.col("token_idx") == 0, F.lit("prompt")).otherwise(F.lit("token"))
    ).withColumn("n_tokens", F.when(F.col("token_idx") == 0, F.lit(0)).otherwise(F.lit(1)))


# ---- B2: GPU samples and runs ---------------------------------------------

GIB = 1024 ** 3


def gpu_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B2 ``gpu_samples`` in one named schema (trap 6: nullable temp_c)."""
    ev = events(spark, sf_dir)
    return ev.select(
        F.pmod(F.col("user_id"), F.lit(4)).cast("int").alias("host"),
        F.pmod(F.col("event_id"), F.lit(2)).cast("int").alias("gpu_index"),
        F.col("ts"),
        F.floor(F.col("value") * F.lit(float(2 ** 24))).cast("bigint").alias("used_bytes"),
        F.lit(80 * GIB).cast("bigint").alias("total_bytes"),
        F.pmod(F.col("event_id"), F.lit(101)).cast("int").alias("util_pct"),
        (F.lit(40) + F.pmod(F.col("event_id"), F.lit(45))).cast("int").alias("temp_c"),
        F.round(F.col("value") * F.lit(1000.0)).cast("bigint").alias("power_mw"),
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B2 ``runs``: per (host, day) 06:00 (exclusive) .. 18:00 (inclusive),
    plus one run per host on the day after its last day, which gets no
    samples."""
    days = gpu_samples(spark, sf_dir).select("host", F.to_date("ts").alias("day")).distinct()
    extra = days.groupBy("host").agg(F.date_add(F.max("day"), 1).alias("day"))   # from the small set
    allr = days.unionByName(extra).distinct()
    start = F.to_timestamp_ntz(F.concat(F.date_format("day", "yyyy-MM-dd"), F.lit(" 06:00:00")))
    end = F.to_timestamp_ntz(F.concat(F.date_format("day", "yyyy-MM-dd"), F.lit(" 18:00:00")))
    return allr.select(
        F.concat(F.lit("h"), F.col("host").cast("string"), F.lit("-"),
                 F.date_format("day", "yyyy-MM-dd")).alias("run_id"),
        "host", start.alias("start_ts"), end.alias("end_ts"))


GPU_SAMPLES_SQL = """
SELECT CAST(user_id % 4 AS INTEGER) AS host,
       CAST(event_id % 2 AS INTEGER) AS gpu_index,
       ts,
       CAST(floor(value * 16777216.0) AS BIGINT) AS used_bytes,
       CAST(80 AS BIGINT) * 1073741824 AS total_bytes,
       CAST(event_id % 101 AS INTEGER) AS util_pct,
       CAST(40 + event_id % 45 AS INTEGER) AS temp_c,
       CAST(round(value * 1000.0) AS BIGINT) AS power_mw
FROM events
"""

RUNS_SQL = f"""
WITH s AS (SELECT host, CAST(ts AS DATE) AS day FROM ({GPU_SAMPLES_SQL}) g),
     allr AS (SELECT DISTINCT host, day FROM s
              UNION
              SELECT host, CAST(max(day) + INTERVAL 1 DAY AS DATE) FROM s GROUP BY host)
SELECT 'h' || CAST(host AS VARCHAR) || '-' || strftime(day, '%Y-%m-%d') AS run_id,
       host,
       CAST(day AS TIMESTAMP) + INTERVAL 6 HOUR AS start_ts,
       CAST(day AS TIMESTAMP) + INTERVAL 18 HOUR AS end_ts
FROM allr
"""

def duck_levels(expr: str) -> str:
    return f"({LEVELS!r})[({expr}) % 12 + 1]"


def duck_backend(expr: str) -> str:
    lst = "[" + ", ".join(f"'{b}'" for b in BACKENDS) + "]"
    return f"({lst})[({expr}) % 3 + 1]"


def request_dims_sql(expr: str) -> str:
    return (f"{duck_backend(expr)} AS backend, CAST(({expr}) % 3 AS INTEGER) AS backend_idx, "
            f"{duck_levels(expr)} AS concurrency, "
            f"CASE WHEN ({expr}) % 17 = 0 THEN 500 ELSE 200 END AS http_status")


__all__ = ["LEVELS", "BACKENDS", "request_dims", "token_events", "gpu_samples", "runs",
           "micros"]
