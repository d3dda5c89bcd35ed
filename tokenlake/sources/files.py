"""File sources and sinks.

Readers take explicit schemas (no inference pass over the data); writers
use Spark's distributed writers.  Only single-row reports are coalesced
to one file, because they are one row.
"""

from __future__ import annotations

import os
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenlake.functions.common import array_tail

# One explicit schema that is the union of both report shapes (HF report
# keys and client report keys), so S2 never infers and Z1 needs no
# schema merge.
REPORT_SCHEMA = T.StructType([
    T.StructField("backend", T.StringType()),
    T.StructField("total_tokens", T.LongType()),
    T.StructField("total_duration", T.DoubleType()),
    T.StructField("tokens_per_second", T.DoubleType()),
    T.StructField("avg_ttft", T.DoubleType()),
    T.StructField("ttft", T.DoubleType()),
    T.StructField("max_mem", T.DoubleType()),
    T.StructField("max_gpu", T.DoubleType()),
    T.StructField("avg_power", T.DoubleType()),
    T.StructField("avg_ttft_sec", T.DoubleType()),
    T.StructField("avg_decode_tokens_per_sec", T.DoubleType()),
    T.StructField("peak_vram_gb", T.DoubleType()),
    T.StructField("max_gpu_compute_percent", T.DoubleType()),
    T.StructField("avg_power_watts", T.DoubleType()),
])

GPU_SAMPLE_SCHEMA = T.StructType([
    T.StructField("host", T.IntegerType()),
    T.StructField("gpu_index", T.IntegerType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("used_bytes", T.LongType()),
    T.StructField("total_bytes", T.LongType()),
    T.StructField("util_pct", T.IntegerType()),
    T.StructField("temp_c", T.IntegerType()),
    T.StructField("power_mw", T.LongType()),
])

MESSAGE = T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())])
CHAT_SCHEMA = T.StructType([
    T.StructField("example_id", T.LongType()),
    T.StructField("case", T.StringType()),
    T.StructField("prompt", T.ArrayType(MESSAGE)),
    T.StructField("completion", T.ArrayType(MESSAGE)),
])


def _exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.text(path)           # resolves the path only
        return True
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return False
        raise


# ------------------------------------------------------------------ S2 / S5

def report_scan(spark: SparkSession, reports: dict[str, str]) -> DataFrame:
    """Read the per-backend JSON reports that exist (absent files are
    skipped, as the reference does), one multi-line object per file; the
    backend comes from the file the row was read from."""
    present = {b: p for b, p in reports.items() if _exists(spark, p)}
    if not present:
        return spark.createDataFrame([], REPORT_SCHEMA)
    names = F.create_map(*[x for b, p in present.items()
                           for x in (F.lit(os.path.basename(p.rstrip("/"))), F.lit(b))])
    df = spark.read.schema(REPORT_SCHEMA).option("multiLine", True).json(list(present.values()))
    fname = F.element_at(F.split(F.input_file_name(), "/"), -1)
    return df.withColumn("backend", F.coalesce(names[fname], F.col("backend")))


def report_sink(df: DataFrame, path: str) -> None:
    """One summary row as indented JSON with nulls kept, in a single file.

    A report is one row; anything longer is refused before it is written."""
    if df.limit(2).count() > 1:
        raise ValueError("a report has one row; use a distributed writer for more")
    txt = df.select(F.to_json(F.struct(*df.columns), {"pretty": "true", "ignoreNullFields": "false"})
                    .alias("value"))
    txt.coalesce(1).write.mode("overwrite").text(path)


def normalized_reports(df: DataFrame, order: list[str]) -> DataFrame:
    """P10 + O2: first present of several keys (default 0), declared order."""
    pos = F.array_position(F.array(*[F.lit(b) for b in order]), F.col("backend")).cast("int")
    return df.select(
        "backend", pos.alias("report_pos"),
        F.coalesce("avg_ttft", "avg_ttft_sec", "ttft", F.lit(0.0)).alias("ttft"),
        F.coalesce("avg_decode_tokens_per_sec", "tokens_per_second", F.lit(0.0)).alias("tps"),
        F.coalesce("peak_vram_gb", "max_mem", F.lit(0.0)).alias("vram"),
        F.coalesce("max_gpu_compute_percent", "max_gpu", F.lit(0.0)).alias("gpu"),
    ).orderBy("report_pos")


# ------------------------------------------------------------------ S3 / S4

def jsonl_sink(df: DataFrame, path: str, partition_by: str | None = "split") -> None:
    """Chat rows as UTF-8 JSON lines (no ASCII escaping), nulls kept,
    overwrite, one folder per split."""
    w = df.write.mode("overwrite").option("ignoreNullFields", "false")
    if partition_by:
        w = w.partitionBy(partition_by)
    w.json(path)


def jsonl_scan(spark: SparkSession, path: str, schema: T.StructType = CHAT_SCHEMA) -> DataFrame:
    """S3: the JSONL dataset back, with the split folder as a column."""
    fields = list(schema.fields)
    if "split" not in schema.fieldNames():
        fields.append(T.StructField("split", T.StringType()))
    return spark.read.schema(T.StructType(fields)).json(path)


# ------------------------------------------------------------------ S6-S10

def numbered_lines(spark: SparkSession, path: str | list[str], line_sep: str | None = None) -> DataFrame:
    """Text lines with their global number: ``line_id`` over all files in the order
    of their paths, ``file`` and ``line_no`` within it, ``value``.

    Spark reads a file in blocks.  Lines are counted by (file, block start), the
    counts are summed up along the files -- one short row a block -- and a line's
    place in its block comes from the order in which a task meets them.  So the
    numbers depend on neither the block size nor the number of partitions.
    """
    read = spark.read.option("lineSep", line_sep) if line_sep else spark.read
    raw = read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                                 F.monotonically_increasing_id().alias("at"))
    # a task reads its blocks one after the other, so a block's lines are consecutive from its smallest id
    blocks = raw.groupBy(F.col("file").alias("of"), F.col("block").alias("start")).agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    inside = Window.partitionBy("of").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    files = blocks.groupBy(F.col("of").alias("name")).agg(F.sum("n").alias("lines"))
    files = files.select("name", F.coalesce(F.sum("lines").over(Window.orderBy("name").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    blocks = (blocks.withColumn("skip", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(files, F.col("of") == F.col("name"))
              .select("of", "start", "first", "skip", "before"))
    j = raw.join(blocks, (F.col("file") == F.col("of")) & (F.col("block") == F.col("start")))
    line = F.col("skip") + F.col("at") - F.col("first")
    return j.select((F.col("before") + line).alias("line_id"), "file", line.alias("line_no"), "value")


def prompt_lines_scan(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One prompt per text line (invalid UTF-8 decodes to U+FFFD) with its global line number."""
    return numbered_lines(spark, path).select("line_id", F.col("value").alias("prompt"))


def zip_lines(spark: SparkSession, left: str | list[str], right: str | list[str], line_sep: str | None = None) -> DataFrame:
    """J3 over files: the i-th line of one input with the i-th line of the other (``line_id, left, right``);
    lines without a partner keep null."""
    a = numbered_lines(spark, left, line_sep).select("line_id", F.col("value").alias("left"))
    b = numbered_lines(spark, right, line_sep).select("line_id", F.col("value").alias("right"))
    return a.join(b, "line_id", "full_outer")


def token_csv_sink(df: DataFrame, path: str, ids: str = "ids") -> None:
    """Id rows as CSV text lines."""
    df.select(F.array_join(ids, ",").alias("value")).write.mode("overwrite").text(path)


def token_csv_scan(spark: SparkSession, path: str, max_input_length: int | None = None) -> DataFrame:
    """Ragged CSV of token ids -> ARRAY<INT> (a blank line: empty), optionally the last N."""
    from tokenlake.operators.tokens import parse_id_line
    out = spark.read.text(path).select(parse_id_line(F.col("value")).alias("ids"))
    if max_input_length:
        out = out.withColumn("ids", array_tail(F.col("ids"), max_input_length))
    return out


def token_matrix_scan(df: DataFrame, pad_id: int, max_input_length: int | None = None,
                      col: str = "row") -> DataFrame:
    """Padded id rows -> pad removed (-> last N)."""
    kept = F.filter(F.col(col), lambda x: x != pad_id)
    out = df.withColumn("ids", kept)
    if max_input_length:
        out = out.withColumn("ids", array_tail(F.col("ids"), max_input_length))
    return out


TENSOR_CHUNK = 4096           # values of a row


def tensor_chunks(df: DataFrame, key: str, tensors: list[str], chunk: int = TENSOR_CHUNK) -> DataFrame:
    """Array columns (rank 1, or 2 with rows of one length) as
    ``tensor, key, chunk, shape, values``: at most ``chunk`` values in row-major order a row."""
    parts = []
    for name in tensors:
        nested = dict(df.dtypes)[name].startswith("array<array")
        flat = F.flatten(name) if nested else F.col(name)
        shape = F.array(F.size(name), F.coalesce(F.size(F.try_element_at(name, F.lit(1))), F.lit(0))) if nested else F.array(F.size(name))
        rows = df.where(F.col(name).isNotNull()).select(F.lit(name).alias("tensor"), F.col(key).alias("key"), shape.alias("shape"),
                                                        flat.cast("array<double>").alias("flat"))
        last = F.greatest(F.lit(0), F.floor((F.size("flat") - 1) / chunk)).cast("int")
        parts.append(rows.withColumn("chunk", F.explode(F.sequence(F.lit(0), last)))
                     .select("tensor", "key", "chunk", "shape", F.slice("flat", F.col("chunk") * chunk + 1, F.lit(chunk)).alias("values")))
    return reduce(DataFrame.unionByName, parts)


def tensor_chunks_of_values(values: DataFrame, shapes: DataFrame, chunk: int = TENSOR_CHUNK) -> DataFrame:
    """S10 for tensors too long for one row: ``values (tensor, key, pos, value)`` and ``shapes (tensor, key, shape)``;
    a group is one chunk."""
    g = (values.groupBy("tensor", "key", F.floor(F.col("pos") / chunk).cast("int").alias("chunk"))
         .agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "value"))), lambda x: x["value"].cast("double")).alias("values")))
    return g.join(shapes, ["tensor", "key"]).select("tensor", "key", "chunk", "shape", "values")


def tensor_sink(chunks: DataFrame, path: str) -> None:
    """Chunk rows as Parquet, one folder a tensor name."""
    chunks.write.mode("overwrite").partitionBy("tensor").parquet(path)


def tensor_slice(spark: SparkSession, path: str, tensor: str, start: int = 0, stop: int | None = None, chunk: int = TENSOR_CHUNK) -> DataFrame:
    """S10 reader: ``key, shape, values`` of the positions ``start .. stop - 1`` of every tensor of that name;
    only the chunks that overlap are read."""
    rows = spark.read.parquet(path).where((F.col("tensor") == tensor) & (F.col("chunk") >= start // chunk))
    if stop is not None:
        rows = rows.where(F.col("chunk") <= max(start, stop - 1) // chunk)
    g = rows.groupBy("key").agg(F.first("shape").alias("shape"), F.min("chunk").alias("low"), F.sort_array(F.collect_list(F.struct("chunk", "values"))).alias("c"))
    flat = F.flatten(F.transform("c", lambda x: x["values"]))
    skip = F.greatest(F.lit(start) - F.col("low") * chunk, F.lit(0)).cast("int")
    size = F.size(flat) if stop is None else F.greatest(F.lit(0), F.lit(stop) - F.greatest(F.lit(start), F.col("low") * chunk)).cast("int")
    return g.select("key", "shape", F.slice(flat, skip + 1, size).alias("values"))


# ------------------------------------------------------------------ S11 / S12 / S13

def gpu_csv_scan(spark: SparkSession, path: str) -> DataFrame:
    """``used, total`` MiB lines (nvidia-smi csv,noheader,nounits)."""
    parts = F.split(F.col("value"), ",")
    return spark.read.text(path).select(
        F.trim(F.element_at(parts, 1)).cast("bigint").alias("used_mib"),
        F.trim(F.element_at(parts, 2)).cast("bigint").alias("total_mib"))


def gpu_stream_scan(spark: SparkSession, path: str, fmt: str = "parquet",
                    max_files_per_trigger: int | None = None) -> DataFrame:
    """GPU samples dropped as files by a collector, read as a stream
    (explicit schema; optionally a bounded number of files per batch)."""
    r = spark.readStream.schema(GPU_SAMPLE_SCHEMA).format(fmt)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.load(path)


def inline_dataset(spark: SparkSession, rows: list, schema) -> DataFrame:
    """Small literal rows (dimension data only) -> DataFrame."""
    return spark.createDataFrame(rows, schema)
