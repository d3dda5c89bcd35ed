"""Server-sent-event stream lines -> per-request metrics (S1, P1-P4, W3,
W8, F.8; FIXTURES B3).

Logged ``data: {...}`` lines are parsed with built-in expressions only:
strip, prefix test, ``try_parse_json`` (not ``from_json``, which turns bad
JSON into a struct of NULLs), variant paths.  The ``[DONE]`` cut is a
per-request aggregate joined back on the request id -- a join with a
per-key table, which AQE splits when one request is skewed -- instead of a
window over a whole request.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenlake.operators.chat import words
from tokenlake.sources.tables import table

LINE_MS = 20          # logged time step between two stream lines
DONE = "[DONE]"
PREFIX = "data: "


def _chunk(content: Column) -> Column:
    return F.concat(F.lit(PREFIX), F.to_json(F.struct(F.array(F.struct(
        F.lit(0).alias("index"), F.struct(content.alias("content")).alias("delta"))).alias("choices"))))


def stream_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One logged stream per assistant turn of ``conversations``:
    role-only chunk, one content chunk per word (CR after every 3rd), a
    blank line after every 5th word, a broken JSON line after every 7th,
    a keep-alive comment after every 11th, two usage chunks (the last
    wins), ``[DONE]`` and one chunk after it that must be ignored."""
    c = (table(spark, sf_dir, "conversations").filter(F.col("role") == "assistant")
         .select("conv_id", "turn", "text"))
    w = words(F.col("text"))
    role_line = F.lit(PREFIX + '{"choices":[{"index":0,"delta":{"role":"assistant"}}]}')

    def per_word(x, i):
        k = i + 1
        return F.array(
            F.concat(_chunk(x), F.when(k % 3 == 0, F.lit("\r")).otherwise(F.lit(""))),
            F.when(k % 5 == 0, F.lit("")),
            F.when(k % 7 == 0, F.lit(PREFIX + '{"choices": [')),
            F.when(k % 11 == 0, F.lit(": keep-alive")))

    body = F.filter(F.flatten(F.transform(w, per_word)), lambda x: x.isNotNull())
    n = F.size(w)
    usage = lambda t: F.concat(F.lit(PREFIX + '{"choices":[],"usage":{"completion_tokens":'),
                               t.cast("string"), F.lit("}}"))
    tail = F.array(usage(n - 1), usage(n), F.lit(PREFIX + DONE), _chunk(F.lit("IGNORED")))
    lines = F.concat(F.array(role_line), body, tail)
    return c.select(F.concat_ws(":", "conv_id", "turn").alias("request_id"),
                    F.posexplode(lines).alias("line_no", "line"))


def marked_lines(lines: DataFrame) -> DataFrame:
    """P1 + W3 + P3 + P4: the lines up to the first ``[DONE]`` (all lines
    without one) with data flag, validity, content and usage columns."""
    s = lines.withColumn("s", F.btrim(F.col("line"), F.lit(" \t\r\n")))
    is_data = F.coalesce((F.length("s") > 0) & F.col("s").startswith(PREFIX), F.lit(False))
    s = s.withColumn("payload", F.when(is_data, F.substring(F.col("s"), len(PREFIX) + 1, 1 << 30)))
    # one pass over the raw lines gives the per-request cut and line count
    done = s.groupBy(F.col("request_id").alias("done_id")).agg(
        F.min(F.when(F.col("payload") == DONE, F.col("line_no"))).alias("done_line"),
        F.count(F.lit(1)).alias("n_lines"))
    # the cut line itself stays, as the only one that a request without data may have
    d = s.join(done, F.col("request_id").eqNullSafe(F.col("done_id"))) \
         .filter(F.col("done_line").isNull() | (F.col("line_no") <= F.col("done_line")))
    d = d.withColumn("v", F.try_parse_json(F.when(F.col("line_no").eqNullSafe(F.col("done_line")), None).otherwise(F.col("payload"))))
    content = F.variant_get(F.col("v"), "$.choices[0].delta.content", "string")
    has_choice = F.variant_get(F.col("v"), "$.choices[0]", "variant").isNotNull()
    return d.select("request_id", "line_no", "done_line", "n_lines",
                    (F.col("payload").isNotNull() & ~F.col("line_no").eqNullSafe(F.col("done_line"))).alias("is_data"),
                    F.col("v").isNotNull().alias("valid"),
                    F.when(has_choice & (F.length(content) > 0), content).alias("content"),
                    F.try_variant_get(F.col("v"), "$.usage.completion_tokens", "bigint").alias("usage"))


def parse_lines(lines: DataFrame) -> DataFrame:
    """The data payloads before the first ``[DONE]``."""
    return marked_lines(lines).where("is_data").drop("is_data")


def sse_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S1 + W8 + F.8: per request, chunk counts, first-content and
    first-chunk time, last usage, response length and token estimate."""
    return profile_of(stream_lines(spark, sf_dir))


def profile_of(lines: DataFrame) -> DataFrame:
    """S1 for any logged lines (request_id, line_no, line).  A request without
    a data line has zero counts; ``ok`` is false without content (trap 2)."""
    p = marked_lines(lines)
    g = p.groupBy("request_id").agg(
        F.count(F.when(F.col("is_data"), 1)).alias("n_data"),
        F.count(F.when(F.col("is_data") & ~F.col("valid"), 1)).alias("n_bad_json"),
        F.count("content").alias("n_content"),
        F.min(F.when(F.col("content").isNotNull(), F.col("line_no"))).alias("first_content_line"),
        F.min(F.when(F.col("valid"), F.col("line_no"))).alias("first_chunk_line"),
        F.max_by("usage", F.when(F.col("usage").isNotNull(), F.col("line_no"))).alias("last_usage"),
        F.sum(F.length("content")).alias("response_chars"),
        F.max(F.col("done_line").isNotNull()).alias("has_done"),
        F.max("n_lines").alias("n_lines"))
    est = F.greatest(F.lit(1), F.floor(F.coalesce(F.col("response_chars"), F.lit(0)) / 4).cast("bigint"))
    tokens = (F.when(F.col("last_usage").isNull(), F.col("n_content"))
              .otherwise(F.col("last_usage")))
    tokens = F.when(tokens == 0, F.lit(100)).when(tokens == 1, est).otherwise(tokens)
    return g.select("request_id", "n_lines", "n_data", "n_bad_json", "n_content", "has_done",
                    (F.col("n_content") > 0).alias("ok"),
                    (F.col("first_content_line") * LINE_MS).alias("ttft_content_ms"),
                    (F.col("first_chunk_line") * LINE_MS).alias("ttft_any_chunk_ms"),
                    "last_usage", F.coalesce("response_chars", F.lit(0)).alias("response_chars"),
                    est.alias("est_tokens"), tokens.alias("sglang_tokens"))
