"""Inference telemetry reports (SURVEY family I).

Durations are integer microseconds until the last projection, so every
sum is exact; rates are carried as (numerator, denominator) sums so that
both ratio-of-sums and mean-of-ratios come out of one aggregation
(SURVEY 4, technique 3).  Each metric variant of SURVEY 0.1 keeps its own
name and formula.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tokenlake.functions.common import micros, truncate_label
from tokenlake.operators.joins import interval_join
from tokenlake.operators.ordered import first_k, prefix_scan
from tokenlake.sources import fixtures as fx
from tokenlake.sources.tables import table

US = 1_000_000.0

# ---- fixed values ----------------------------------------------------------
# Prompt template; ``{input_text}`` is replaced by the prompt text (F.16).
PROMPT_TEMPLATE = "Answer the following request.\n\n{input_text}\n\nAnswer:"
# Fixed-width comparison line: framework, TTFT, decode rate, VRAM, GPU %.
REPORT_LINE = "%-15s | %-13.3f | %-13.2f | %-15.2f | %-11.1f"
# ---------------------------------------------------------------------------


def _div(num, den):
    """num / den as double, NULL when den is 0 or NULL."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def _per_sec(count, dur_us):
    """count per second from an integer-microsecond duration."""
    return F.try_divide(count.cast("double") * F.lit(US), dur_us.cast("double"))


# ---------------------------------------------------------------- A1 / W2

def request_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.events(spark, sf_dir).select(
        F.col("user_id").alias("request_id"), "event_id", "ts",
        F.col("event_type").alias("text"))


def request_base(spark: SparkSession, sf_dir: str, content: bool = True) -> DataFrame:
    """Per-request base metrics of the B1 views of ``events``."""
    return request_metrics(request_events(spark, sf_dir), fx.requests(spark, sf_dir), content)


def request_metrics(ev: DataFrame, requests: DataFrame, content: bool = True) -> DataFrame:
    """Per request: start (prompt phase), first and second token time, end,
    row count and response characters -- two map-side-combined aggregates
    (the first-3 rows go through a WindowGroupLimit) joined on request_id.

    ``ev`` is any token-event table (request_id, event_id, ts, text) and
    ``requests`` the attributes of each request (request_id, backend,
    concurrency, http_status, usage_tokens); a request without a reported
    usage counts its own tokens.  Events with a null request_id form one
    request of their own.

    The first row of a request is its prompt phase, every later one a chunk
    of any kind (role-only and blank ones have null or empty text).  The
    request starts at ``requests.sent_ts`` (same type as ``ts``) where that
    column is given and not null, else with its first row.  ``ttft_us`` is
    the first chunk minus the prompt phase, ``ttft_any_us`` the first chunk
    minus the start, ``ttft_content_us`` the first chunk with text minus the
    start.  ``n_content`` chunks have text, ``gap_us`` lies between the first
    and the last of them.  A request is ``ok`` with status 200 and at least
    one chunk with text (trap 2).  Reports that need neither of these four
    columns set ``content`` to false, which leaves the texts unread."""
    heads = (first_k(ev, "request_id", [F.col("ts"), F.col("event_id")], 3)
             .groupBy("request_id")
             .agg(F.min(F.when(F.col("rk") == 1, F.col("ts"))).alias("prompt_ts"),
                  F.min(F.when(F.col("rk") == 2, F.col("ts"))).alias("first_ts"),
                  F.min(F.when(F.col("rk") == 3, F.col("ts"))).alias("second_ts"),
                  F.max(F.when(F.col("rk") == 1, F.length("text"))).alias("prompt_chars")))
    totals = ev.groupBy("request_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.max("ts").alias("end_ts"),
        F.count(F.when(F.length("text") > 0, F.lit(1))).alias("n_texts"),
        F.max(F.when(F.length("text") > 0, F.col("ts"))).alias("last_text_ts"),
        F.sum(F.length("text")).alias("all_chars"))
    b = (heads.join(totals.withColumnRenamed("request_id", "total_id"), F.col("request_id").eqNullSafe(F.col("total_id")))
         .join(requests.select(F.col("request_id").alias("attribute_id"), "backend", "concurrency", "http_status", "usage_tokens",
                               *(["sent_ts"] if "sent_ts" in requests.columns else [])),
               F.col("request_id").eqNullSafe(F.col("attribute_id")), "left"))
    b = b.withColumn("start_ts", F.coalesce("sent_ts", "prompt_ts") if "sent_ts" in requests.columns else F.col("prompt_ts"))
    if content:
        b = _with_content(b, ev)
    n_tokens = F.col("n_rows") - 1
    return b.select(
        "request_id", "backend", "concurrency", "http_status",
        "start_ts", "first_ts", "second_ts", "end_ts",
        n_tokens.alias("n_tokens"),
        (F.coalesce("all_chars", F.lit(0)) - F.coalesce("prompt_chars", F.lit(0))).alias("response_chars"),
        F.coalesce("usage_tokens", n_tokens).cast("bigint").alias("usage_tokens"),
        (micros("first_ts") - micros("prompt_ts")).alias("ttft_us"),
        (micros("first_ts") - micros("start_ts")).alias("ttft_any_us"),
        (micros("second_ts") - micros("first_ts")).alias("second_us"),
        (micros("end_ts") - micros("start_ts")).alias("total_us"),
        (micros("end_ts") - micros("first_ts")).alias("decode_us"),
        *([(micros("content_ts") - micros("start_ts")).alias("ttft_content_us"), "n_content",
           F.when(F.col("n_content") > 0, micros("last_text_ts") - micros("content_ts")).alias("gap_us"),
           ((F.col("http_status") == 200) & (F.col("n_content") >= 1)).alias("ok")] if content else []))


def _with_content(b: DataFrame, ev: DataFrame) -> DataFrame:
    """First chunk with text and the number of such chunks, the prompt row left out."""
    # the prompt row may be one of the first two rows with text
    texts = (first_k(ev.where(F.length("text") > 0), "request_id", [F.col("ts"), F.col("event_id")], 2)
             .groupBy(F.col("request_id").alias("text_id"))
             .agg(F.min(F.when(F.col("rk") == 1, F.col("ts"))).alias("text1_ts"),
                  F.min(F.when(F.col("rk") == 2, F.col("ts"))).alias("text2_ts")))
    from_prompt = F.coalesce(F.col("prompt_chars") > 0, F.lit(False))
    return (b.join(texts, F.col("request_id").eqNullSafe(F.col("text_id")), "left")
            .withColumn("content_ts", F.when(from_prompt, F.col("text2_ts")).otherwise(F.col("text1_ts")))
            .withColumn("n_content", F.col("n_texts") - from_prompt.cast("bigint")))


def request_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1: every per-request metric variant of SURVEY 0.1."""
    return profile_of(request_base(spark, sf_dir))


def profile_of(b: DataFrame) -> DataFrame:
    """A1 from a ``request_metrics`` table."""
    return b.select(*_profile())


def _profile() -> list:
    ttft0 = F.coalesce(F.col("ttft_content_us"), F.lit(0))     # the clients' ttft
    client_div = F.col("total_us") - ttft0
    v_tokens = F.when(F.col("usage_tokens") == 0, F.lit(100)).otherwise(F.col("usage_tokens"))
    s_tokens = (F.when(F.col("usage_tokens") == 0, F.lit(100))
                .when(F.col("usage_tokens") == 1,
                      F.greatest(F.lit(1), F.floor(F.col("response_chars") / 4).cast("bigint")))
                .otherwise(F.col("usage_tokens")))
    hf_tokens = F.col("n_tokens") - 1
    return [
        "request_id", "backend", "concurrency", "http_status", "ok", "n_tokens", "usage_tokens",
        "ttft_us",
        (F.col("ttft_us") / F.lit(US)).alias("ttft_prompt_relative"),
        (F.col("ttft_content_us") / F.lit(US)).alias("ttft_content"),
        (F.col("ttft_any_us") / F.lit(US)).alias("ttft_any_chunk"),
        (F.col("second_us") / F.lit(US)).alias("second_token_latency"),
        F.when(hf_tokens > 0, _per_sec(hf_tokens, F.col("decode_us"))).alias("decode_tps_excl_first"),
        F.when(client_div > 0, _per_sec(v_tokens - 1, client_div))
         .otherwise(F.lit(0.0)).alias("decode_tps_usage_minus1"),
        _per_sec(s_tokens, F.when(client_div > 0, client_div).otherwise(F.lit(1000)))
         .alias("decode_tps_usage_full"),
        _per_sec(F.col("n_tokens"), F.col("total_us")).alias("e2e_tps"),
        (F.col("total_us") / F.lit(US)).alias("total_s"),
    ]


def first_second_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prompt row, first and second token of each request."""
    ev = request_events(spark, sf_dir)
    top = first_k(ev, "request_id", [F.col("ts"), F.col("event_id")], 3)
    label = F.element_at(F.array(F.lit("prompt"), F.lit("first"), F.lit("second")),
                         F.col("rk").cast("int"))
    return top.select("request_id", (F.col("rk") - 1).cast("bigint").alias("token_idx"),
                      label.alias("phase"), "event_id", "ts")


# ---------------------------------------------------------------- W1 / A5

def inter_token_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gap between consecutive generated tokens (token_idx >= 2)."""
    te = fx.token_events(spark, sf_dir)
    return te.filter(F.col("token_idx") >= 2).select(
        "request_id", "token_idx", "event_id",
        ((micros("ts") - micros("prev_ts")) / F.lit(US)).alias("gap_s"))


def concurrency_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5: per concurrency level avg content TTFT, pooled gap between chunks
    with text, failure rate and request count; NULL means are kept (trap 3).

    Gaps telescope: the sum of a request's consecutive gaps is last - first
    content time and their count is n_content - 1, so the pooled mean needs
    no per-row window at all.
    """
    return concurrency_of(request_base(spark, sf_dir))


def concurrency_of(b: DataFrame) -> DataFrame:
    """A5 from a ``request_metrics`` table."""
    ok = F.col("ok")
    g = b.groupBy("concurrency").agg(
        F.sum(F.when(ok, F.col("ttft_content_us"))).alias("ttft_sum"),
        F.count(F.when(ok, F.lit(1))).alias("n_ok"),
        F.sum(F.when(ok, F.col("gap_us"))).alias("gap_sum"),
        F.sum(F.when(ok, F.col("n_content") - 1)).alias("gap_n"),
        F.count(F.lit(1)).alias("num_requests"))
    return g.select(
        "concurrency",
        _div(F.col("ttft_sum"), F.col("n_ok") * F.lit(US)).alias("avg_ttft"),
        _div(F.col("gap_sum"), F.col("gap_n") * F.lit(US)).alias("avg_inter_token_latency"),
        _div(F.col("num_requests") - F.col("n_ok"), F.col("num_requests")).alias("failure_rate"),
        "num_requests")


# ---------------------------------------------------------------- J1 / A2 / A8

def gpu_run_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J1 + P6 + P7: samples inside their run, in GiB and W."""
    s = fx.gpu_samples(spark, sf_dir)
    r = fx.runs(spark, sf_dir)
    j = interval_join(s, r, "host", "ts", "start_ts", "end_ts")
    return j.select("run_id", "host", "gpu_index", "ts", "util_pct", "power_mw", "used_bytes",
                    (F.col("used_bytes") / F.lit(float(fx.GIB))).alias("used_gib"),
                    (F.col("power_mw") / F.lit(1000.0)).alias("power_w"))


def run_gpu_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2: per run max memory (GiB), max utilisation, mean power (W)."""
    j = gpu_run_samples(spark, sf_dir)
    g = j.groupBy("run_id", "host").agg(
        F.count(F.lit(1)).alias("n_samples"),
        F.max("used_bytes").alias("max_used_bytes"),
        F.max("util_pct").alias("max_gpu"),
        F.sum("power_mw").alias("power_mw_sum"))
    return g.select("run_id", "host", "n_samples",
                    (F.col("max_used_bytes") / F.lit(float(fx.GIB))).alias("max_mem"),
                    "max_gpu",
                    _div(F.col("power_mw_sum"), F.col("n_samples") * F.lit(1000.0)).alias("avg_power"))


def runs_without_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2 (report branch): runs with no sample inside them (left anti)."""
    r = fx.runs(spark, sf_dir)
    hit = gpu_run_samples(spark, sf_dir).select("run_id").distinct()
    return r.join(hit, "run_id", "left_anti").select("run_id", "host", "start_ts", "end_ts")


def overall_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per host, max of per-run maxima and the *unweighted* mean of
    per-run mean power."""
    a2 = run_gpu_rollup(spark, sf_dir)
    return a2.groupBy("host").agg(
        F.count(F.lit(1)).alias("n_runs"),
        F.max("max_mem").alias("max_mem"),
        F.max("max_gpu").alias("max_gpu"),
        F.round(F.avg("avg_power"), 9).alias("avg_power"))


# ---------------------------------------------------------------- A3 / A4 / A16

def hf_run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3: Hugging Face report.  Requests of backend 0 that produced more
    than one token; tokens/s is a ratio of sums; GPU part from A8 on the
    backend's host."""
    b = request_base(spark, sf_dir).filter((F.col("backend") == fx.BACKENDS[0]) & F.col("ok"))
    hf_tokens = F.col("n_tokens") - 1
    req = b.filter(hf_tokens > 0).groupBy("backend").agg(
        F.sum(hf_tokens).alias("total_tokens"),
        F.sum("decode_us").alias("dur_us"),
        F.sum("ttft_us").alias("ttft_sum"),
        F.count(F.lit(1)).alias("n"))
    req = req.join(fx.backend_hosts(spark), "backend")
    j = req.join(overall_rollup(spark, sf_dir), "host")
    return j.select(
        "backend", "total_tokens",
        (F.col("dur_us") / F.lit(US)).alias("total_duration"),
        F.coalesce(_per_sec(F.col("total_tokens"), F.col("dur_us")), F.lit(0.0)).alias("tokens_per_second"),
        F.coalesce(_div(F.col("ttft_sum"), F.col("n") * F.lit(US)), F.lit(0.0)).alias("avg_ttft"),
        "max_mem", "max_gpu", "avg_power")


def client_run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4: client report per backend: mean content TTFT and mean of per-request
    rates over successful requests (0 when none, trap 3); the rate formula
    is the backend's own (SURVEY 0.1).  GPU: all samples of GPU 0 of the
    backend's host, no time filter (trap 7)."""
    s = fx.gpu_samples(spark, sf_dir)
    return client_summary_of(request_base(spark, sf_dir), fx.backend_hosts(spark), s)


def client_summary_of(b: DataFrame, hosts: DataFrame, samples: DataFrame) -> DataFrame:
    """A4 from a ``request_metrics`` table, the host of every backend and GPU samples."""
    p = b.select("ttft_content_us", *_profile()).filter(F.col("ok"))
    rate = (F.when(F.col("backend") == "SGLang", F.col("decode_tps_usage_full"))
            .when(F.col("backend") == "vLLM", F.col("decode_tps_usage_minus1"))
            .otherwise(F.col("decode_tps_excl_first")))
    req = p.groupBy("backend").agg(
        F.coalesce(_div(F.sum("ttft_content_us"), F.count(F.lit(1)) * F.lit(US)), F.lit(0.0)).alias("avg_ttft_sec"),
        F.coalesce(F.round(F.avg(rate), 9), F.lit(0.0)).alias("avg_decode_tokens_per_sec"))
    req = req.join(hosts, "backend")
    gpu = samples.filter(F.col("gpu_index") == 0).groupBy("host").agg(
        F.max("used_bytes").alias("mx"), F.max("util_pct").alias("max_gpu_compute_percent"),
        F.sum("power_mw").alias("pw"), F.count(F.lit(1)).alias("n"))
    j = req.join(gpu, "host", "left")
    return j.select(
        "backend", "avg_ttft_sec", "avg_decode_tokens_per_sec",
        F.coalesce(F.col("mx") / F.lit(float(fx.GIB)), F.lit(0.0)).alias("peak_vram_gb"),
        F.coalesce(F.col("max_gpu_compute_percent"), F.lit(0)).alias("max_gpu_compute_percent"),
        F.coalesce(_div(F.col("pw"), F.col("n") * F.lit(1000.0)), F.lit(0.0)).alias("avg_power_watts"))


def backend_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A16 (Z1 + P10 + O2): one row per backend from the two report shapes,
    keys normalised by first-present, in declared backend order."""
    hf = hf_run_summary(spark, sf_dir)
    cl = client_run_summary(spark, sf_dir).filter(F.col("backend") != fx.BACKENDS[0])
    u = hf.unionByName(cl, allowMissingColumns=True)
    order = F.array(*[F.lit(b) for b in fx.BACKENDS])
    return u.select(
        "backend",
        F.array_position(order, F.col("backend")).cast("int").alias("report_pos"),
        F.coalesce("avg_ttft", "avg_ttft_sec", F.lit(0.0)).alias("ttft"),
        F.coalesce("avg_decode_tokens_per_sec", "tokens_per_second", F.lit(0.0)).alias("tps"),
        F.coalesce("peak_vram_gb", "max_mem", F.lit(0.0)).alias("vram"),
        F.coalesce(F.col("max_gpu_compute_percent").cast("double"),
                   F.col("max_gpu").cast("double"), F.lit(0.0)).alias("gpu"),
    ).orderBy("report_pos")


def backend_report_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The comparison table as fixed-width text lines, in report order."""
    c = backend_comparison(spark, sf_dir)
    return c.select("report_pos", F.format_string(REPORT_LINE, "backend", "ttft", "tps", "vram", "gpu")
                    .alias("line")).orderBy("report_pos")


def client_prompt_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J7 + F.16 + trap 15: the i-th client sends the i-th prompt (equi join
    client_id = prompt_idx over the benchmark prompts); the prompt is the
    template with ``{input_text}`` replaced, and its length is measured,
    never taken from a label."""
    from tokenlake.operators.chat import n_tokens
    p = table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("prompt_idx"),
        F.replace(F.lit(PROMPT_TEMPLATE), F.lit("{input_text}"), F.col("text")).alias("prompt"))
    r = request_base(spark, sf_dir).select(F.col("request_id").alias("client_id"), "ok", "total_us", "ttft_us")
    j = r.join(p, r["client_id"] == p["prompt_idx"])
    return j.select("client_id", "prompt_idx", "ok", n_tokens(F.col("prompt")).alias("prompt_words"),
                    F.length("prompt").alias("prompt_chars"),
                    (F.col("total_us") / F.lit(US)).alias("latency_s"),
                    (F.col("ttft_us") / F.lit(US)).alias("ttft_s"))


# ---------------------------------------------------------------- A6 / A7 / A14

def batch_throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per backend batch: total reported (usage) tokens, batch duration, mean request
    latency and aggregate tokens/s."""
    b = request_base(spark, sf_dir, content=False)
    g = b.groupBy("backend").agg(
        F.sum("usage_tokens").alias("total_tokens"),
        F.min("start_ts").alias("b0"), F.max("end_ts").alias("b1"),
        F.sum("total_us").alias("lat_sum"), F.count(F.lit(1)).alias("n"))
    dur = micros("b1") - micros("b0")
    return g.select("backend", "total_tokens",
                    (dur / F.lit(US)).alias("batch_duration"),
                    _div(F.col("lat_sum"), F.col("n") * F.lit(US)).alias("avg_latency"),
                    _per_sec(F.col("total_tokens"), dur).alias("throughput"))


def wall_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per concurrency batch, wall time and per-client latency."""
    b = request_base(spark, sf_dir, content=False)
    g = b.groupBy("concurrency").agg(
        F.min("start_ts").alias("b0"), F.max("end_ts").alias("b1"),
        F.count(F.lit(1)).alias("n_clients"), F.max("total_us").alias("max_us"),
        F.sum("total_us").alias("sum_us"))
    return g.select("concurrency", "n_clients",
                    ((micros("b1") - micros("b0")) / F.lit(US)).alias("wall_s"),
                    (F.col("max_us") / F.lit(US)).alias("max_latency_s"),
                    _div(F.col("sum_us"), F.col("n_clients") * F.lit(US)).alias("avg_latency_s"))


def runner_throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq_len / dt and (seq_len - input_len) / dt per request, where
    the sequence is every row of the request and the input is the prompt
    row."""
    b = request_base(spark, sf_dir, content=False)
    seq = F.col("n_tokens") + 1
    return b.select("request_id", seq.alias("seq_len"), F.lit(1).alias("input_len"),
                    _per_sec(seq, F.col("total_us")).alias("runner_total_tps"),
                    _per_sec(seq - 1, F.col("total_us")).alias("runner_decode_tps"))


# ---------------------------------------------------------------- W10

def prefix_cold_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W10 on B13: requests sharing a system prompt (user_id % 7); the
    first by start time is COLD, later ones HOT; mean TTFT (first chunk of
    any kind) and round trip per (prompt, label).

    One map-side-combined aggregate per prompt (the COLD request by
    ``min_by`` on (start, id), totals for all): HOT = totals minus COLD.
    No window over a prompt's requests, which may be a third of the data.
    """
    b = request_base(spark, sf_dir, content=False)
    b = b.withColumn("system_prompt", F.concat(F.lit("token system prompt prefix #"),
                                               F.pmod(F.col("request_id"), F.lit(7)).cast("string")))
    return cold_hot_of(b)


def cold_hot_of(b: DataFrame) -> DataFrame:
    """W10 from a ``request_metrics`` table with ``system_prompt``."""
    b = b.filter(F.col("n_tokens") >= 1)
    g = b.groupBy(F.sha2(F.col("system_prompt"), 256).alias("prefix_key")).agg(
        F.first("system_prompt").alias("system_prompt"),
        F.count(F.lit(1)).alias("n"), F.sum("ttft_any_us").alias("t"), F.sum("total_us").alias("rt"),
        F.min_by(F.struct("ttft_any_us", "total_us"), F.struct("start_ts", "request_id")).alias("cold"))
    rows = F.array(
        F.struct(F.lit("RUN 1 - COLD").alias("run_label"), F.lit(1).cast("bigint").alias("k"),
                 F.col("cold.ttft_any_us").alias("t"), F.col("cold.total_us").alias("rt")),
        F.struct(F.lit("RUN 2 - HOT").alias("run_label"), (F.col("n") - 1).alias("k"),
                 (F.col("t") - F.col("cold.ttft_any_us")).alias("t"), (F.col("rt") - F.col("cold.total_us")).alias("rt")))
    u = g.select("system_prompt", F.inline(rows)).filter(F.col("k") > 0).withColumnRenamed("k", "n")
    return u.select("system_prompt", "run_label", "n",
                    _div(F.col("t"), F.col("n") * F.lit(US)).alias("avg_ttft"),
                    _div(F.col("rt"), F.col("n") * F.lit(US)).alias("avg_roundtrip"))


# ---------------------------------------------------------------- T5 batch twin

def live_gpu_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T5 (batch twin): latest sample per (host, gpu) -- max_by is a
    partial aggregate, safe for hot devices."""
    s = fx.gpu_samples(spark, sf_dir)
    latest = F.max_by(F.struct("ts", "used_bytes", "util_pct", "temp_c", "power_mw"),
                      F.struct("ts", "used_bytes", "util_pct", "power_mw"))
    g = s.groupBy("host", "gpu_index").agg(latest.alias("l"))
    return g.select("host", "gpu_index", F.col("l.ts").alias("ts"),
                    (F.col("l.used_bytes") / F.lit(float(fx.GIB))).alias("used_gib"),
                    F.col("l.util_pct").alias("util_pct"), F.col("l.temp_c").alias("temp_c"),
                    (F.col("l.power_mw") / F.lit(1000.0)).alias("power_w"))


# ---------------------------------------------------------------- B12: W5 / A17 / S11

def memory_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a training memory log: run = user, tag = event type,
    value = memory (MiB = value * 16)."""
    ev = fx.events(spark, sf_dir).select(
        F.col("user_id").alias("run"), "event_id", "ts", F.col("event_type").alias("tag"),
        F.round(F.col("value") * F.lit(16.0)).cast("bigint").alias("mem_mib"))
    return ev


def running_peak(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running max of memory per run in step order (prefix scan)."""
    m = memory_log(spark, sf_dir)
    out = prefix_scan(m, "run", "ts", "event_id", idx="step", prev_ts=None,
                      running_max="mem_mib", running_max_out="running_peak_mib")
    return out.select("run", "step", "tag", "mem_mib", "running_peak_mib")


def vram_high_water(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peak allocation per run and tag."""
    m = memory_log(spark, sf_dir)
    return m.groupBy("run", "tag").agg(F.max("mem_mib").alias("peak_mib"),
                                       F.count(F.lit(1)).alias("n_points"))


def gpu_csv_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S11 input: nvidia-smi style ``used, total`` MiB lines derived from the
    GPU samples."""
    s = fx.gpu_samples(spark, sf_dir)
    return s.select("host", "gpu_index", "ts", F.concat(
        F.floor(F.col("used_bytes") / F.lit(1024 * 1024)).cast("string"), F.lit(", "),
        F.floor(F.col("total_bytes") / F.lit(1024 * 1024)).cast("string")).alias("line"))


def gpu_csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parse ``used, total`` lines; peak used per host/GPU in MiB."""
    ln = gpu_csv_lines(spark, sf_dir)
    parts = F.split(F.col("line"), ", ")
    p = ln.select("host", "gpu_index",
                  F.element_at(parts, 1).cast("bigint").alias("used_mib"),
                  F.element_at(parts, 2).cast("bigint").alias("total_mib"))
    return p.groupBy("host", "gpu_index").agg(F.max("used_mib").alias("peak_used_mib"),
                                              F.max("total_mib").alias("total_mib"),
                                              F.count(F.lit(1)).alias("n_lines"))


# ---------------------------------------------------------------- B14: A15

def warm_mean_latency(spark: SparkSession, sf_dir: str, warmup: int = 10,
                      timed: int = 10) -> DataFrame:
    """Per batch (supplier), iterations in order of order, line and value; mean
    latency of iterations warmup+1 .. warmup+timed.  The rank predicate
    lets Catalyst cut each batch to warmup+timed rows before the shuffle."""
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_quantity")
    # rows that agree on all three are equal in what is averaged
    w = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_quantity")
    it = li.withColumn("iteration", F.row_number().over(w)).filter(
        F.col("iteration") <= warmup + timed)
    it = it.filter(F.col("iteration") > warmup)
    return it.groupBy(F.col("l_suppkey").alias("batch")).agg(
        F.count(F.lit(1)).alias("n_timed"),
        F.sum(F.round(F.col("l_quantity") * 100).cast("bigint")).alias("_c")
    ).select("batch", "n_timed", _div(F.col("_c"), F.col("n_timed") * F.lit(100.0)).alias("mean_latency"))


def prompt_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The HF per-prompt report rows with the truncated label."""
    a2 = run_gpu_rollup(spark, sf_dir)
    return a2.select(truncate_label(F.concat(F.lit("run "), F.col("run_id"),
                                             F.lit(" on host "), F.col("host").cast("string")))
                     .alias("prompt_summary"), "run_id", "max_mem", "max_gpu", "avg_power")
