"""Batch == streaming for T1, T2/T4, T3, T5 (availableNow over files
dropped in time order, as a collector would)."""

import datetime as dt
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from tokenlake.operators import sse, telemetry as tel
from tokenlake.sources import files
from tokenlake.sources import fixtures as fx
from tokenlake.streaming import telemetry_stream as ts


def _drop_in_order(df, path, slice_col, n):
    for p in range(n):
        df.filter(F.col(slice_col) == p).drop(slice_col).coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.02)


def _run(df, name, scratch, mode="append"):
    q = (df.writeStream.format("memory").queryName(name).outputMode(mode)
         .option("checkpointLocation", os.path.join(scratch, f"ck_{name}"))
         .trigger(availableNow=True).start())
    q.awaitTermination(600)
    return df.sparkSession.table(name)


def _same(a, b):
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_t1_token_state_machine(spark, sf, scratch):
    ev = fx.events(spark, sf).select(F.col("user_id").alias("request_id"), "event_id", "ts")
    ends = ev.groupBy("request_id").agg(F.max("ts").alias("ts")).withColumn("event_id", F.lit(-1).cast("long"))
    src = ev.withColumn("is_end", F.lit(False)).unionByName(ends.withColumn("is_end", F.lit(True)))
    src = src.withColumn("slice", F.floor(F.dayofmonth("ts") / 8).cast("int"))
    path = os.path.join(scratch, "t1")
    _drop_in_order(src, path, "slice", 4)
    stream = spark.readStream.schema("request_id long, event_id long, ts timestamp_ntz, is_end boolean") \
        .option("maxFilesPerTrigger", 1).parquet(path)
    got = _run(ts.token_state_machine(ts.with_event_time(stream), timeout="40 days", delay="1 hour"),
               "t1_out", scratch)
    want = tel.request_profile(spark, sf).select(
        "request_id", "n_tokens", F.col("ttft_prompt_relative").alias("ttft_s"),
        F.col("second_token_latency").alias("second_token_latency_s"), "decode_tps_excl_first")
    assert _same(got.drop("ended_by"), want)


def _samples(rows):
    """(host, gpu, time, bytes, util, mW) rows."""
    return "host int, gpu_index int, ts timestamp, used_bytes long, util_pct int, power_mw long", rows


RUNS = "run_id string, host int, start_ts timestamp, end_ts timestamp, logged_ts timestamp"


def _streams(spark, scratch, name, batches):
    """Two streams from lists of (sample rows, run rows), one micro-batch each."""
    paths = [os.path.join(scratch, f"{name}_{k}") for k in ("samples", "runs")]
    schemas = (_samples(None)[0], RUNS)
    for batch in batches:
        for path, schema, rows in zip(paths, schemas, batch):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.02)
    return [spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path) for path, schema in zip(paths, schemas)]


def _at(day, hour, minute=0, second=0):
    return dt.datetime(2024, 3, day, hour, minute, second)


FLUSH = [(99, 0, _at(28, 0), 0, 0, 0)]         # moves the watermark past everything


@pytest.fixture
def run_log():
    """A run over midnight, one of three days, one that overlaps it, an open one, and one whose end comes later; samples every 20 minutes."""
    samples = [(h, g, _at(1, 20) + dt.timedelta(minutes=20 * i, seconds=7 * h + g), (h + 1) * 1000 + i, (i * 7 + g) % 100, 500 + i)
               for h in (0, 1) for g in (0, 1) for i in range(360)]
    runs = [("midnight", 0, _at(1, 22), _at(2, 3), _at(1, 22)), ("days", 0, _at(2, 1), _at(5, 2), _at(2, 1)), ("open", 1, _at(2, 5), None, _at(2, 5)),
            ("late-end", 1, _at(3, 0), None, _at(3, 0)), ("late-end", 1, _at(3, 0), _at(4, 12), _at(4, 12)), ("empty", 7, _at(2, 0), _at(2, 1), _at(2, 0))]
    return samples, runs


def _inside(samples, runs):
    ends = {}
    for run_id, host, start, end, _ in runs:
        ends[run_id] = (host, start, end or ends.get(run_id, (0, 0, None))[2])
    return {run_id: [s for s in samples if s[0] == host and s[2] > start and (end is None or s[2] <= end)] for run_id, (host, start, end) in ends.items()}


def _batches(samples, runs, seed):
    """Micro-batches of a day and a half; within one in random order, and each row up to three hours late."""
    rng = random.Random(seed)
    late = lambda t: t + dt.timedelta(minutes=rng.randrange(180))
    cut = [_at(1, 0) + dt.timedelta(hours=36 * k) for k in range(6)]
    s, r = [(late(x[2]), x) for x in samples], [(late(x[4]), x) for x in runs]
    rng.shuffle(s)
    made = [([x for t, x in s if a <= t < b], [x for t, x in r if a <= t < b]) for a, b in zip(cut, cut[1:])]
    return [*made, (FLUSH, []), (FLUSH, [])]


@pytest.mark.parametrize("parts", [1, 3])
def test_t2_one_row_per_run_whatever_its_length(spark, scratch, run_log, parts):
    samples, runs = run_log
    streams = _streams(spark, scratch, f"t2_{parts}", _batches(samples, runs, parts))
    out = _run(ts.gpu_stream_rollup(*streams, delay="4 hours", parts=parts), f"t2_{parts}", scratch)
    rows = ts.merged_runs(out).collect() if parts > 1 else out.where("closed").collect()
    want = {k: v for k, v in _inside(samples, runs).items() if v and k != "open"}
    assert sorted(r.run_id for r in rows) == sorted(want)
    for r in rows:
        own = want[r.run_id]
        assert (r.n_samples, r.max_used_bytes, r.max_gpu) == (len(own), max(s[3] for s in own), max(s[4] for s in own))
        assert r.avg_power == sum(s[5] for s in own) / (len(own) * 1000.0)


def test_t2_open_run_is_seen_while_it_runs(spark, scratch, run_log):
    samples, runs = run_log
    streams = _streams(spark, scratch, "t2_open", _batches(samples, runs, 9))
    rows = _run(ts.gpu_stream_rollup(*streams, delay="4 hours", running=True), "t2_open", scratch).where("run_id = 'open'").collect()
    last = max(rows, key=lambda r: r.emitted_ts)
    assert not any(r.closed for r in rows) and last.n_samples == len(_inside(samples, runs)["open"])


def test_t2_equals_the_batch_report(spark, sf, scratch):
    s = fx.gpu_samples(spark, sf).withColumn("ts", F.col("ts").cast("timestamp")) \
        .withColumn("slice", F.floor(F.dayofmonth("ts") / 8).cast("int"))
    path, run_path = os.path.join(scratch, "t2"), os.path.join(scratch, "t2_runs")
    _drop_in_order(s, path, "slice", 4)
    r = fx.runs(spark, sf).withColumn("slice", F.least(F.floor(F.dayofmonth("start_ts") / 8), F.lit(3)).cast("int"))
    _drop_in_order(r.select("slice", "run_id", "host", *(F.col(c).cast("timestamp") for c in ("start_ts", "end_ts"))), run_path, "slice", 4)
    stream = files.gpu_stream_scan(spark, path, max_files_per_trigger=1)          # S12
    runs = spark.readStream.schema("run_id string, host int, start_ts timestamp, end_ts timestamp").option("maxFilesPerTrigger", 1).parquet(run_path)
    got = _run(ts.gpu_stream_rollup(stream, runs, delay="10 days", bucket="6 hours"), "t2_out", scratch)
    want = tel.run_gpu_rollup(spark, sf)
    got = got.select(*want.columns)
    # runs that end after the last watermark are still open; every emitted one equals its batch value
    assert got.count() > 0 and got.exceptAll(want).count() == 0


def test_t3_sse_stream(spark, sf, scratch):
    lines = sse.stream_lines(spark, sf).withColumn(
        "ts", (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
               + F.make_dt_interval(secs=F.col("line_no").cast("decimal(10,6)") * 0.02)))
    # every request is split over the micro-batches; the lines after [DONE] come in the last ones
    lines = lines.withColumn("slice", F.least(F.floor(F.col("line_no") / 12), F.lit(2)).cast("int"))
    path = os.path.join(scratch, "t3")
    _drop_in_order(lines, path, "slice", 3)
    stream = spark.readStream.schema("request_id string, line_no int, line string, ts timestamp_ntz") \
        .option("maxFilesPerTrigger", 1).parquet(path)
    got = _run(ts.sse_stream(ts.with_event_time(stream), timeout="1 day", delay="1 day"), "t3_out", scratch)
    want = sse.sse_profile(spark, sf).select(
        "request_id", "n_data", "n_bad_json", "n_content",
        (F.col("ttft_content_ms") / sse.LINE_MS).cast("long").alias("first_content_line"),
        (F.col("ttft_any_chunk_ms") / sse.LINE_MS).cast("long").alias("first_chunk_line"),
        "last_usage", "response_chars", "has_done", "ok")
    assert _same(got, want)


def test_t3_lines_in_any_order(spark, scratch):
    """Shuffled over the micro-batches; a request without data lines, one without [DONE], one with a missing line."""
    logs = {"a": ["data: {\"choices\":[{\"delta\":{\"role\":\"assistant\"}}]}", "", "data: {\"choices\":[{\"delta\":{\"content\":\"Hi\"}}]}", "data: {bad",
                  "data: {\"choices\":[{\"delta\":{\"content\":\" you\"}}]}", "data: {\"choices\":[],\"usage\":{\"completion_tokens\":2}}", "data: [DONE]",
                  "data: {\"choices\":[{\"delta\":{\"content\":\"IGNORED\"}}]}"],
            "nothing": ["", ": comment", "data: [DONE]"], "blank": ["", ""]}
    logs["open"] = logs["a"][:5]
    rows = [(k, i, line, _at(1, 0, 0, i)) for k, lines in logs.items() for i, line in enumerate(lines)]
    rows += [("gap", i, line, _at(1, 0, 0, i)) for i, line in enumerate(logs["a"]) if i != 1]
    want = {k: (4, 1, 2, 2, 0, 2, 6, True, True) for k in ("a", "gap")} | {"nothing": (0, 0, 0, None, None, None, 0, True, False),
            "blank": (0, 0, 0, None, None, None, 0, False, False), "open": (4 - 1 + 0, 1, 2, 2, 0, None, 6, False, True)}
    want["a"] = want["gap"] = (5, 1, 2, 2, 0, 2, 6, True, True)
    want["open"] = (4, 1, 2, 2, 0, None, 6, False, True)
    schema = "request_id string, line_no int, line string, ts timestamp"
    for seed in range(2):
        shuffled = random.Random(seed).sample(rows, len(rows))
        path = os.path.join(scratch, f"t3_{seed}")
        for k in range(4):
            spark.createDataFrame(shuffled[k::4], schema).coalesce(1).write.mode("append").parquet(path)
            time.sleep(0.02)
        for day in (3, 4):
            spark.createDataFrame([("flush", 0, "data: [DONE]", _at(day, 0))], schema).coalesce(1).write.mode("append").parquet(path)
            time.sleep(0.02)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
        got = _run(ts.sse_stream(stream, timeout="1 hour", delay="1 hour"), f"t3_any_{seed}", scratch).collect()
        assert {r.request_id: tuple(r)[1:] for r in got if r.request_id != "flush"} == want
        batch = {r.request_id: (r.n_data, r.n_bad_json, r.n_content, r.response_chars, r.has_done, r.ok)
                 for r in sse.profile_of(spark.createDataFrame(rows, schema)).collect()}
        assert batch == {k: (v[0], v[1], v[2], v[6], v[7], v[8]) for k, v in want.items()}


def test_t5_live_gpu_view(spark, sf, scratch):
    s = fx.gpu_samples(spark, sf).withColumn("ts", F.col("ts").cast("timestamp")) \
        .withColumn("slice", F.floor(F.dayofmonth("ts") / 8).cast("int"))
    path = os.path.join(scratch, "t5")
    _drop_in_order(s, path, "slice", 4)
    stream = files.gpu_stream_scan(spark, path, max_files_per_trigger=1)          # S12
    got = _run(ts.live_gpu_view(stream), "t5_out", scratch, mode="complete")
    want = tel.live_gpu_view(spark, sf).select(
        "host", "gpu_index", F.col("ts").cast("timestamp").alias("ts"), "used_gib", "util_pct", "temp_c", "power_w")
    assert _same(got.withColumn("ts", F.col("ts").cast("timestamp")), want)


def test_t4_stream_stream_run_gate(spark, sf, scratch):
    s = fx.gpu_samples(spark, sf).withColumn("ts", F.col("ts").cast("timestamp")) \
        .withColumn("slice", F.floor(F.dayofmonth("ts") / 8).cast("int"))
    r = fx.runs(spark, sf).withColumn("start_ts", F.col("start_ts").cast("timestamp")) \
        .withColumn("end_ts", F.col("end_ts").cast("timestamp")) \
        .withColumn("slice", F.least(F.floor(F.dayofmonth("start_ts") / 8), F.lit(3)).cast("int"))
    sp, rp = os.path.join(scratch, "t4s"), os.path.join(scratch, "t4r")
    for p in range(4):       # runs and samples of each period arrive together
        r.filter(F.col("slice") == p).drop("slice").coalesce(1).write.mode("append").parquet(rp)
        s.filter(F.col("slice") == p).drop("slice").coalesce(1).write.mode("append").parquet(sp)
    samples = files.gpu_stream_scan(spark, sp, max_files_per_trigger=1)
    runs = spark.readStream.schema("run_id string, host int, start_ts timestamp, end_ts timestamp") \
        .option("maxFilesPerTrigger", 1).parquet(rp)
    got = _run(ts.run_gate_stream(samples, runs, delay="10 days", bucket="6 hours"), "t4_out", scratch)
    want = tel.gpu_run_samples(spark, sf).select("run_id", "host", "gpu_index",
                                                 F.col("ts").cast("timestamp").alias("ts"),
                                                 "used_bytes", "util_pct", "power_mw")
    # samples after the last watermark still wait
    assert got.exceptAll(want).count() == 0 and got.count() > 0
    settled = got.agg(F.max("ts")).first()[0]
    assert want.where(F.col("ts") <= settled).exceptAll(got).count() == 0


def test_t4_every_sample_of_long_and_open_runs(spark, scratch, run_log):
    samples, runs = run_log
    streams = _streams(spark, scratch, "t4_long", _batches(samples, runs, 4))
    rows = _run(ts.run_gate_stream(*streams, delay="4 hours", parts=2), "t4_long", scratch).collect()
    got = sorted((r.run_id, r.gpu_index, r.ts, r.used_bytes) for r in rows)
    assert got == sorted((k, s[1], s[2], s[3]) for k, own in _inside(samples, runs).items() for s in own)
