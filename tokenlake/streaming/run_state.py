"""Run-keyed and line-ordered streaming state.

``transformWithStateInPandas`` with event-time timers, so nothing is closed
by a calendar window or a longest run:

run_gate_stream    samples and run rows in one stream, keyed by (host, part).
                   Samples wait in time buckets until the watermark has passed
                   them; by then every run row that is at most ``delay`` late
                   is known, so the result doesn't depend on the micro-batches.
gpu_stream_rollup  the same state with the samples folded into their runs; a
                   run is reported once, when the watermark has passed its end.
sse_stream         lines of a request are folded in the order of line_no;
                   those that come early wait in the state.

State is kept by RocksDB (``state_settings``), so waiting samples and lines
live on disk and a step reads only the buckets it touches.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

SAMPLE_OUT = "run_id string, host int, gpu_index int, ts timestamp, used_bytes long, util_pct int, power_mw long"
ROLLUP_OUT = ("run_id string, host int, part int, n_samples long, max_used_bytes long, max_gpu int, power_mw_sum long, "
              "closed boolean, emitted_ts timestamp")
RUN_STATE = "start_us long, end_us long, n long, max_used long, max_util int, power long"


def state_settings(spark: SparkSession) -> None:
    """The state store that ``transformWithStateInPandas`` needs, where the session names none."""
    key = "spark.sql.streaming.stateStore.providerClass"
    if "RocksDB" not in spark.conf.get(key, ""):
        spark.conf.set(key, PROVIDER)


def _micros(values: pd.Series) -> np.ndarray:
    return values.to_numpy().astype("datetime64[us]").astype("int64")


class _Runs(StatefulProcessor):
    """Runs of a (host, part) and the samples that wait for the watermark.

    ``waiting`` maps a time bucket to its samples, ``runs`` a run id to its
    bounds (microseconds, end -1: open) and, in the rollup, its sums so far.
    A timer at the end of a bucket settles its samples; a run's timer is that
    of the bucket in which it ends.
    """

    def __init__(self, width_us: int, rollup: bool, running: bool):
        self.width, self.rollup, self.running = width_us, rollup, running

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "bucket long", "rows binary")
        self.runs = handle.getMapState("runs", "run_id string", RUN_STATE)

    def _timer(self, us: int) -> int:
        """Milliseconds at which the bucket of ``us`` is over."""
        expiry = (us // self.width + 1) * self.width // 1000
        self.handle.registerTimer(expiry)
        return expiry

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            for r in pdf[pdf["run_id"].notna()].itertuples(index=False):
                held = self.runs.getValue((r.run_id,)) if self.runs.containsKey((r.run_id,)) else None
                start = int(pd.Timestamp(r.start_ts).value // 1000)
                end = -1 if pd.isna(r.end_ts) else int(pd.Timestamp(r.end_ts).value // 1000)
                sums = tuple(held[2:]) if held else (0, -1, -1, 0)
                end = held[1] if held and end == -1 else end
                self.runs.updateValue((r.run_id,), (start, end, *sums))
                if end != -1:
                    self._timer(end)
            samples = pdf[pdf["run_id"].isna()]
            if len(samples):
                new = np.stack([_micros(samples["ts"]), samples["gpu_index"].to_numpy("int64"), samples["used_bytes"].to_numpy("int64"),
                                samples["util_pct"].to_numpy("int64"), samples["power_mw"].to_numpy("int64")], 1)
                bucket = new[:, 0] // self.width
                for b in np.unique(bucket).tolist():
                    old = self.waiting.getValue((b,))[0] if self.waiting.containsKey((b,)) else b""
                    self.waiting.updateValue((b,), (bytes(old) + new[bucket == b].tobytes(),))
                    self._timer(b * self.width)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        host, part = int(key[0]), int(key[1])
        expiry_us = expiredTimerInfo.getExpiryTimeInMs() * 1000
        runs = {k[0]: list(v) for k, v in self.runs.iterator()}
        touched = set()
        for b in sorted(k[0] for k in self.waiting.keys()):
            if (b + 1) * self.width > expiry_us:
                break
            rows = np.frombuffer(bytes(self.waiting.getValue((b,))[0]), np.int64).reshape(-1, 5)
            self.waiting.removeKey((b,))
            for run_id, run in runs.items():
                inside = rows[(rows[:, 0] > run[0]) & ((rows[:, 0] <= run[1]) | (run[1] == -1))]
                if not len(inside):
                    continue
                touched.add(run_id)
                if self.rollup:
                    run[2] += len(inside)
                    run[3] = max(run[3], int(inside[:, 2].max()))
                    run[4] = max(run[4], int(inside[:, 3].max()))
                    run[5] += int(inside[:, 4].sum())
                else:
                    yield pd.DataFrame({"run_id": run_id, "host": host, "gpu_index": inside[:, 1], "ts": inside[:, 0].astype("datetime64[us]"),
                                        "used_bytes": inside[:, 2], "util_pct": inside[:, 3], "power_mw": inside[:, 4]})
        at = pd.Timestamp(expiry_us, unit="us")
        out = []
        for run_id, run in runs.items():
            closed = run[1] != -1 and run[1] < expiry_us
            if closed:
                self.runs.removeKey((run_id,))
            elif run_id in touched:
                self.runs.updateValue((run_id,), tuple(run))
            if self.rollup and run[2] and (closed or self.running and run_id in touched):
                out.append((run_id, host, part, run[2], run[3], run[4], run[5], closed, at))
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in ROLLUP_OUT.split(", ")])

    def close(self) -> None:
        pass


def _with_runs(samples: DataFrame, runs: DataFrame, delay: str, parts: int) -> DataFrame:
    """Samples and run rows as one stream with one watermark, keyed by (host, part)."""
    ts = F.col("ts").cast("timestamp")
    part = F.pmod(F.xxhash64("gpu_index", "ts"), F.lit(parts)).cast("int")
    empty = [F.lit(None).cast(t).alias(c) for c, t in (("run_id", "string"), ("start_ts", "timestamp"), ("end_ts", "timestamp"))]
    s = samples.select(F.col("host").cast("int"), part.alias("part"), ts.alias("ts"), F.col("gpu_index").cast("int"), F.col("used_bytes").cast("long"),
                       F.col("util_pct").cast("int"), F.col("power_mw").cast("long"), *empty)
    logged = F.col("logged_ts") if "logged_ts" in runs.columns else F.col("start_ts")
    r = runs.select(F.col("host").cast("int"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), logged.cast("timestamp").alias("ts"),
                    F.lit(0).alias("gpu_index"), F.lit(0).cast("long").alias("used_bytes"), F.lit(0).alias("util_pct"), F.lit(0).cast("long").alias("power_mw"),
                    F.col("run_id").cast("string").alias("run_id"), F.col("start_ts").cast("timestamp"), F.col("end_ts").cast("timestamp"))
    return s.unionByName(r).withWatermark("ts", delay).groupBy("host", "part")


def run_gate_stream(samples: DataFrame, runs: DataFrame, delay: str = "1 hour", bucket: str = "1 minute", parts: int = 1) -> DataFrame:
    """T4: samples inside a run (``start < ts <= end``; an open run has no end), each once per run.

    ``runs`` is a stream of (run_id, host, start_ts, end_ts[, logged_ts]): a run
    is logged when it starts, with its end or without (null); a later row of the
    same run_id sets the end.  ``logged_ts`` is the row's event time (default:
    the start).  Rows of either side may be ``delay`` late.  A hot host is
    split into ``parts`` states by a hash of the sample; run rows go to each.
    """
    state_settings(samples.sparkSession)
    width = int(pd.Timedelta(bucket).total_seconds() * 1e6)
    return _with_runs(samples, runs, delay, parts).transformWithStateInPandas(
        _Runs(width, rollup=False, running=False), SAMPLE_OUT, "Append", "EventTime")


def gpu_stream_rollup(samples: DataFrame, runs: DataFrame, delay: str = "1 hour", bucket: str = "1 minute", parts: int = 1,
                      running: bool = False) -> DataFrame:
    """T2 (+ T4): one row per run with samples, emitted when the watermark has passed the run's end, however long it was.

    Columns as in the batch report, with the mergeable sums; ``runs`` as in
    ``run_gate_stream``.  With ``parts`` over 1 a run has one row per part
    (``merged_runs`` adds them up).  With ``running`` every settled bucket also
    emits the sums so far of the runs it touched (``closed`` false), which is
    how an open run is seen; ``emitted_ts`` orders a run's rows.
    """
    state_settings(samples.sparkSession)
    width = int(pd.Timedelta(bucket).total_seconds() * 1e6)
    out = _with_runs(samples, runs, delay, parts).transformWithStateInPandas(
        _Runs(width, rollup=True, running=running), ROLLUP_OUT, "Append", "EventTime")
    return _derived(out)


def _derived(rows: DataFrame) -> DataFrame:
    return (rows.withColumn("max_mem", F.col("max_used_bytes") / F.lit(float(1024 ** 3)))
            .withColumn("avg_power", F.try_divide(F.col("power_mw_sum").cast("double"), F.col("n_samples") * F.lit(1000.0))))


def merged_runs(rows: DataFrame) -> DataFrame:
    """One row per closed run from the parts that a rollup has emitted (a batch step over its sink)."""
    return _derived(rows.where("closed").groupBy("run_id", "host").agg(
        F.sum("n_samples").alias("n_samples"), F.max("max_used_bytes").alias("max_used_bytes"), F.max("max_gpu").alias("max_gpu"),
        F.sum("power_mw_sum").alias("power_mw_sum")))


# ------------------------------------------------------------------ T3

SSE_OUT = ("request_id string, n_data long, n_bad_json long, n_content long, first_content_line long, "
           "first_chunk_line long, last_usage long, response_chars long, has_done boolean, ok boolean")
LINE_STATE = "is_data boolean, is_done boolean, valid boolean, content_chars long, usage long"


def sse_parse(lines: DataFrame) -> DataFrame:
    """T3 stateless part, one row per line: P1 (strip, ``data: `` prefix), P3 (valid JSON),
    P4 (non-empty ``choices[0].delta.content``), usage, [DONE] flag."""
    s = lines.withColumn("s", F.btrim(F.col("line"), F.lit(" \t\r\n")))
    is_data = F.coalesce(F.col("s").startswith("data: "), F.lit(False))
    d = s.withColumn("is_data", is_data).withColumn("payload", F.when(is_data, F.substring(F.col("s"), 7, 1 << 30)))
    v = F.try_parse_json(F.col("payload"))
    content = F.variant_get(v, "$.choices[0].delta.content", "string")
    has_choice = F.variant_get(v, "$.choices[0]", "variant").isNotNull()
    return d.select("request_id", F.col("line_no").cast("long"), "ts", "is_data",
                    F.coalesce(F.col("payload") == "[DONE]", F.lit(False)).alias("is_done"),
                    v.isNotNull().alias("valid"),
                    F.when(has_choice & (F.length(content) > 0), F.length(content)).cast("long").alias("content_chars"),
                    F.try_variant_get(v, "$.usage.completion_tokens", "bigint").alias("usage"))


def _fold(s: dict, line_no: int, is_data: bool, is_done: bool, valid: bool, chars, usage) -> None:
    """One line, in order, into a request's sums."""
    if is_done:
        s["done"] = True
    elif is_data:
        s["n_data"] += 1
        s["n_bad"] += not valid
        if valid and s["first_chunk"] is None:
            s["first_chunk"] = line_no
        if chars is not None:
            s["n_content"] += 1
            s["chars"] += chars
            if s["first_content"] is None:
                s["first_content"] = line_no
        if usage is not None:
            s["usage"] = usage


class _Lines(StatefulProcessor):
    """Lines of a request: folded up to the first gap (``sums``), the others waiting by line number."""

    NEW = {"next": 0, "done": False, "out": False, "n_data": 0, "n_bad": 0, "n_content": 0, "chars": 0,
           "first_content": None, "first_chunk": None, "usage": None, "timer": None}

    def __init__(self, timeout_ms: int):
        self.timeout = timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sums = handle.getValueState("sums", "state binary")
        self.waiting = handle.getMapState("waiting", "line_no long", LINE_STATE)

    def _row(self, key, s: dict) -> pd.DataFrame:
        s["out"] = True
        self.waiting.clear()
        return pd.DataFrame([(str(key[0]), s["n_data"], s["n_bad"], s["n_content"], s["first_content"], s["first_chunk"], s["usage"], s["chars"],
                              s["done"], s["n_content"] > 0)], columns=[c.split()[0] for c in SSE_OUT.split(", ")]).astype(
            {"first_content_line": "Int64", "first_chunk_line": "Int64", "last_usage": "Int64"})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        s = pickle.loads(bytes(self.sums.get()[0])) if self.sums.exists() else dict(self.NEW)
        early, last_ms = {}, None
        for pdf in rows:
            last = int(_micros(pdf["ts"]).max()) // 1000
            last_ms = last if last_ms is None else max(last_ms, last)
            if not s["out"]:
                for r in pdf.itertuples(index=False):
                    early[int(r.line_no)] = (bool(r.is_data), bool(r.is_done), bool(r.valid), None if pd.isna(r.content_chars) else int(r.content_chars),
                                             None if pd.isna(r.usage) else int(r.usage))
        out = None
        while not s["out"]:
            n = s["next"]
            if n in early:
                line = early.pop(n)
            elif self.waiting.containsKey((n,)):
                line = tuple(self.waiting.getValue((n,)))
                self.waiting.removeKey((n,))
            else:
                break
            _fold(s, n, *line)
            s["next"] = n + 1
            if s["done"]:
                out = self._row(key, s)
        if not s["out"]:
            for n, line in early.items():
                if n >= s["next"]:
                    self.waiting.updateValue((n,), line)
        # the timer moves with the last line
        expiry = max(last_ms + self.timeout, timerValues.getCurrentWatermarkInMs() + 1)
        if s["timer"] is None or expiry > s["timer"]:
            if s["timer"] is not None:
                self.handle.deleteTimer(s["timer"])
            self.handle.registerTimer(expiry)
            s["timer"] = expiry
        self.sums.update((pickle.dumps(s),))
        if out is not None:
            yield out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        s = pickle.loads(bytes(self.sums.get()[0])) if self.sums.exists() else None
        if s is not None and not s["out"]:
            # lines are missing: what has come counts, in order, up to [DONE]
            for n in sorted(k[0] for k in self.waiting.keys()):
                if not s["done"]:
                    _fold(s, n, *self.waiting.getValue((n,)))
            yield self._row(key, s)
        self.waiting.clear()
        self.sums.clear()

    def close(self) -> None:
        pass


def sse_stream(lines: DataFrame, timeout: str = "10 minutes", delay: str = "10 minutes") -> DataFrame:
    """Per-request SSE metrics from lines in any order, numbered from 0.

    A request is emitted when all its lines up to [DONE] have come, else
    ``timeout`` after its last line.  Its state then stays as a tombstone until
    that timer and swallows what still arrives.  A request without a data line
    is emitted too, with zero counts; ``ok`` is false without content (trap 2).
    """
    state_settings(lines.sparkSession)
    timeout_ms = int(pd.Timedelta(timeout).total_seconds() * 1000)
    return (sse_parse(lines).withColumn("request_id", F.col("request_id").cast("string")).withWatermark("ts", delay).groupBy("request_id")
            .transformWithStateInPandas(_Lines(timeout_ms), SSE_OUT, "Append", "EventTime"))
