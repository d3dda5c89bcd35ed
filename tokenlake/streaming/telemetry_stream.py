"""Structured Streaming twins of the telemetry operators.

T1 token_state_machine  per-request keyed state (applyInPandasWithState):
                        the three earliest rows (prompt, first, second
                        token), last time and count; emitted at the end row
                        or, as fallback, on event-time timeout.
T2, T3, T4              see run_state: state by run and by line, with timers.
T5 live_gpu_view        latest sample per (host, gpu), update mode.

The reference has no event-time semantics at all; the watermarks here exist
only so that state is evicted.  ``ts`` arrives as TIMESTAMP_NTZ from
Parquet; it is cast to TIMESTAMP (session time zone UTC) because
``withWatermark`` rejects NTZ.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tokenlake.streaming.run_state import gpu_stream_rollup, merged_runs, run_gate_stream, sse_parse, sse_stream

US = 1_000_000.0

TOKEN_STATE_SCHEMA = ("t1 long, e1 long, t2 long, e2 long, t3 long, e3 long, "
                      "last_us long, n long, ended boolean")
TOKEN_OUT_SCHEMA = ("request_id long, n_tokens long, ttft_s double, second_token_latency_s double, "
                    "decode_tps_excl_first double, ended_by string")


def _timeout_ms(state: GroupState, last_us, gap_ms: int) -> int:
    """Event-time timeout: ``gap`` after the key's last event, never behind
    the current watermark (Spark rejects that)."""
    wm = state.getCurrentWatermarkMs()
    t = int(last_us // 1000) + gap_ms if last_us is not None else wm + gap_ms
    return max(t, wm + 1)


def _insert_top3(top, t, e):
    top = [x for x in top if x[0] is not None] + [(t, e)]
    top.sort()
    top = top[:3]
    while len(top) < 3:
        top.append((None, None))
    return top


def _token_metrics(rid, top, last_us, n, how):
    (t1, _), (t2, _), (t3, _) = top
    n_tokens = n - 1
    ttft = (t2 - t1) / US if t2 is not None else None
    second = (t3 - t2) / US if t3 is not None and t2 is not None else None
    hf_tokens = n_tokens - 1
    rate = None
    if hf_tokens > 0 and t2 is not None and last_us - t2 > 0:
        rate = hf_tokens * US / (last_us - t2)
    return {"request_id": rid, "n_tokens": n_tokens, "ttft_s": ttft,
            "second_token_latency_s": second, "decode_tps_excl_first": rate, "ended_by": how}


def token_state_machine(events: DataFrame, timeout: str = "10 minutes",
                        delay: str = "10 minutes", grace: str | None = None) -> DataFrame:
    """T1 (+ U5): ``events`` has request_id, event_id, ts (TIMESTAMP) and
    is_end (the [DONE]-style end row, which is not a token).

    A request is emitted once: at its end row, after which its state stays as
    a tombstone until the timeout and swallows what still arrives; or, with
    ``grace``, that long after its last event, so that tokens which arrive
    after the end row still count."""
    gap_ms = int(pd.Timedelta(timeout).total_seconds() * 1000)
    grace_ms = None if grace is None else int(pd.Timedelta(grace).total_seconds() * 1000)

    def step(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rid = int(key[0])
        if state.hasTimedOut:
            s = state.get
            top = [(s[0], s[1]), (s[2], s[3]), (s[4], s[5])]
            state.remove()
            if not s[8] or grace_ms is not None:
                yield pd.DataFrame([_token_metrics(rid, top, s[6], s[7], "end" if s[8] else "timeout")])
            return
        if state.exists:
            s = state.get
            if s[8] and grace_ms is None:      # emitted: a tombstone
                state.setTimeoutTimestamp(_timeout_ms(state, s[6], gap_ms))
                return
            top = [(s[0], s[1]), (s[2], s[3]), (s[4], s[5])]
            last_us, n, ended = s[6], s[7], s[8]
        else:
            top, last_us, n, ended = [(None, None)] * 3, None, 0, False
        for pdf in pdfs:                       # Arrow-sized chunks of one request
            end = pdf["is_end"].astype(bool)
            tok = pd.DataFrame({"t": pdf.loc[~end, "ts"].values.astype("datetime64[us]").astype("int64"),
                                "e": pdf.loc[~end, "event_id"].astype("int64").values})
            if len(tok):
                for t, e in tok.nsmallest(3, ["t", "e"]).itertuples(index=False):
                    top = _insert_top3(top, int(t), int(e))
                m = int(tok["t"].max())
                last_us = m if last_us is None else max(last_us, m)
                n += len(tok)
            ended = ended or bool(end.any())
        state.update((top[0][0], top[0][1], top[1][0], top[1][1], top[2][0], top[2][1], last_us, n, ended))
        state.setTimeoutTimestamp(_timeout_ms(state, last_us, grace_ms if ended and grace_ms is not None else gap_ms))
        if ended and grace_ms is None:
            yield pd.DataFrame([_token_metrics(rid, top, last_us, n, "end")])

    return (events.withWatermark("ts", delay)
            .groupBy("request_id")
            .applyInPandasWithState(step, TOKEN_OUT_SCHEMA, TOKEN_STATE_SCHEMA, "append",
                                    GroupStateTimeout.EventTimeTimeout))


def live_gpu_view(samples: DataFrame) -> DataFrame:
    """T5: latest sample per device (update mode; max_by is a partial
    aggregate, so a hot device does not concentrate rows)."""
    latest = F.max_by(F.struct("ts", "used_bytes", "util_pct", "temp_c", "power_mw"),
                      F.struct("ts", "used_bytes", "util_pct", "power_mw"))
    g = samples.groupBy("host", "gpu_index").agg(latest.alias("l"))
    return g.select("host", "gpu_index", F.col("l.ts").alias("ts"),
                    (F.col("l.used_bytes") / F.lit(float(1024 ** 3))).alias("used_gib"),
                    F.col("l.util_pct").alias("util_pct"), F.col("l.temp_c").alias("temp_c"),
                    (F.col("l.power_mw") / F.lit(1000.0)).alias("power_w"))


def with_event_time(df: DataFrame, col: str = "ts") -> DataFrame:
    """NTZ -> TIMESTAMP (UTC session) so the column can carry a watermark."""
    return df.withColumn(col, F.col(col).cast("timestamp"))


__all__ = ["token_state_machine", "gpu_stream_rollup", "run_gate_stream", "merged_runs", "live_gpu_view", "sse_parse", "sse_stream",
           "with_event_time"]
