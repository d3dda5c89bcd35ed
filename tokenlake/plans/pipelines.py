"""End-to-end jobs that write their outputs (the reference's scripts as
Spark jobs).  Each reads the input tables, runs the operators and writes
every report with Spark's writers; nothing passes through the driver."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tokenlake.operators import chat, evaluate as ev, invoices as inv, telemetry as tel
from tokenlake.session import materialize
from tokenlake.sources import files


def run_evaluation(spark: SparkSession, sf_dir: str, out_dir: str, predictions=None) -> dict[str, str]:
    """SURVEY 3.3: predictions -> parse -> compare, persisted once, then the
    case report (A10), the field report (A11) and the first failures (W6)
    from the same compared rows."""
    sc = materialize(ev.scored(spark, sf_dir, predictions), "eval_scored")
    outs = {name: os.path.join(out_dir, name) for name in ("case_report", "field_report", "failures")}
    ev.case_report(sc).write.mode("overwrite").parquet(outs["case_report"])
    ev.field_report(sc).write.mode("overwrite").parquet(outs["field_report"])
    ev.failure_rows(sc).write.mode("overwrite").parquet(outs["failures"])
    return outs


def run_corpus(spark: SparkSession, sf_dir: str, out_dir: str) -> dict[str, str]:
    """SURVEY 3.2: examples -> split -> chat rows -> JSONL per split, plus the
    count check (A9), the arithmetic invariant (V2) and the length gate
    (G19) written next to it."""
    outs = {"corpus": os.path.join(out_dir, "corpus")}
    files.jsonl_sink(inv.chat_rows(spark, sf_dir), outs["corpus"])
    outs["case_counts"] = os.path.join(out_dir, "case_counts")
    inv.case_counts(spark, sf_dir).write.mode("overwrite").parquet(outs["case_counts"])
    outs["arith"] = os.path.join(out_dir, "arith_invariant")
    inv.arith_invariant(spark, sf_dir).write.mode("overwrite").parquet(outs["arith"])
    return outs


def run_backend_comparison(spark: SparkSession, sf_dir: str, out_dir: str) -> dict[str, str]:
    """SURVEY 3.1: per-backend reports written as JSON files (S5), read back
    (S2), normalised and ordered (P10, O2), written as the comparison."""
    paths = {}
    hf = tel.hf_run_summary(spark, sf_dir)
    cl = tel.client_run_summary(spark, sf_dir)
    for b in ("Hugging Face", "vLLM", "SGLang"):
        p = os.path.join(out_dir, f"{b.replace(' ', '_').lower()}_res.json")
        files.report_sink(hf if b == "Hugging Face" else cl.filter(F.col("backend") == b), p)
        paths[b] = p
    cmp = files.normalized_reports(files.report_scan(spark, paths), ["Hugging Face", "vLLM", "SGLang"])
    out = os.path.join(out_dir, "comparison")
    cmp.write.mode("overwrite").parquet(out)
    return {"comparison": out, **paths}


def run_chat_lengths(spark: SparkSession, sf_dir: str, out_dir: str) -> str:
    out = os.path.join(out_dir, "length_stats")
    chat.length_stats(spark, sf_dir).write.mode("overwrite").parquet(out)
    return out
