"""Registry of the named queries and their DuckDB oracles.

``QUERIES[name](spark, sf_dir) -> DataFrame``; ``ORACLE[name]`` is SQL over
the pre-registered table views.  Names without an oracle are checked by
row count and invariants (tests) only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tokenlake.operators import chat
from tokenlake.operators import evaluate as evl
from tokenlake.operators import invoices as inv
from tokenlake.operators import sse, tokens
from tokenlake.operators import sqlshapes
from tokenlake.operators import telemetry as tel
from tokenlake.plans import oracle_chat, oracle_invoices, oracle_telemetry, oracle_tokens

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {
    # family I: telemetry
    "a5_concurrency_summary": tel.concurrency_summary,
    "a1_request_profile": tel.request_profile,
    "w2_first_second_token": tel.first_second_token,
    "w1_inter_token_gaps": tel.inter_token_gaps,
    "a2_run_gpu_rollup": tel.run_gpu_rollup,
    "a2_runs_without_samples": tel.runs_without_samples,
    "a8_overall_rollup": tel.overall_rollup,
    "a3_hf_run_summary": tel.hf_run_summary,
    "a4_client_run_summary": tel.client_run_summary,
    "a16_backend_comparison": tel.backend_comparison,
    "a6_batch_throughput": tel.batch_throughput,
    "a7_wall_clock": tel.wall_clock,
    "a14_runner_throughput": tel.runner_throughput,
    "w10_prefix_cold_hot": tel.prefix_cold_hot,
    "t5_live_gpu_view": tel.live_gpu_view,
    "w5_running_peak": tel.running_peak,
    "a17_vram_high_water": tel.vram_high_water,
    "s11_gpu_csv_scan": tel.gpu_csv_scan,
    "a15_warm_mean_latency": tel.warm_mean_latency,
    "s14_prompt_table": tel.prompt_table,
    "s14_backend_report_text": tel.backend_report_text,
    "j7_client_prompt_pair": tel.client_prompt_pair,
    # family II: invoice corpus
    "g1_invoice_truth": inv.invoice_truth_query,
    "g2_invoice_render": inv.invoice_render,
    "g7_case_examples": inv.case_examples,
    "p9_label_valid": inv.label_valid,
    "a9_case_counts": inv.case_counts,
    "g11_prompt_completion": inv.prompt_completion,
    "v1_sft_contract": inv.sft_contract,
    "v2_arith_invariant": inv.arith_invariant,
    "o1_dataset_shuffle": inv.dataset_shuffle,
    "g8_hard_case": inv.hard_case,
    "g5_label_case_jitter": inv.label_case_jitter,
    # family III: evaluation
    "a10_eval_case_report": evl.eval_case_report,
    "a11_eval_field_report": evl.eval_field_report,
    "w6_first_failures": evl.first_failures,
    "w6_failure_details": evl.failure_details,
    "j2_prediction_join": evl.prediction_join_report,
    "a12_json_exact_rate": evl.json_exact_rate,
    "u1_rule_predictor": evl.rule_predictor_report,
    # chat formatting on dialogs
    "g13_chatml_render": chat.chatml_render,
    "g14_chatml_template": chat.chatml_template,
    "g16_assistant_spans": chat.assistant_spans,
    "a13_length_stats": chat.length_stats,
    "o3_exact_split": chat.exact_test_split,
    "g17_completion_labels": chat.completion_labels,
    "g12_tool_pairs": chat.tool_pairs,
    # stream lines and token arrays
    "s1_sse_profile": sse.sse_profile,
    "s6_token_csv_scan": tokens.token_csv_scan,
    "s7_token_matrix_scan": tokens.token_matrix_scan,
    "g21_virtual_prefix": tokens.virtual_prefix,
    "g22_g23_request_ids": tokens.request_ids,
    "g20_generation_flatten": tokens.generation_flatten,
    "j3_positional_zip": tokens.positional_zip,
    "j3_line_pairs": tokens.line_pairs,
    "p8_nonblank_lines": tokens.nonblank_lines,
    "w7_stop_cut": tokens.stop_cut,
}
# SQL shapes carried as data
QUERIES.update(sqlshapes.QUERIES)

ORACLE: dict[str, str] = {}
ORACLE.update(oracle_telemetry.SQL)
ORACLE.update(oracle_invoices.SQL)
ORACLE.update(sqlshapes.SQL)
ORACLE.update(oracle_chat.SQL)
ORACLE.update(oracle_tokens.SQL)


def queries() -> dict[str, QueryFn]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in ORACLE.items() if k in QUERIES}
