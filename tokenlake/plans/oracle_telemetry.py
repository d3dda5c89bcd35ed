"""DuckDB oracle SQL for the telemetry queries (independent formulation:
plain windows over whole partitions, no bucketing)."""

from __future__ import annotations

from tokenlake.operators.telemetry import PROMPT_TEMPLATE, REPORT_LINE
from tokenlake.sources.fixtures import GPU_SAMPLES_SQL, RUNS_SQL, BACKENDS, request_dims_sql

def div(num: str, den: str) -> str:
    return f"(CAST({num} AS DOUBLE) / NULLIF(CAST({den} AS DOUBLE), 0))"


def per_sec(cnt: str, dur_us: str) -> str:
    return f"(CAST({cnt} AS DOUBLE) * 1e6 / NULLIF(CAST({dur_us} AS DOUBLE), 0))"


REQUEST_BASE = f"""
ev AS (SELECT user_id AS request_id, event_id, ts, event_type AS text,
              row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rk
       FROM events),
b0 AS (SELECT request_id,
              min(CASE WHEN rk = 1 THEN ts END) AS start_ts,
              min(CASE WHEN rk = 2 THEN ts END) AS first_ts,
              min(CASE WHEN rk = 3 THEN ts END) AS second_ts,
              max(ts) AS end_ts, count(*) AS n_rows,
              min(CASE WHEN rk > 1 AND length(text) > 0 THEN ts END) AS content_ts,
              max(CASE WHEN rk > 1 AND length(text) > 0 THEN ts END) AS last_text_ts,
              count(CASE WHEN rk > 1 AND length(text) > 0 THEN 1 END) AS n_content,
              sum(length(text)) - max(CASE WHEN rk = 1 THEN length(text) END) AS response_chars
       FROM ev GROUP BY request_id),
base AS (SELECT request_id, {request_dims_sql('request_id')},
                start_ts, first_ts, second_ts, end_ts, n_rows - 1 AS n_tokens, response_chars,
                CASE WHEN request_id % 13 = 0 THEN 0 WHEN request_id % 11 = 0 THEN 1
                     ELSE n_rows - 1 END AS usage_tokens,
                epoch_us(first_ts) - epoch_us(start_ts) AS ttft_us,
                epoch_us(first_ts) - epoch_us(start_ts) AS ttft_any_us,
                epoch_us(content_ts) - epoch_us(start_ts) AS ttft_content_us,
                n_content, epoch_us(last_text_ts) - epoch_us(content_ts) AS gap_us,
                epoch_us(second_ts) - epoch_us(first_ts) AS second_us,
                epoch_us(end_ts) - epoch_us(start_ts) AS total_us,
                epoch_us(end_ts) - epoch_us(first_ts) AS decode_us
         FROM b0),
rb AS (SELECT *, (http_status = 200 AND n_content >= 1) AS ok FROM base)
"""

PROFILE = f"""
prof AS (
  SELECT request_id, backend, concurrency, http_status, ok, n_tokens, usage_tokens, ttft_us,
         ttft_us / 1e6 AS ttft_prompt_relative,
         ttft_content_us / 1e6 AS ttft_content,
         ttft_any_us / 1e6 AS ttft_any_chunk,
         second_us / 1e6 AS second_token_latency,
         CASE WHEN n_tokens - 1 > 0 THEN {per_sec('n_tokens - 1', 'decode_us')} END AS decode_tps_excl_first,
         CASE WHEN total_us - coalesce(ttft_content_us, 0) > 0
              THEN {per_sec('(CASE WHEN usage_tokens = 0 THEN 100 ELSE usage_tokens END) - 1',
                            'total_us - coalesce(ttft_content_us, 0)')}
              ELSE 0.0 END AS decode_tps_usage_minus1,
         {per_sec('''CASE WHEN usage_tokens = 0 THEN 100
                          WHEN usage_tokens = 1 THEN greatest(1, CAST(floor(response_chars / 4) AS BIGINT))
                          ELSE usage_tokens END''',
                  'CASE WHEN total_us - coalesce(ttft_content_us, 0) > 0 THEN total_us - coalesce(ttft_content_us, 0) ELSE 1000 END')}
           AS decode_tps_usage_full,
         {per_sec('n_tokens', 'total_us')} AS e2e_tps,
         total_us / 1e6 AS total_s
  FROM rb)
"""

GPU_RUN = f"""
gs AS ({GPU_SAMPLES_SQL}),
rn AS ({RUNS_SQL}),
j AS (SELECT r.run_id, s.* FROM gs s JOIN rn r
      ON s.host = r.host AND s.ts > r.start_ts AND s.ts <= r.end_ts),
a2 AS (SELECT run_id, host, count(*) AS n_samples,
              CAST(max(used_bytes) AS DOUBLE) / 1073741824.0 AS max_mem, max(util_pct) AS max_gpu,
              {div('sum(power_mw)', 'count(*) * 1000.0')} AS avg_power
       FROM j GROUP BY run_id, host),
a8 AS (SELECT host, count(*) AS n_runs, max(max_mem) AS max_mem, max(max_gpu) AS max_gpu,
              round(avg(avg_power), 9) AS avg_power FROM a2 GROUP BY host)
"""

HF = f"""
hf AS (
  SELECT q.backend, q.total_tokens, q.dur_us / 1e6 AS total_duration,
         coalesce({per_sec('q.total_tokens', 'q.dur_us')}, 0.0) AS tokens_per_second,
         coalesce({div('q.ttft_sum', 'q.n * 1e6')}, 0.0) AS avg_ttft,
         g.max_mem, g.max_gpu, g.avg_power
  FROM (SELECT backend, backend_idx, CAST(sum(n_tokens - 1) AS BIGINT) AS total_tokens, sum(decode_us) AS dur_us,
               sum(ttft_us) AS ttft_sum, count(*) AS n
        FROM rb WHERE backend_idx = 0 AND ok AND n_tokens - 1 > 0
        GROUP BY backend, backend_idx) q
  JOIN a8 g ON q.backend_idx = g.host)
"""

CLIENT = f"""
cl AS (
  SELECT q.backend, q.avg_ttft_sec, q.avg_decode_tokens_per_sec,
         coalesce(CAST(g.mx AS DOUBLE) / 1073741824.0, 0.0) AS peak_vram_gb,
         coalesce(g.max_gpu_compute_percent, 0) AS max_gpu_compute_percent,
         coalesce({div('g.pw', 'g.n * 1000.0')}, 0.0) AS avg_power_watts
  FROM (SELECT backend, coalesce({div('sum(ttft_content_us)', 'count(*) * 1e6')}, 0.0) AS avg_ttft_sec,
               coalesce(round(avg(CASE WHEN backend = 'SGLang' THEN decode_tps_usage_full
                                 WHEN backend = 'vLLM' THEN decode_tps_usage_minus1
                                 ELSE decode_tps_excl_first END), 9), 0.0) AS avg_decode_tokens_per_sec,
               CAST(list_position({BACKENDS!r}, backend) - 1 AS INTEGER) AS host
        FROM prof JOIN (SELECT request_id, ttft_content_us FROM rb) USING (request_id) WHERE ok GROUP BY backend) q
  LEFT JOIN (SELECT host, max(used_bytes) AS mx, max(util_pct) AS max_gpu_compute_percent,
                    sum(power_mw) AS pw, count(*) AS n
             FROM gs WHERE gpu_index = 0 GROUP BY host) g ON q.host = g.host)
"""

SQL: dict[str, str] = {}

SQL["a5_concurrency_summary"] = f"""
WITH {REQUEST_BASE}
SELECT concurrency,
       {div('sum(CASE WHEN ok THEN ttft_content_us END)', 'count(CASE WHEN ok THEN 1 END) * 1e6')} AS avg_ttft,
       {div('sum(CASE WHEN ok THEN gap_us END)', 'sum(CASE WHEN ok THEN n_content - 1 END) * 1e6')}
         AS avg_inter_token_latency,
       {div('count(*) - count(CASE WHEN ok THEN 1 END)', 'count(*)')} AS failure_rate,
       count(*) AS num_requests
FROM rb GROUP BY concurrency
"""

SQL["a1_request_profile"] = f"WITH {REQUEST_BASE}, {PROFILE} SELECT * FROM prof"

SQL["w2_first_second_token"] = """
SELECT request_id, CAST(rk - 1 AS BIGINT) AS token_idx,
       (['prompt', 'first', 'second'])[rk] AS phase, event_id, ts
FROM (SELECT user_id AS request_id, event_id, ts,
             row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rk FROM events)
WHERE rk <= 3
"""

SQL["w1_inter_token_gaps"] = """
SELECT request_id, token_idx, event_id, (epoch_us(ts) - epoch_us(prev_ts)) / 1e6 AS gap_s
FROM (SELECT user_id AS request_id, event_id, ts,
             CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS token_idx,
             lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev_ts
      FROM events)
WHERE token_idx >= 2
"""

SQL["a2_run_gpu_rollup"] = f"WITH {GPU_RUN} SELECT * FROM a2"

SQL["a2_runs_without_samples"] = f"""
WITH {GPU_RUN}
SELECT run_id, host, start_ts, end_ts FROM rn WHERE run_id NOT IN (SELECT run_id FROM j)
"""

SQL["a8_overall_rollup"] = f"WITH {GPU_RUN} SELECT * FROM a8"

SQL["a3_hf_run_summary"] = f"WITH {REQUEST_BASE}, {GPU_RUN}, {HF} SELECT * FROM hf"

SQL["a4_client_run_summary"] = f"WITH {REQUEST_BASE}, {PROFILE}, gs AS ({GPU_SAMPLES_SQL}), {CLIENT} SELECT * FROM cl"

SQL["a16_backend_comparison"] = f"""
WITH {REQUEST_BASE}, {PROFILE}, {GPU_RUN}, {HF}, {CLIENT},
u AS (SELECT backend, avg_ttft AS ttft, tokens_per_second AS tps, max_mem AS vram,
             CAST(max_gpu AS DOUBLE) AS gpu FROM hf
      UNION ALL
      SELECT backend, avg_ttft_sec, avg_decode_tokens_per_sec, peak_vram_gb,
             CAST(max_gpu_compute_percent AS DOUBLE) FROM cl WHERE backend <> '{BACKENDS[0]}')
SELECT backend, CAST(list_position({BACKENDS!r}, backend) AS INTEGER) AS report_pos,
       coalesce(ttft, 0.0) AS ttft, coalesce(tps, 0.0) AS tps, coalesce(vram, 0.0) AS vram,
       coalesce(gpu, 0.0) AS gpu
FROM u ORDER BY report_pos
"""

SQL["a6_batch_throughput"] = f"""
WITH {REQUEST_BASE}
SELECT backend, CAST(sum(usage_tokens) AS BIGINT) AS total_tokens,
       (epoch_us(max(end_ts)) - epoch_us(min(start_ts))) / 1e6 AS batch_duration,
       {div('sum(total_us)', 'count(*) * 1e6')} AS avg_latency,
       {per_sec('sum(usage_tokens)', 'epoch_us(max(end_ts)) - epoch_us(min(start_ts))')} AS throughput
FROM rb GROUP BY backend
"""

SQL["a7_wall_clock"] = f"""
WITH {REQUEST_BASE}
SELECT concurrency, count(*) AS n_clients,
       (epoch_us(max(end_ts)) - epoch_us(min(start_ts))) / 1e6 AS wall_s,
       max(total_us) / 1e6 AS max_latency_s,
       {div('sum(total_us)', 'count(*) * 1e6')} AS avg_latency_s
FROM rb GROUP BY concurrency
"""

SQL["a14_runner_throughput"] = f"""
WITH {REQUEST_BASE}
SELECT request_id, n_tokens + 1 AS seq_len, 1 AS input_len,
       {per_sec('n_tokens + 1', 'total_us')} AS runner_total_tps,
       {per_sec('n_tokens', 'total_us')} AS runner_decode_tps
FROM rb
"""

SQL["w10_prefix_cold_hot"] = f"""
WITH {REQUEST_BASE},
p AS (SELECT *, 'token system prompt prefix #' || CAST(request_id % 7 AS VARCHAR) AS system_prompt
      FROM rb WHERE n_tokens >= 1),
l AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY sha256(system_prompt)
                                             ORDER BY start_ts, request_id) = 1
                     THEN 'RUN 1 - COLD' ELSE 'RUN 2 - HOT' END AS run_label FROM p)
SELECT system_prompt, run_label, count(*) AS n,
       {div('sum(ttft_any_us)', 'count(*) * 1e6')} AS avg_ttft,
       {div('sum(total_us)', 'count(*) * 1e6')} AS avg_roundtrip
FROM l GROUP BY system_prompt, run_label
"""

SQL["t5_live_gpu_view"] = f"""
WITH gs AS ({GPU_SAMPLES_SQL})
SELECT host, gpu_index, l.ts AS ts, CAST(l.used_bytes AS DOUBLE) / 1073741824.0 AS used_gib, l.util_pct AS util_pct,
       l.temp_c AS temp_c, CAST(l.power_mw AS DOUBLE) / 1000.0 AS power_w
FROM (SELECT host, gpu_index,
             arg_max({{'ts': ts, 'used_bytes': used_bytes, 'util_pct': util_pct, 'temp_c': temp_c,
                       'power_mw': power_mw}},
                     {{'ts': ts, 'used_bytes': used_bytes, 'util_pct': util_pct, 'power_mw': power_mw}}) AS l
      FROM gs GROUP BY host, gpu_index)
"""

MEMLOG = """
m AS (SELECT user_id AS run, event_id, ts, event_type AS tag,
             CAST(round(value * 16.0) AS BIGINT) AS mem_mib FROM events)
"""

SQL["w5_running_peak"] = f"""
WITH {MEMLOG}
SELECT run, CAST(row_number() OVER w - 1 AS BIGINT) AS step, tag, mem_mib,
       max(mem_mib) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running_peak_mib
FROM m WINDOW w AS (PARTITION BY run ORDER BY ts, event_id)
"""

SQL["a17_vram_high_water"] = f"""
WITH {MEMLOG}
SELECT run, tag, max(mem_mib) AS peak_mib, count(*) AS n_points FROM m GROUP BY run, tag
"""

SQL["s11_gpu_csv_scan"] = f"""
WITH gs AS ({GPU_SAMPLES_SQL}),
ln AS (SELECT host, gpu_index,
              CAST(floor(used_bytes / 1048576) AS BIGINT) AS used_mib,
              CAST(floor(total_bytes / 1048576) AS BIGINT) AS total_mib FROM gs)
SELECT host, gpu_index, max(used_mib) AS peak_used_mib, max(total_mib) AS total_mib,
       count(*) AS n_lines
FROM ln GROUP BY host, gpu_index
"""

SQL["a15_warm_mean_latency"] = """
SELECT batch, count(*) AS n_timed,
       CAST(sum(CAST(round(l_quantity * 100) AS BIGINT)) AS DOUBLE) / NULLIF(count(*) * 100.0, 0) AS mean_latency
FROM (SELECT l_suppkey AS batch, l_quantity,
             row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_quantity) AS iteration
      FROM lineitem)
WHERE iteration > 10 AND iteration <= 20
GROUP BY batch
"""

SQL["s14_prompt_table"] = f"""
WITH {GPU_RUN}
SELECT CASE WHEN length(s) < 28 THEN s ELSE substr(s, 1, 25) || '...' END AS prompt_summary,
       run_id, max_mem, max_gpu, avg_power
FROM (SELECT 'run ' || run_id || ' on host ' || CAST(host AS VARCHAR) AS s, * FROM a2)
"""

SQL["s14_backend_report_text"] = (
    "SELECT report_pos, printf('" + REPORT_LINE + "', backend, ttft, tps, vram, gpu) AS line FROM ("
    + SQL["a16_backend_comparison"].replace("FROM u ORDER BY report_pos", "FROM u") + ") c ORDER BY report_pos")

_TPL = PROMPT_TEMPLATE.replace("'", "''")
SQL["j7_client_prompt_pair"] = f"""
WITH {REQUEST_BASE},
p AS (SELECT item_id AS prompt_idx, replace('{_TPL}', '{{input_text}}', text) AS prompt FROM benchmark)
SELECT request_id AS client_id, prompt_idx, ok,
       CAST(len(list_filter(regexp_split_to_array(prompt, '[ \\t\\n\\r\\f\\x0B]+'), lambda w: w <> '')) AS INTEGER) AS prompt_words,
       CAST(length(prompt) AS INTEGER) AS prompt_chars, total_us / 1e6 AS latency_s, ttft_us / 1e6 AS ttft_s
FROM rb JOIN p ON rb.request_id = p.prompt_idx
"""
