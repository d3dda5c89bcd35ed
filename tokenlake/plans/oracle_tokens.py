"""DuckDB oracle SQL for SSE stream parsing and token-array queries."""

from __future__ import annotations

from tokenlake.functions.draws import duck_draw
from tokenlake.operators import sse, tokens
from tokenlake.operators.chat import VOCAB_SIZE

WS = "[ \\t\\n\\r\\f\\x0B]+"


def words(e: str) -> str:
    return f"list_filter(regexp_split_to_array({e}, '{WS}'), lambda w: w <> '')"


def ids(e: str) -> str:
    return f"list_transform({words(e)}, lambda w: CAST({duck_draw('tok', 'w')} % {VOCAB_SIZE} AS INTEGER))"


def chunk(x: str) -> str:
    return f"('{sse.PREFIX}' || CAST(to_json({{'choices': [{{'index': 0, 'delta': {{'content': {x}}}}}]}}) AS VARCHAR))"


def usage(n: str) -> str:
    return f"('{sse.PREFIX}' || '{{\"choices\":[],\"usage\":{{\"completion_tokens\":' || CAST({n} AS VARCHAR) || '}}}}')"


ROLE_LINE = sse.PREFIX + '{"choices":[{"index":0,"delta":{"role":"assistant"}}]}'
BROKEN = sse.PREFIX + '{"choices": ['

LINES = f"""
c AS (SELECT conv_id || ':' || turn AS request_id, {words('text')} AS w FROM conversations WHERE role = 'assistant'),
ll AS (SELECT request_id, list_concat(
          ['{ROLE_LINE}'],
          list_filter(flatten(list_transform(w, lambda x, i: [
              {chunk('x')} || CASE WHEN i % 3 = 0 THEN chr(13) ELSE '' END,
              CASE WHEN i % 5 = 0 THEN '' END,
              CASE WHEN i % 7 = 0 THEN '{BROKEN}' END,
              CASE WHEN i % 11 = 0 THEN ': keep-alive' END])), lambda x: x IS NOT NULL),
          [{usage('len(w) - 1')}, {usage('len(w)')}, '{sse.PREFIX}{sse.DONE}', {chunk("'IGNORED'")}]) AS lines
       FROM c),
lines AS (SELECT request_id, CAST(unnest(generate_series(0, len(lines) - 1)) AS INTEGER) AS line_no,
                 unnest(lines) AS line FROM ll),
s AS (SELECT *, trim(line, ' ' || chr(9) || chr(13) || chr(10)) AS st FROM lines),
d0 AS (SELECT request_id, line_no, substr(st, {len(sse.PREFIX) + 1}) AS payload FROM s
       WHERE length(st) > 0 AND starts_with(st, '{sse.PREFIX}')),
dn AS (SELECT request_id, min(line_no) AS done_line FROM d0 WHERE payload = '{sse.DONE}' GROUP BY request_id),
d AS (SELECT d0.*, dn.done_line FROM d0 LEFT JOIN dn USING (request_id)
      WHERE dn.done_line IS NULL OR line_no < dn.done_line),
p AS (SELECT request_id, line_no, done_line, json_valid(payload) AS valid,
             CASE WHEN json_valid(payload) AND json_extract(payload, '$.choices[0]') IS NOT NULL
                       AND length(json_extract_string(payload, '$.choices[0].delta.content')) > 0
                  THEN json_extract_string(payload, '$.choices[0].delta.content') END AS content,
             CASE WHEN json_valid(payload) THEN TRY_CAST(json_extract(payload, '$.usage.completion_tokens') AS BIGINT) END AS usage
      FROM d)
"""

SQL: dict[str, str] = {}

SQL["s1_sse_profile"] = f"""
WITH {LINES},
tot AS (SELECT request_id, count(*) AS n_lines FROM lines GROUP BY request_id),
g AS (SELECT request_id, count(*) AS n_data, count(CASE WHEN NOT valid THEN 1 END) AS n_bad_json,
             count(content) AS n_content,
             min(CASE WHEN content IS NOT NULL THEN line_no END) AS first_content_line,
             min(CASE WHEN valid THEN line_no END) AS first_chunk_line,
             arg_max(usage, CASE WHEN usage IS NOT NULL THEN line_no END) AS last_usage,
             sum(length(content)) AS response_chars
      FROM p GROUP BY request_id),
h AS (SELECT tot.request_id, tot.n_lines, coalesce(n_data, 0) AS n_data, coalesce(n_bad_json, 0) AS n_bad_json,
             coalesce(n_content, 0) AS n_content, dn.done_line IS NOT NULL AS has_done,
             first_content_line, first_chunk_line, last_usage, response_chars,
             greatest(1, CAST(floor(coalesce(response_chars, 0) / 4) AS BIGINT)) AS est
      FROM tot LEFT JOIN g USING (request_id) LEFT JOIN dn USING (request_id))
SELECT request_id, n_lines, n_data, n_bad_json, n_content, has_done, n_content > 0 AS ok,
       first_content_line * {sse.LINE_MS} AS ttft_content_ms,
       first_chunk_line * {sse.LINE_MS} AS ttft_any_chunk_ms,
       last_usage, CAST(coalesce(response_chars, 0) AS BIGINT) AS response_chars, est AS est_tokens,
       CASE WHEN coalesce(last_usage, n_content) = 0 THEN 100
            WHEN coalesce(last_usage, n_content) = 1 THEN est
            ELSE coalesce(last_usage, n_content) END AS sglang_tokens
FROM h
"""

DOCS = f"docs AS (SELECT doc_id, text, lang, {ids('text')} AS ids FROM documents)"


def tail(a: str, n: int) -> str:
    return f"list_slice({a}, greatest(len({a}) - {n} + 1, 1), greatest(len({a}) - {n} + 1, 1) + {n} - 1)"


def padded(a: str) -> str:
    return f"list_concat({a}, list_transform(range(0, greatest(1, (len({a}) + {tokens.PAD_TO} - 1) // {tokens.PAD_TO}) * {tokens.PAD_TO} - len({a})), lambda x: {tokens.PAD_ID}))"


SQL["s6_token_csv_scan"] = f"""
WITH {DOCS},
t AS (SELECT doc_id, ids FROM docs),
t2 AS (SELECT doc_id, ids, {tail('ids', tokens.MAX_INPUT_LEN)} AS tl FROM t)
SELECT doc_id, CAST(len(ids) AS INTEGER) AS n_ids, CAST(coalesce(list_sum(ids), 0) AS BIGINT) AS id_sum, CAST(len(tl) AS INTEGER) AS tail_len,
       array_to_string(tl, ',') AS tail FROM t2
"""

SQL["s7_token_matrix_scan"] = f"""
WITH {DOCS},
t AS (SELECT doc_id, {padded('ids')} AS row FROM docs),
t2 AS (SELECT doc_id, len(row) AS row_len, list_filter(row, lambda x: x <> {tokens.PAD_ID}) AS kept FROM t)
SELECT doc_id, CAST(row_len AS INTEGER) AS row_len, CAST(len(kept) AS INTEGER) AS n_kept, CAST(coalesce(list_sum(kept), 0) AS BIGINT) AS id_sum, array_to_string({tail('kept', tokens.MAX_INPUT_LEN)}, ',') AS tail FROM t2
"""

SQL["g21_virtual_prefix"] = f"""
WITH {DOCS},
t AS (SELECT doc_id, CAST(doc_id % 5 AS INTEGER) AS p, ids FROM docs),
t2 AS (SELECT doc_id, p, list_concat(CASE WHEN p > 0 THEN CAST(range({VOCAB_SIZE}, {VOCAB_SIZE} + p) AS INTEGER[])
                                          ELSE CAST([] AS INTEGER[]) END, ids) AS ids FROM t)
SELECT doc_id, p AS n_prefix, CAST(len(ids) AS INTEGER) AS n_ids, ids[1] AS first_id,
       CAST(coalesce(list_sum(ids), 0) AS BIGINT) AS id_sum FROM t2
"""

SQL["g22_g23_request_ids"] = f"""
WITH {DOCS},
t AS (SELECT doc_id, CASE WHEN lang = 'en' THEN list_append(ids, {tokens.SOP_ID}) ELSE ids END AS ids2,
             CASE WHEN doc_id % 3 = 0 THEN ids[-1:] END AS own FROM docs)
SELECT doc_id, CAST(len(ids2) AS INTEGER) AS n_ids, ids2[-1] AS last_id,
       array_to_string(list_concat(coalesce(own, CAST([] AS INTEGER[])), [{tokens.END_ID}]), ',') AS stop_ids FROM t
"""

SQL["g20_generation_flatten"] = f"""
WITH {DOCS},
t AS (SELECT doc_id, CAST(doc_id % 8 AS INTEGER) AS input_len, {padded('ids')} AS row FROM docs),
b AS (SELECT doc_id, input_len, 0 AS beam, row[1:len(row) // 2] AS out FROM t
      UNION ALL
      SELECT doc_id, input_len, 1 AS beam, row[len(row) // 2 + 1:len(row)] AS out FROM t),
b2 AS (SELECT *, len(list_filter(out, lambda x: x <> {tokens.PAD_ID})) AS seq_len FROM b),
b3 AS (SELECT *, CASE WHEN seq_len > input_len THEN out[input_len + 1:seq_len] ELSE CAST([] AS INTEGER[]) END AS new FROM b2)
SELECT doc_id, CAST(beam AS INTEGER) AS beam, input_len, CAST(seq_len AS INTEGER) AS seq_len,
       (doc_id * 2 + beam) // 2 AS batch_idx,
       (doc_id * 2 + beam) % 2 AS beam_of_batch, CAST(len(new) AS INTEGER) AS n_new,
       CAST(coalesce(list_sum(new), 0) AS BIGINT) AS new_sum FROM b3
"""

SQL["j3_positional_zip"] = f"""
WITH {DOCS},
i AS (SELECT doc_id AS seq_id, ids[1:CAST(doc_id % 8 AS INTEGER)] AS inp FROM docs),
o AS (SELECT doc_id AS seq_id, ids AS out FROM docs),
j AS (SELECT seq_id, inp, out, CASE WHEN len(out) > len(inp) THEN out[len(inp) + 1:] ELSE CAST([] AS INTEGER[]) END AS gen
      FROM i JOIN o USING (seq_id))
SELECT seq_id, CAST(len(inp) AS INTEGER) AS n_input, CAST(len(gen) AS INTEGER) AS n_generated,
       gen[1] AS first_generated FROM j
"""

SQL["j3_line_pairs"] = f"""
SELECT row_number() OVER (ORDER BY seq_id) - 1 AS line_id, n_input, n_generated, first_generated FROM ({SQL["j3_positional_zip"]}) pairs
"""

SQL["p8_nonblank_lines"] = r"""
SELECT doc_id, CAST(len(string_split(text, chr(10))) AS INTEGER) AS n_lines,
       CAST(len(list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^ \t\n\r\f\x0B]'))) AS INTEGER) AS n_nonblank
FROM documents
"""

SQL["w7_stop_cut"] = f"""
WITH d AS (SELECT doc_id, {words('text')} AS w FROM documents),
h AS (SELECT doc_id, w, len(w) AS n,
             CASE WHEN len(w) >= 2 THEN list_position(list_transform(range(2, len(w) + 1),
                  lambda i: contains(lower(w[i - 1] || w[i]), '{tokens.STOP_WORD}')), true) END AS pos FROM d),
k AS (SELECT doc_id, w, n, CASE WHEN pos > 0 THEN pos + 1 END AS stop_pos FROM h)
SELECT doc_id, CAST(n AS INTEGER) AS n_words, CAST(stop_pos AS BIGINT) AS stop_pos,
       CASE WHEN stop_pos IS NOT NULL THEN stop_pos - 1 ELSE greatest(n - 1, 0) END AS n_kept,
       CASE WHEN (CASE WHEN stop_pos IS NOT NULL THEN stop_pos - 1 ELSE greatest(n - 1, 0) END) > 0
            THEN w[(CASE WHEN stop_pos IS NOT NULL THEN stop_pos - 1 ELSE greatest(n - 1, 0) END) + 1] END AS last_kept
FROM k
"""
