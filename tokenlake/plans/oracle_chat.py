"""DuckDB oracle SQL for the chat / dialog queries."""

from __future__ import annotations

from tokenlake.functions.draws import duck_draw
from tokenlake.functions.split import duck_split_hash
from tokenlake.operators import chat

WS = "[ \\t\\n\\r\\f\\x0B]+"
S, E = chat.IM_START, chat.IM_END
NL = "chr(10)"


def words(e: str) -> str:
    return f"list_filter(regexp_split_to_array({e}, '{WS}'), lambda w: w <> '')"


def ntok(e: str) -> str:
    return f"len({words(e)})"


def ids(e: str) -> str:
    return f"list_transform({words(e)}, lambda w: CAST({duck_draw('tok', 'w')} % {chat.VOCAB_SIZE} AS INTEGER))"


PIECE = f"('{S}' || role || {NL} || content || '{E}' || {NL})"
D = "d AS (SELECT conv_id, turn, role, text AS content FROM conversations)"

SQL: dict[str, str] = {}

SQL["g13_chatml_render"] = f"""
WITH {D}
SELECT conv_id, count(*) AS n_turns, string_agg({PIECE}, '' ORDER BY turn) AS rendered
FROM d GROUP BY conv_id
"""

SQL["g14_chatml_template"] = f"""
WITH {D},
conv AS (SELECT conv_id,
                arg_max(CASE WHEN role = 'system' THEN content END, CASE WHEN role = 'system' THEN turn END) AS system,
                max(CASE WHEN role <> 'system' THEN turn END) AS last_turn
         FROM d GROUP BY conv_id),
m AS (SELECT d.*, turn = last_turn AS is_last FROM d JOIN conv USING (conv_id) WHERE role <> 'system'),
p AS (SELECT conv_id, turn,
             CASE WHEN role = 'user' THEN '{S}user' || {NL} || content || '{E}' || {NL}
                  WHEN role = 'assistant' THEN '{S}assistant' || {NL} || coalesce(content, '')
                       || CASE WHEN is_last THEN '' ELSE '{E}' || {NL} END
                  WHEN role = 'tool' THEN '{S}user' || {NL} || '{chat.TOOL_RESPONSE_OPEN}' || {NL} || content
                       || {NL} || '{chat.TOOL_RESPONSE_CLOSE}{E}' || {NL}
                  ELSE '' END
             || CASE WHEN is_last AND role <> 'assistant' THEN '{S}assistant' || {NL} ELSE '' END AS piece
      FROM m),
b AS (SELECT conv_id, count(*) AS n_turns, string_agg(piece, '' ORDER BY turn) AS rendered FROM p GROUP BY conv_id)
SELECT conv_id, coalesce(n_turns, 0) AS n_turns,
       '{S}system' || {NL} || coalesce(system, '{chat.DEFAULT_SYSTEM}') || '{E}' || {NL} || coalesce(rendered, '') AS rendered
FROM conv LEFT JOIN b USING (conv_id)
"""

SQL["g16_assistant_spans"] = f"""
WITH {D},
o AS (SELECT *, coalesce(sum(length({PIECE})) OVER (PARTITION BY conv_id ORDER BY turn
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM d)
SELECT conv_id, turn, CAST(off + length('{S}' || role || {NL}) AS BIGINT) AS span_start,
       CAST(off + length('{S}' || role || {NL}) + length(content) AS BIGINT) AS span_end
FROM o WHERE role = 'assistant'
"""

SPLIT = (f"CASE WHEN {duck_draw('split:42', 'conv_id')} / 4294967296.0 < {chat.TEST_FRACTION} "
         f"THEN 'test' ELSE 'train' END")

SQL["a13_length_stats"] = f"""
WITH {D},
L AS (SELECT conv_id, sum({ntok(PIECE)}) AS n_tokens FROM d GROUP BY conv_id),
L2 AS (SELECT *, {SPLIT} AS split FROM L)
SELECT split, count(*) AS n, CAST(max(n_tokens) AS BIGINT) AS max_len, avg(n_tokens) AS avg_len,
       count(CASE WHEN n_tokens >= {chat.MAX_TOKENS} THEN 1 END) AS n_over_limit,
       max(n_tokens) < {chat.MAX_TOKENS} AS gate_ok
FROM L2 GROUP BY split
"""

SQL["g17_completion_labels"] = f"""
WITH {D},
last AS (SELECT conv_id, max(turn) AS last_turn, arg_max(role, turn) AS last_role FROM d GROUP BY conv_id),
j AS (SELECT d.*, (turn = last_turn AND last_role = 'assistant') AS is_comp FROM d JOIN last USING (conv_id)),
per AS (SELECT conv_id, CASE WHEN NOT is_comp THEN {ntok(PIECE)} ELSE 0 END AS p_tok,
               CASE WHEN is_comp THEN {ids(f"content || '{E}'")} END AS c_ids FROM j),
g AS (SELECT conv_id, sum(p_tok) AS n_prompt_tokens, max(c_ids) AS c_ids FROM per GROUP BY conv_id)
SELECT conv_id, CAST(n_prompt_tokens AS BIGINT) AS n_prompt_tokens,
       CAST(len(coalesce(c_ids, [])) AS INTEGER) AS n_completion_tokens,
       CAST(n_prompt_tokens + len(coalesce(c_ids, [])) AS INTEGER) AS n_labels,
       CAST(coalesce(list_sum(c_ids), 0) AS BIGINT) AS completion_id_sum,
       (n_prompt_tokens >= 10 AND len(coalesce(c_ids, [])) > 0) AS mask_ok
FROM g
"""

SQL["g12_tool_pairs"] = f"""
WITH {D}
SELECT u.conv_id, u.turn,
       '{S}user' || {NL} || u.content || '{E}' || {NL} || '{S}assistant' || {NL} AS prompt,
       a.content || '{E}' AS completion
FROM d u JOIN d a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
WHERE u.role = 'user' AND a.role = 'assistant'
"""

SQL["o3_exact_split"] = f"""
SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY {duck_split_hash("exact-split:42", "doc_id")}, doc_id) <= floor({chat.TEST_FRACTION} * count(*) OVER ())
                    THEN 'test' ELSE 'train' END AS split
FROM documents
"""
