"""DuckDB twins of the queries that SQL can express, written from their definitions."""

from __future__ import annotations

from tokenlake.llm import rules

WORD = r"'[^\x20\x09-\x0D]+'"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

SQL: dict[str, str] = {}


def closure(nodes: str, links: str) -> str:
    """``comp (id, component)``: smallest node reachable over ``links (a, b)``, both directions given."""
    return f"""reach(id, other) AS (
  SELECT id, id FROM ({nodes}) n
  UNION
  SELECT r.id, l.b FROM reach r JOIN {links} l ON l.a = r.other),
comp AS (SELECT id, min(other) AS component FROM reach GROUP BY id)"""


SQL["op6_hyperminhash"] = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), {WORD}) AS w FROM documents),
sets AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)
  UNION ALL
  SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 4),
n AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM sets x JOIN sets y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 75 * (p.n + q.n - k)),
{closure("SELECT doc_id AS id FROM documents", "links")}
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component AS component_id, d.doc_id = component AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN comp ON comp.id = d.doc_id
"""

SQL["op8_fm_substring"] = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {WORD}) AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS k
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
own AS (SELECT k, min(doc_id) AS owner FROM win GROUP BY k),
hit AS (SELECT doc_id, i FROM win JOIN own USING (k) WHERE owner < doc_id),
gone AS (SELECT DISTINCT doc_id, i + j AS p FROM hit, range(0, 50) t(j)),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT words.doc_id, string_agg(word, ' ' ORDER BY words.p) AS s
         FROM words LEFT JOIN gone ON gone.doc_id = words.doc_id AND gone.p = words.p WHERE gone.p IS NULL GROUP BY words.doc_id),
lost AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(lost.n, 0) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN lost USING (doc_id)
"""

SQL["op10_grid_order_join"] = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.e) = len(y.e)
          WHERE list_cosine_similarity(x.e, y.e) >= 0.98),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a),
{closure("SELECT vec_id AS id FROM embeddings", "links")}
SELECT vec_id, coalesce(n.n, 0) AS n_links, component AS component_id, vec_id = component AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id JOIN comp ON comp.id = vec_id
"""


def _distance(counts: str, reference: str, total: str) -> str:
    """Jensen-Shannon distance of two count lists."""
    p = f"({counts}[i] / greatest({total}, 1))"
    q = f"({reference}[i] / list_sum({reference}))"
    term = f"CASE WHEN {p} > 0 AND {q} > 0 THEN {p} * log2(2 * {p} / ({p} + {q})) + {q} * log2(2 * {q} / ({p} + {q})) ELSE {p} + {q} END"
    return f"sqrt(greatest(0, list_sum(list_transform(range(1, len({counts}) + 1), lambda i: {term})) / 2))"


def _references(name: str, rows: str) -> str:
    classes, words = len(rules.CHAR_CLASSES), len(rules.COMMON_WORDS) + 1
    return (f"{name} AS (SELECT lang, [{', '.join(f'CAST(sum(chars[{i + 1}]) AS DOUBLE)' for i in range(classes))}] AS rc, "
            f"[{', '.join(f'CAST(sum(common[{i + 1}]) AS DOUBLE)' for i in range(words))}] AS rw FROM {rows} WHERE NOT base_failed GROUP BY lang)")


def _near(name: str, refs: str) -> str:
    """Distances of every document to its nearest language by common words, then characters, then name."""
    return (f"{name} AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY dw, dc, ref_lang NULLS FIRST) AS place FROM ("
            f"SELECT f.*, r.lang AS ref_lang, {_distance('common', 'rw', 'n_words')} AS dw, {_distance('chars', 'rc', 'word_chars')} AS dc "
            f"FROM f CROSS JOIN {refs} r) x QUALIFY place = 1)")


def _strip(e: str, pattern: str) -> str:
    return f"regexp_replace({e}, '{pattern}', '', 'g')"


_LIST = "[" + ", ".join(f"'{w}'" for w in rules.COMMON_WORDS) + "]"

SQL["op9_divergence_rules"] = rf"""
WITH t0 AS (SELECT doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), {WORD}) AS w FROM documents),
t1 AS (SELECT *, {_strip('t', r'\p{Ll}+')} AS t1 FROM t0),
t2 AS (SELECT *, {_strip('t1', r'[\x20\x09-\x0D]+')} AS t2 FROM t1),
t3 AS (SELECT *, {_strip('t2', r'\p{Lu}+')} AS t3 FROM t2),
t4 AS (SELECT *, {_strip('t3', r'\p{N}+')} AS t4 FROM t3),
t5 AS (SELECT *, {_strip('t4', r'[.,;:\x27"-]+')} AS t5 FROM t4),
t6 AS (SELECT *, {_strip('t5', r'[#*$%&|<>]+')} AS t6 FROM t5),
tri AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM t0 WHERE len(w) >= 3)),
twice AS (SELECT doc_id, g FROM tri GROUP BY doc_id, g HAVING count(*) > 1),
rep AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM tri JOIN twice USING (doc_id, g), range(0, 3) r(j) GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM t0)
          WHERE regexp_matches(l, {WORD}) GROUP BY doc_id),
c AS (SELECT t6.*, CAST(len(w) AS BIGINT) AS n_words, length(t) - length(t1) + length(t2) AS word_chars, length(t5) - length(t6) AS n_symbols,
             coalesce(lines.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
             [length(t) - length(t1), length(t2) - length(t3), length(t3) - length(t4), length(t6), length(t5) - length(t6), length(t4) - length(t5)] AS chars,
             list_transform({_LIST}, lambda x: len(list_filter(w, lambda y: y = x))) AS hits
      FROM t6 LEFT JOIN lines USING (doc_id) LEFT JOIN rep USING (doc_id)),
f AS (SELECT doc_id, lang, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, chars,
             list_append(hits, n_words - list_sum(hits)) AS common,
             n_words < {rules.MIN_WORDS} OR 100 * n_repeat_words > {rules.MAX_REPEAT} * n_words AS base_failed FROM c),
{_references('ref1', 'f')},
{_near('near1', 'ref1')},
{_references('ref2', f"(SELECT * FROM near1 WHERE dc <= {rules.TRIM_CHAR} AND dw <= {rules.TRIM_COMMON} + {rules.TRIM_NOISE} / sqrt(n_words))")},
{_near('near2', 'ref2')}
SELECT doc_id, n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed AND NOT (dc > CASE WHEN n_words < {rules.MIN_CHAR} THEN {rules.MAX_CHAR_SHORT} ELSE {rules.MAX_CHAR} END
                                OR (n_words >= {rules.MIN_COMMON} AND dw > {rules.MAX_COMMON})) AS kept
FROM near2
"""
