"""DuckDB oracle SQL for the invoice corpus and evaluation queries."""

from __future__ import annotations

import re

from tokenlake.functions.draws import duck_draw, duck_draw_mod
from tokenlake.operators import invoices as inv
from tokenlake.operators.evaluate import NUMERIC_FIELDS, TOLERANCE, UNKNOWN_CASE


def lst(values) -> str:
    return "[" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in values) + "]"


def pick(values, idx: str) -> str:
    return f"({lst(values)})[({idx}) + 1]"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


WS = "[ \\t\\n\\r\\f\\x0B]"


def strip(e: str) -> str:
    return f"regexp_replace({e}, '^{WS}+|{WS}+$', '', 'g')"


INVOICES = f"""
inv0 AS (
  SELECT o_orderkey AS invoice_id,
         {pick(inv.VENDOR_FIRST, 'o_custkey % 6')} || ' ' || {pick(inv.VENDOR_SECOND, '(o_custkey // 6) % 6')} AS vendor_name,
         {pick(inv.NUMBER_PREFIXES, 'o_orderkey % 3')} || '-' || CAST(1000 + o_orderkey % 99000 AS VARCHAR) AS invoice_number,
         CAST(o_orderdate AS DATE) AS invoice_date,
         CAST(CAST(o_orderdate AS DATE) + {pick(inv.DUE_DAYS, 'o_custkey % 3')} AS DATE) AS due_date,
         {pick(inv.CURRENCIES, 'o_custkey % 4')} AS currency,
         CAST(round(o_totalprice * 100) AS BIGINT) AS subtotal_cents,
         CAST(5 + o_orderkey % 16 AS INTEGER) AS tax_pct
  FROM orders),
inv AS (SELECT *, (subtotal_cents * tax_pct + 50) // 100 AS tax_cents,
               subtotal_cents + (subtotal_cents * tax_pct + 50) // 100 AS total_cents FROM inv0)
"""


def money(cents: str) -> str:
    sym = "CASE currency " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in inv.SYMBOLS.items()) + " END"
    return f"({sym} || format('{{:,.2f}}', CAST({cents} AS DOUBLE) / 100.0))"


def date_text(c: str) -> str:
    return f"strftime({c}, '%B %d, %Y')"


def value(f: str) -> str:
    if f in ("invoice_date", "due_date"):
        v = date_text(f)
    elif f in NUMERIC_FIELDS:
        v = money(f"{f}_cents")
    else:
        v = f
    return f"(CASE WHEN miss_field IS NOT DISTINCT FROM '{f}' THEN '' ELSE coalesce({v}, 'NA') END)"


def line(f: str) -> str:
    lab = f"(CASE WHEN label_field IS NOT DISTINCT FROM '{f}' THEN label_text ELSE {q(inv.LABELS[f])} END)"
    return (f"(CASE WHEN unlabeled_field IS NOT DISTINCT FROM '{f}' THEN ': ' || {value(f)} "
            f"ELSE {lab} || ': ' || {value(f)} END)")


RENDER = ("(CASE WHEN miss_field IS NOT DISTINCT FROM 'vendor_name' THEN '' ELSE vendor_name || chr(10) || chr(10) END"
          f" || {line('invoice_number')} || chr(10) || {line('invoice_date')} || chr(10) || {line('due_date')}"
          f" || chr(10) || chr(10) || {line('subtotal')} || chr(10) || {line('tax')} || chr(10) || {line('total')}"
          " || chr(10))")


def target_cols() -> str:
    out = []
    for f in inv.ALL_FIELDS:
        if f in ("invoice_date", "due_date"):
            v = date_text(f)
        elif f in NUMERIC_FIELDS:
            v = f"CAST({f}_cents AS DOUBLE) / 100.0"
        else:
            v = f
        out.append(f"CASE WHEN hidden_field IS NOT DISTINCT FROM '{f}' THEN NULL ELSE {v} END AS t_{f}")
    return ", ".join(out)


def target_json() -> str:
    parts = []
    for f in inv.ALL_FIELDS:
        c = f"t_{f}"
        v = (f"coalesce(CAST({c} AS VARCHAR), 'null')" if f in NUMERIC_FIELDS
             else f"coalesce(CAST(to_json({c}) AS VARCHAR), 'null')")
        parts.append(f"'  \"{f}\": ' || {v}")
    return "('{' || chr(10) || " + " || ',' || chr(10) || ".join(parts) + " || chr(10) || '}')"


def vocab() -> str:
    return lst(inv.label_vocab_lower())


def corrupt(label: str, k: str, key: str, salt: str) -> str:
    n = f"length({label})"
    pool = q(inv.CORRUPTION_POOL)

    def positions(a):
        ranked = (f"list_sort(list_transform(range(0, {n}), lambda i: "
                  f"{{'h': {duck_draw('corrupt:pos', key, salt, a, 'i')}, 'i': i}}))")
        return f"list_transform(list_slice({ranked}, 1, least({k}, {n})), lambda s: s.i)"

    ch = f"substr({label}, CAST(i + 1 AS BIGINT), 1)"

    def repl(a):
        ci = f"(instr({pool}, {ch}) - 1)"
        size = f"(CASE WHEN {ci} >= 0 THEN 61 ELSE 62 END)"
        j = f"({duck_draw('corrupt:chr', key, salt, a, 'i')} % {size})"
        j2 = f"(CASE WHEN {ci} >= 0 AND {j} >= {ci} THEN {j} + 1 ELSE {j} END)"
        return f"substr({pool}, CAST({j2} + 1 AS BIGINT), 1)"

    def candidate(a):
        return (f"list_transform([{positions(a)}], lambda pos: array_to_string(list_transform(range(0, {n}), "
                f"lambda i: CASE WHEN list_contains(pos, i) THEN {repl(a)} ELSE {ch} END), ''))[1]")

    def accepted_last(a):
        made = (f"list_transform(range(1, length({pool}) + 1), lambda c: array_to_string(list_transform(range(0, {n}), "
                f"lambda i: CASE WHEN i = pos[-1] THEN substr({pool}, c, 1) WHEN list_contains(pos, i) THEN {repl(a)} ELSE {ch} END), ''))")
        some = (f"list_filter({made}, lambda c: substr(c, CAST(pos[-1] + 1 AS BIGINT), 1) <> substr({label}, CAST(pos[-1] + 1 AS BIGINT), 1) "
                f"AND NOT list_contains({vocab()}, lower(c)))")
        return (f"list_transform(list_transform([{positions(a)}], lambda pos: {some}), "
                f"lambda m: m[{duck_draw('corrupt:last', key, salt)} % len(m) + 1])[1]")

    attempts = f"list_transform(range(1, {inv.CORRUPT_ATTEMPTS + 1}), lambda a: {candidate('a')})"
    ok = f"list_filter({attempts}, lambda c: NOT list_contains({vocab()}, lower(c)))"
    return f"CASE WHEN len({ok}) > 0 THEN ({ok})[1] ELSE {accepted_last(str(inv.CORRUPT_ATTEMPTS + 1))} END"


def case_of_key(k: str) -> str:
    r = f"({k} % {sum(inv.CASE_BUCKETS)})"
    parts, lo = [], 0
    for (name, _), w in zip(inv.CASE_MIXTURE, inv.CASE_BUCKETS):
        parts.append(f"WHEN {r} >= {lo} AND {r} < {lo + w} THEN '{name}'")
        lo += w
    return "CASE " + " ".join(parts) + " END"


def field_label_case() -> str:
    return "CASE field " + " ".join(f"WHEN '{f}' THEN {q(l)}" for f, l in inv.LABELS.items()) + " END"


def alias_case() -> str:
    arrays = "CASE field " + " ".join(f"WHEN '{f}' THEN {lst(a)}" for f, a in inv.ALIASES.items()) + " END"
    return f"({arrays})[({duck_draw('alias', 'invoice_id')} % len({arrays})) + 1]"


PLAN = f"""
pl0 AS (SELECT *, {case_of_key('invoice_id')} AS "case",
               {pick(inv.FIELDS, duck_draw_mod(len(inv.FIELDS), 'field', 'invoice_id'))} AS field,
               ({duck_draw('vendor', 'invoice_id')} / 4294967296.0 < {inv.MISSING_VENDOR_P}) AS vmiss,
               ({duck_draw('unlabeled', 'invoice_id')} / 4294967296.0 < {inv.UNLABELED_P}) AS unlab
        FROM inv),
pl1 AS (SELECT *, {field_label_case()} AS base_label FROM pl0),
pl AS (
  SELECT *,
    CASE WHEN "case" = 'missing_value' AND vmiss THEN 'vendor_name'
         WHEN "case" = 'missing_value' THEN field END AS miss_field,
    CASE WHEN "case" = 'rejected_corrupted_or_unlabeled' AND unlab THEN field END AS unlabeled_field,
    CASE WHEN "case" IN ('label_format_variation', 'accepted_corrupted_label') THEN field
         WHEN "case" = 'rejected_corrupted_or_unlabeled' AND NOT unlab THEN field END AS label_field,
    CASE WHEN "case" = 'label_format_variation' THEN {alias_case()}
         WHEN "case" = 'accepted_corrupted_label' OR ("case" = 'rejected_corrupted_or_unlabeled' AND NOT unlab)
              THEN {corrupt('base_label', "CASE WHEN \"case\" = 'accepted_corrupted_label' THEN 1 ELSE 3 END",
                            'invoice_id', "CASE WHEN \"case\" = 'accepted_corrupted_label' THEN 'c1' ELSE 'c3' END")}
         END AS label_text,
    CASE WHEN "case" = 'missing_value' AND vmiss THEN 'vendor_name'
         WHEN "case" = 'missing_value' THEN field
         WHEN "case" = 'rejected_corrupted_or_unlabeled' THEN field END AS hidden_field
  FROM pl1),
ex AS (SELECT invoice_id AS example_id, *, {RENDER} AS text, {target_cols()} FROM pl)
"""

SPLIT = f"""
ranked AS (SELECT *, row_number() OVER (PARTITION BY "case" ORDER BY example_id) - 1 AS itr,
                  count(*) OVER (PARTITION BY "case") AS case_n FROM ex),
sp AS (SELECT *, CASE WHEN itr < floor(case_n * {inv.TRAIN_FRACTION}) THEN 'train' ELSE 'validation' END AS split
       FROM ranked)
"""


def shuffle_lines(text: str, key: str, salt: str = "lines") -> str:
    lines = f"list_filter(string_split({text}, chr(10)), lambda l: regexp_matches(l, '[^ \\t\\n\\r\\f\\x0B]'))"
    keyed = (f"list_transform({lines}, lambda l, i: "
             f"{{'h': {duck_draw(salt, key, 'i - 1')}, 'i': i - 1, 'l': l}})")
    return f"(array_to_string(list_transform(list_sort({keyed}), lambda s: s.l), chr(10)) || chr(10))"


EVAL = f"""
ev AS (SELECT * REPLACE (
          CASE WHEN "case" = 'clean' AND example_id % 2 = 1 THEN '{inv.HARD_CASE}' ELSE "case" END AS "case",
          CASE WHEN "case" = 'clean' AND example_id % 2 = 1 THEN {shuffle_lines('text', 'example_id')}
               ELSE text END AS text)
       FROM ex)
"""


def cents_text(c: str) -> str:
    return f"(CAST(({c}) // 100 AS VARCHAR) || '.' || lpad(CAST(({c}) % 100 AS VARCHAR), 2, '0'))"


def defect_raw() -> str:
    d = "(example_id % 10)"
    frags = []
    for f in inv.ALL_FIELDS:
        t = f"t_{f}"
        if f in NUMERIC_FIELDS:
            v = f"CASE WHEN {t} IS NULL THEN 'null' ELSE {cents_text(f + '_cents')} END"
        else:
            v = f"CASE WHEN {t} IS NULL THEN 'null' ELSE '\"' || {t} || '\"' END"
        if f == "vendor_name":
            v = f"CASE WHEN {d} = 5 THEN 'null' ELSE {v} END"
        if f == "total":
            v = (f"CASE WHEN {d} = 6 AND t_total IS NOT NULL THEN {cents_text('total_cents')} || '00001' "
                 f"WHEN {d} = 7 AND t_total IS NOT NULL THEN {cents_text('total_cents + 1')} "
                 f"WHEN {d} = 8 AND t_total IS NOT NULL THEN '\"' || {cents_text('total_cents')} || '\"' "
                 f"ELSE {v} END")
        v = f"CASE WHEN {d} = 9 AND hidden_field IS NOT DISTINCT FROM '{f}' THEN '\"FILLED\"' ELSE {v} END"
        frag = f"'\"{f}\": ' || ({v})"
        if f == "currency":
            frag = f"CASE WHEN {d} = 4 THEN NULL ELSE {frag} END"
        frags.append(frag)
    body = "('{' || concat_ws(', ', " + ", ".join(frags) + ") || '}')"
    return (f"CASE WHEN {d} = 1 THEN '```json' || chr(10) || {body} || chr(10) || '```' "
            f"WHEN {d} = 2 THEN substr({body}, 1, length({body}) - 1) "
            f"WHEN {d} = 3 THEN '[' || {body} || ']' ELSE {body} END")


def parse_body(raw: str) -> str:
    s = strip(f"coalesce({raw}, '')")
    seg = f"string_split({s}, '```')[2]"
    seg2 = strip(f"CASE WHEN starts_with({seg}, 'json') THEN substr({seg}, 5) ELSE {seg} END")
    return f"CASE WHEN starts_with({s}, '```') THEN {seg2} ELSE {s} END"


NUM_TYPES = "('BIGINT', 'UBIGINT', 'DOUBLE', 'INTEGER', 'HUGEINT')"


def field_ok(f: str, js: str = "js") -> str:
    path = f"'$.{f}'"
    jt = f"json_type({js}, {path})"
    truth = f"t_{f}"
    if f in NUMERIC_FIELDS:
        val = f"({jt} IN {NUM_TYPES} AND abs(CAST(json_extract({js}, {path}) AS DOUBLE) - {truth}) < {TOLERANCE})"
    else:
        val = f"({jt} = 'VARCHAR' AND json_extract_string({js}, {path}) = {truth})"
    return f"(CASE WHEN {truth} IS NULL THEN coalesce({jt} = 'NULL', false) ELSE coalesce({val}, false) END)"


def pnull(f: str, js: str = "js") -> str:
    return f"coalesce(json_type({js}, '$.{f}') = 'NULL', false)"


SCORED = f"""
pr AS (SELECT example_id, "case", {', '.join('t_' + f for f in inv.ALL_FIELDS)},
              {' + '.join(f'CASE WHEN t_{f} IS NULL THEN 1 ELSE 0 END' for f in inv.ALL_FIELDS)} AS n_null_expected,
              {defect_raw()} AS raw FROM ev),
pb AS (SELECT *, {parse_body('raw')} AS body FROM pr),
pj AS (SELECT *, CASE WHEN json_valid(body) AND json_type(body) = 'OBJECT' THEN body END AS js FROM pb),
sc AS (SELECT example_id, "case", n_null_expected, js IS NOT NULL AS parsed,
              {', '.join(f'CASE WHEN js IS NOT NULL THEN {field_ok(f)} END AS ok_{f}' for f in inv.ALL_FIELDS)},
              {', '.join(f'CASE WHEN js IS NOT NULL THEN t_{f} IS NULL AND {pnull(f)} END AS nullok_{f}' for f in inv.ALL_FIELDS)},
              {', '.join(f'CASE WHEN js IS NOT NULL THEN t_{f} IS NOT NULL AND {pnull(f)} END AS halluc_{f}' for f in inv.ALL_FIELDS)}
       FROM pj),
sc2 AS (SELECT *, coalesce(parsed AND {' AND '.join('ok_' + f for f in inv.ALL_FIELDS)}, false) AS all_ok FROM sc)
"""

SQL: dict[str, str] = {}

SQL["g2_invoice_render"] = f"""
WITH {INVOICES},
r AS (SELECT invoice_id, vendor_name, invoice_number, invoice_date, due_date, currency,
             subtotal_cents, tax_cents, total_cents,
             NULL::VARCHAR AS miss_field, NULL::VARCHAR AS unlabeled_field, NULL::VARCHAR AS label_field,
             NULL::VARCHAR AS label_text, NULL::VARCHAR AS hidden_field FROM inv),
t AS (SELECT invoice_id, {RENDER} AS text, {target_cols()} FROM r)
SELECT invoice_id, text, {target_json()} AS target_json FROM t
"""

_K = "o_orderkey"
SQL["g1_invoice_truth"] = f"""
WITH t AS (
  SELECT {_K} AS invoice_id,
         {pick(inv.VENDOR_FIRST, duck_draw_mod(6, 'v1:42', _K))} || ' ' || {pick(inv.VENDOR_SECOND, duck_draw_mod(6, 'v2:42', _K))} AS vendor_name,
         {pick(inv.NUMBER_PREFIXES, duck_draw_mod(3, 'prefix:42', _K))} || '-' || CAST(1000 + {duck_draw_mod(99000, 'num:42', _K)} AS VARCHAR) AS invoice_number,
         CAST(DATE '{inv.BASE_DATE}' + 1 + {duck_draw_mod(1000, 'date:42', _K)} AS DATE) AS d,
         {duck_draw_mod(3, 'due:42', _K)} AS due_i,
         {pick(inv.CURRENCIES, duck_draw_mod(4, 'cur:42', _K))} AS currency,
         CAST(100 + {duck_draw_mod(999901, 'amount:42', _K)} AS BIGINT) AS subtotal_cents,
         5 + {duck_draw_mod(16, 'rate:42', _K)} AS tax_pct
  FROM orders)
SELECT invoice_id, vendor_name, invoice_number, strftime(d, '%Y-%m-%d') AS invoice_date,
       strftime(CAST(d + {lst(inv.DUE_DAYS)}[due_i + 1] AS DATE), '%Y-%m-%d') AS due_date, currency,
       subtotal_cents, (subtotal_cents * tax_pct + 50) // 100 AS tax_cents,
       subtotal_cents + (subtotal_cents * tax_pct + 50) // 100 AS total_cents
FROM t
"""

SQL["g7_case_examples"] = f"""
WITH {INVOICES}, {PLAN}
SELECT example_id, "case", field, miss_field, unlabeled_field, label_field, label_text, hidden_field, text FROM ex
"""

SQL["p9_label_valid"] = f"""
WITH {INVOICES}, {PLAN}
SELECT "case", count(*) AS n_relabelled,
       count(CASE WHEN list_contains({vocab()}, lower(label_text)) THEN 1 END) AS n_valid
FROM ex WHERE label_field IS NOT NULL GROUP BY "case"
"""

MIXTURE = "CASE \"case\" " + " ".join(f"WHEN '{name}' THEN {n}" for name, n in inv.CASE_MIXTURE) + " END"
MIXTURE_TOTAL = sum(n for _, n in inv.CASE_MIXTURE)

SQL["a9_case_counts"] = f"""
WITH {INVOICES}, {PLAN}, {SPLIT},
g AS (SELECT split, "case", count(*) AS n FROM sp GROUP BY split, "case"),
e AS (SELECT *, (sum(n) OVER () * {MIXTURE} + {MIXTURE_TOTAL} // 2) // {MIXTURE_TOTAL} AS case_n FROM g),
f AS (SELECT *, CAST(CASE WHEN split = 'train' THEN floor(case_n * {inv.TRAIN_FRACTION})
                          ELSE case_n - floor(case_n * {inv.TRAIN_FRACTION}) END AS BIGINT) AS expected FROM e)
SELECT split, "case", n, expected, abs(n - expected) <= greatest(1.0, expected * 0.05) AS matches FROM f
"""

SQL["g11_prompt_completion"] = f"""
WITH {INVOICES}, {PLAN}, {SPLIT}
SELECT example_id, split, 2 AS n_prompt, text AS user_content, {target_json()} AS completion_content FROM sp
"""

SQL["v1_sft_contract"] = f"""
WITH {INVOICES}, {PLAN}, {SPLIT},
c AS (SELECT split, text, {target_json()} AS comp FROM sp)
SELECT split, count(*) AS n_rows,
       count(CASE WHEN NOT (text IS NOT NULL AND coalesce(list_sort(json_keys(comp)) = list_sort({lst(inv.ALL_FIELDS)}), false))
                  THEN 1 END) AS n_violations
FROM c GROUP BY split
"""

SQL["v2_arith_invariant"] = f"""
WITH {INVOICES}
SELECT currency, count(*) AS n_rows,
       count(CASE WHEN subtotal_cents + tax_cents <> total_cents THEN 1 END) AS n_violations
FROM inv GROUP BY currency
"""

SQL["o1_dataset_shuffle"] = f"""
WITH {INVOICES}, {PLAN}, {SPLIT}
SELECT split, example_id, "case", {duck_draw('shuffle:42', 'example_id')} AS shuffle_key
FROM sp ORDER BY split, shuffle_key, example_id
"""

SQL["g8_hard_case"] = f"""
WITH {INVOICES}, {PLAN}, {EVAL}
SELECT example_id, text FROM ev WHERE "case" = '{inv.HARD_CASE}'
"""

SQL["a10_eval_case_report"] = f"""
WITH {INVOICES}, {PLAN}, {EVAL}, {SCORED},
g AS (SELECT "case", count(*) AS n,
             count(CASE WHEN NOT parsed THEN 1 END) AS parse_fail,
             count(CASE WHEN all_ok THEN 1 END) AS all_fields_correct,
             CAST(sum(CASE WHEN parsed THEN n_null_expected ELSE 0 END) AS BIGINT) AS null_expected,
             CAST(sum(CASE WHEN parsed THEN {' + '.join(f'CASE WHEN nullok_{f} THEN 1 ELSE 0 END' for f in inv.ALL_FIELDS)} ELSE 0 END) AS BIGINT) AS null_correct,
             CAST(sum(CASE WHEN parsed THEN {len(inv.ALL_FIELDS)} - n_null_expected ELSE 0 END) AS BIGINT) AS value_expected,
             CAST(sum(CASE WHEN parsed THEN {' + '.join(f'CASE WHEN halluc_{f} THEN 1 ELSE 0 END' for f in inv.ALL_FIELDS)} ELSE 0 END) AS BIGINT) AS hallucinated_null
      FROM sc2 GROUP BY "case")
SELECT "case", CAST(list_position({lst(inv.EVAL_CASES)}, "case") AS INTEGER) AS case_pos,
       n, parse_fail, all_fields_correct, null_expected, null_correct, value_expected, hallucinated_null,
       CAST(all_fields_correct AS DOUBLE) / NULLIF(CAST(n AS DOUBLE), 0) AS exact,
       CAST(null_correct AS DOUBLE) / NULLIF(CAST(null_expected AS DOUBLE), 0) AS null_recall,
       CAST(hallucinated_null AS DOUBLE) / NULLIF(CAST(value_expected AS DOUBLE), 0) AS halluc_null_rate
FROM g ORDER BY case_pos
"""



def _label_value(f: str) -> str:
    """Text after the first line label of a field (canonical or alias), NULL if there is none."""
    labels = "|".join(re.sub(r"([.-])", r"\\\1", x) for x in [inv.LABELS[f], *inv.ALIASES[f]])
    return f"NULLIF(regexp_extract(text, '(?m)^[ \\t]*(?:{labels})[ \\t]*:[ \\t]*(.*?)[ \\t]*$', 1), '')"


_numbers = [f for f in inv.LABELS if f in NUMERIC_FIELDS]
_symbol = lambda v: "CASE substr(" + v + ", 1, 1) " + " ".join(f"WHEN '{x}' THEN '{c}'" for c, x in inv.SYMBOLS.items()) + " END"
_read = [f"{_label_value(f)} AS v_{f}" for f in inv.LABELS]
_read += [r"regexp_extract(text, '^\s*([^\n]*)', 1) AS first_line"]
_pred = {f: f"v_{f}" for f in inv.LABELS if f not in NUMERIC_FIELDS}
_pred |= {f: f"TRY_CAST(NULLIF(regexp_replace(v_{f}, '[^0-9.]', '', 'g'), '') AS DOUBLE)" for f in _numbers}
_pred["vendor_name"] = "CASE WHEN first_line <> '' AND NOT contains(first_line, ':') THEN first_line END"
_pred["currency"] = "coalesce(" + ", ".join(_symbol(f"v_{f}") for f in _numbers) + ")"
_same = lambda f: f"abs(p_{f} - t_{f}) < {TOLERANCE}" if f in NUMERIC_FIELDS else f"p_{f} = t_{f}"
SQL["u1_rule_predictor"] = f"""
WITH {INVOICES}, {PLAN}, {EVAL},
rd AS (SELECT "case", {', '.join('t_' + f for f in inv.ALL_FIELDS)}, {', '.join(_read)} FROM ev),
pd AS (SELECT *, {', '.join(f'{_pred[f]} AS p_{f}' for f in inv.ALL_FIELDS)} FROM rd),
ok AS (SELECT "case",
              {' AND '.join(f'CASE WHEN t_{f} IS NULL THEN p_{f} IS NULL ELSE coalesce({_same(f)}, false) END' for f in inv.ALL_FIELDS)} AS all_ok,
              {' + '.join(f'CASE WHEN t_{f} IS NULL THEN 1 ELSE 0 END' for f in inv.ALL_FIELDS)} AS n_null,
              {' + '.join(f'CASE WHEN t_{f} IS NULL AND p_{f} IS NULL THEN 1 ELSE 0 END' for f in inv.ALL_FIELDS)} AS n_null_ok,
              {' + '.join(f'CASE WHEN t_{f} IS NOT NULL AND p_{f} IS NULL THEN 1 ELSE 0 END' for f in inv.ALL_FIELDS)} AS n_halluc
       FROM pd),
g AS (SELECT "case", count(*) AS n, CAST(0 AS BIGINT) AS parse_fail, count(CASE WHEN all_ok THEN 1 END) AS all_fields_correct,
             CAST(sum(n_null) AS BIGINT) AS null_expected, CAST(sum(n_null_ok) AS BIGINT) AS null_correct,
             CAST(sum({len(inv.ALL_FIELDS)} - n_null) AS BIGINT) AS value_expected, CAST(sum(n_halluc) AS BIGINT) AS hallucinated_null
      FROM ok GROUP BY "case")
SELECT "case", CAST(list_position({lst(inv.EVAL_CASES)}, "case") AS INTEGER) AS case_pos,
       n, parse_fail, all_fields_correct, null_expected, null_correct, value_expected, hallucinated_null,
       CAST(all_fields_correct AS DOUBLE) / NULLIF(CAST(n AS DOUBLE), 0) AS exact,
       CAST(null_correct AS DOUBLE) / NULLIF(CAST(null_expected AS DOUBLE), 0) AS null_recall,
       CAST(hallucinated_null AS DOUBLE) / NULLIF(CAST(value_expected AS DOUBLE), 0) AS halluc_null_rate
FROM g ORDER BY case_pos
"""

_long = " UNION ALL ".join(
    f"SELECT \"case\", parsed, '{f}' AS field, ok_{f} AS ok FROM sc2" for f in inv.ALL_FIELDS)
SQL["a11_eval_field_report"] = f"""
WITH {INVOICES}, {PLAN}, {EVAL}, {SCORED},
l AS ({_long}),
g AS (SELECT "case", field, count(CASE WHEN parsed THEN 1 END) AS n_ok,
             count(CASE WHEN ok THEN 1 END) AS correct FROM l GROUP BY "case", field)
SELECT "case", field, n_ok, correct,
       CAST(correct AS DOUBLE) / CAST(greatest(n_ok, 1) AS DOUBLE) AS accuracy FROM g
"""

_wrong = ("array_to_string(list_filter([" + ", ".join(
    f"CASE WHEN NOT ok_{f} THEN '{f}' END" for f in inv.ALL_FIELDS) + "], lambda x: x IS NOT NULL), ',')")
SQL["w6_first_failures"] = f"""
WITH {INVOICES}, {PLAN}, {EVAL}, {SCORED},
f AS (SELECT "case", example_id, CASE WHEN parsed THEN 'value' ELSE 'parse' END AS reason,
             CAST(row_number() OVER (PARTITION BY "case" ORDER BY example_id) AS INTEGER) AS rank,
             {_wrong} AS wrong_fields
      FROM sc2 WHERE NOT all_ok)
SELECT * FROM f WHERE rank <= 3
"""


def _got(f: str, js: str = "js") -> str:
    path = f"'$.{f}'"
    jt = f"json_type({js}, {path})"
    return (f"CASE WHEN {jt} IS NULL THEN 'missing' WHEN {jt} = 'NULL' THEN 'null' WHEN {jt} = 'VARCHAR' THEN json_extract_string({js}, {path}) "
            f"ELSE CAST(CAST(CAST(json_extract({js}, {path}) AS DOUBLE) AS DECIMAL(24, 7)) AS VARCHAR) END")


def _want(f: str) -> str:
    value = f"CAST(CAST(pj.t_{f} AS DECIMAL(24, 7)) AS VARCHAR)" if f in NUMERIC_FIELDS else f"pj.t_{f}"
    return f"coalesce({value}, 'null')"


_pairs = ("CASE WHEN parsed THEN array_to_string(list_filter([" + ", ".join(
    f"CASE WHEN NOT ok_{f} THEN '{f}: (' || {_got(f)} || ', ' || {_want(f)} || ')' END" for f in inv.ALL_FIELDS)
    + "], lambda x: x IS NOT NULL), '; ') ELSE '' END")
SQL["w6_failure_details"] = f"""
WITH {INVOICES}, {PLAN}, {EVAL}, {SCORED},
f AS (SELECT *, CASE WHEN parsed THEN 'value' ELSE 'parse' END AS reason,
             CAST(row_number() OVER (PARTITION BY "case" ORDER BY example_id) AS INTEGER) AS rank
      FROM sc2 WHERE NOT all_ok)
SELECT f."case", example_id, f.rank, f.reason, pj.raw, ev.text, {_pairs} AS wrong
FROM f JOIN pj USING (example_id) JOIN ev USING (example_id) WHERE rank <= 3
"""

SQL["j2_prediction_join"] = f"""
WITH {INVOICES}, {PLAN}, {EVAL}, {SCORED},
a AS (SELECT *, example_id % 7 = 0 AS missing, example_id % 7 <> 0 AND example_id % 11 = 0 AS repeated FROM sc2)
SELECT "case", count(*) AS n, count(CASE WHEN missing THEN 1 END) AS n_missing, count(CASE WHEN repeated THEN 1 END) AS n_repeated,
       count(CASE WHEN missing OR NOT parsed THEN 1 END) AS parse_fail, count(CASE WHEN all_ok AND NOT missing THEN 1 END) AS all_fields_correct
FROM a GROUP BY "case"
UNION ALL
SELECT '{UNKNOWN_CASE}', count(*), 0, 0, 0, 0 FROM sc2 WHERE example_id % 7 <> 0 AND example_id % 13 = 0
"""


def strict_eq(f: str, js: str = "s") -> str:
    path = f"'$.{f}'"
    jt = f"json_type({js}, {path})"
    truth = f"t_{f}"
    if f in NUMERIC_FIELDS:
        val = f"({jt} IN {NUM_TYPES} AND CAST(json_extract({js}, {path}) AS DOUBLE) = {truth})"
    else:
        val = f"({jt} = 'VARCHAR' AND json_extract_string({js}, {path}) = {truth})"
    return f"(CASE WHEN {truth} IS NULL THEN coalesce({jt} = 'NULL', false) ELSE coalesce({val}, false) END)"


SQL["a12_json_exact_rate"] = f"""
WITH {INVOICES}, {PLAN}, {EVAL},
pr AS (SELECT "case", {', '.join('t_' + f for f in inv.ALL_FIELDS)}, {strip(f"coalesce({defect_raw()}, '')")} AS s0 FROM ev),
p2 AS (SELECT *, s0 AS s, json_valid(s0) AS valid FROM pr)
SELECT "case", count(*) AS n, count(CASE WHEN valid THEN 1 END) AS valid_json,
       count(CASE WHEN valid AND json_type(s) = 'OBJECT'
                   AND list_sort(json_keys(s)) = list_sort({lst(inv.ALL_FIELDS)})
                   AND {' AND '.join(strict_eq(f) for f in inv.ALL_FIELDS)} THEN 1 END) AS fully_correct
FROM p2 GROUP BY "case"
"""


def jitter(label: str, key: str, salt: str = "jitter") -> str:
    n = f"length({label})"
    letters = f"list_filter(range(0, {n}), lambda i: regexp_matches(substr({label}, CAST(i + 1 AS BIGINT), 1), '^[A-Za-z]$'))"
    k = f"(1 + {duck_draw(salt + ':k', key)} % greatest(len({letters}), 1))"
    ranked = f"list_sort(list_transform({letters}, lambda i: {{'h': {duck_draw(salt + ':pos', key, 'i')}, 'i': i}}))"
    chosen = f"list_transform(list_slice({ranked}, 1, {k}), lambda s: s.i)"
    ch = f"substr({label}, CAST(i + 1 AS BIGINT), 1)"
    flip = f"CASE WHEN upper({ch}) = {ch} THEN lower({ch}) ELSE upper({ch}) END"
    body = (f"list_transform([{chosen}], lambda pos: array_to_string(list_transform(range(0, {n}), "
            f"lambda i: CASE WHEN list_contains(pos, i) THEN {flip} ELSE {ch} END), ''))[1]")
    return f"CASE WHEN len({letters}) = 0 THEN {label} ELSE {body} END"


SQL["g5_label_case_jitter"] = f"""
WITH {INVOICES}, {PLAN}
SELECT example_id, base_label AS label, {jitter('base_label', 'example_id')} AS jittered FROM ex
"""
