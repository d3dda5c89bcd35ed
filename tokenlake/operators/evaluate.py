"""Extraction evaluation.

Pipeline: eval examples -> predictions (B7 defects, or a pluggable
predictor as an Arrow column function) -> left join on example_id (a missing
prediction is a parse failure) -> parse (fence strip, JSON object or
NULL) -> eight per-field booleans -> one ``groupBy('case')`` for the case
report, an unpivot + ``groupBy('case','field')`` for the field report and
a group-limited window for the first three failures.

Denominators follow the reference exactly (trap 8): exact-match over all
rows, field accuracy over parsed rows (divisor floored at 1), null recall
and hallucinated-null over parsed rows only, NULL for empty denominators.
A JSON boolean never equals a number (trap 18, documented deviation).
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenlake.functions.workers import once
from tokenlake.operators import invoices as inv
from tokenlake.operators.ordered import first_k

NUMERIC_FIELDS = ("subtotal", "tax", "total")
TOLERANCE = 1e-6
WS = " \t\n\r\f\x0b"
FIELD_OF_LABEL = {label: f for f, canon in inv.LABELS.items() for label in (canon, *inv.ALIASES[f])}
CURRENCY_OF_SYMBOL = {symbol: c for c, symbol in inv.SYMBOLS.items()}
NOT_IN_NUMBER = re.compile(r"[^\d.]")


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WS))


# ------------------------------------------------------------------ predictions

def _pred_value(f: str) -> Column:
    t = F.col(f"t_{f}")
    if f in NUMERIC_FIELDS:
        return F.when(t.isNull(), F.lit("null")).otherwise(inv.cents_text(F.col(f"{f}_cents")))
    return F.when(t.isNull(), F.lit("null")).otherwise(F.concat(F.lit('"'), t, F.lit('"')))


def defect_raw() -> Column:
    """The target as model output with one defect by ``example_id % 10``:
    0 none, 1 fenced, 2 broken JSON, 3 JSON array, 4 key missing,
    5 vendor null, 6 total + 1e-7, 7 total + 0.01, 8 total as string,
    9 hidden field filled.  A column of the example row (no join)."""
    d = F.pmod(F.col("example_id"), F.lit(10))
    frags = []
    for f in inv.ALL_FIELDS:
        v = _pred_value(f)
        if f == "vendor_name":
            v = F.when(d == 5, F.lit("null")).otherwise(v)
        if f == "total":
            tc = F.col("total_cents")
            v = (F.when((d == 6) & F.col("t_total").isNotNull(), F.concat(inv.cents_text(tc), F.lit("00001")))
                 .when((d == 7) & F.col("t_total").isNotNull(), inv.cents_text(tc + 1))
                 .when((d == 8) & F.col("t_total").isNotNull(), F.concat(F.lit('"'), inv.cents_text(tc), F.lit('"')))
                 .otherwise(v))
        v = F.when((d == 9) & F.col("hidden_field").eqNullSafe(F.lit(f)), F.lit('"FILLED"')).otherwise(v)
        frag = F.concat(F.lit(f'"{f}": '), v)
        if f == "currency":
            frag = F.when(d == 4, F.lit(None)).otherwise(frag)
        frags.append(frag)
    body = F.concat(F.lit("{"), F.concat_ws(", ", *frags), F.lit("}"))
    return (F.when(d == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
            .when(d == 2, F.substring(body, F.lit(1), F.length(body) - 1))
            .when(d == 3, F.concat(F.lit("["), body, F.lit("]")))
            .otherwise(body))


def defect_predictions(ex: DataFrame) -> DataFrame:
    """B7 predictions as a (example_id, raw) table."""
    return ex.select("example_id", defect_raw().alias("raw"))


def labelled_values(text: str) -> dict[str, str]:
    """Per field, what follows the first line label (canonical or alias)."""
    found: dict[str, str] = {}
    for line in text.split("\n"):
        head, colon, value = line.partition(":")
        f = FIELD_OF_LABEL.get(head.strip(" \t")) if colon else None
        if f is not None and f not in found:
            found[f] = value.strip(" \t")
    return found


def rule_predictor(texts: pd.Series) -> pd.Series:
    """Baseline predictor for U1: reads the G2 label lines of an Arrow batch,
    each text in one pass over its lines, the numbers of a field as one vector.

    Not a model: it returns what a perfect extractor would for texts whose
    labels are canonical or aliases, so the pipeline runs end to end
    without a GPU."""
    t = texts.fillna("").tolist()
    read = [labelled_values(x) for x in t]
    out: dict[str, list] = {"currency": [None] * len(t)}
    first = [x.lstrip().partition("\n")[0] for x in t]
    out["vendor_name"] = [x if x and ":" not in x else None for x in first]
    for f in inv.LABELS:
        val = [r.get(f) or None for r in read]
        if f in NUMERIC_FIELDS:
            out["currency"] = [c or (CURRENCY_OF_SYMBOL.get(v[0]) if v else None) for c, v in zip(out["currency"], val)]
            num = pd.to_numeric(pd.Series([(v and NOT_IN_NUMBER.sub("", v)) or None for v in val], dtype=object), errors="coerce")
            val = num.astype(object).where(num.notna(), None).tolist()
        out[f] = val
    values = [json.dumps(out[f])[1:-1].split(", ") if f in NUMERIC_FIELDS else ["null" if v is None else json.dumps(v) for v in out[f]]
              for f in inv.ALL_FIELDS]                 # the texts json.dumps gives the records, a column at a time
    form = "{" + ", ".join(f'"{f}": %s' for f in inv.ALL_FIELDS) + "}"
    return pd.Series([form % r for r in zip(*values)][:len(t)], index=texts.index, dtype=object)


def load_rule_predictor() -> Callable[[pd.Series], pd.Series]:
    """Loader of the baseline predictor."""
    return rule_predictor


def predicted(ex: DataFrame, loader: Callable[[], Callable[[pd.Series], pd.Series]] = load_rule_predictor,
              text_col: str = "text", name: str | None = None) -> DataFrame:
    """``ex`` with the predictor's output in ``raw``.

    ``loader`` returns the predictor (texts of an Arrow batch -> raw outputs);
    it runs once in a Python worker, which then serves all batches of all its
    tasks.  Calls of one ``name`` share what was loaded (default: this call
    alone).  Only the texts go to Python; no join.  For predictions that come
    from elsewhere see ``score(truth, predictions)``."""
    name = name or uuid.uuid4().hex

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        predict = once(loader, name)
        for texts in batches:
            yield predict(texts)
    return ex.withColumn("raw", F.pandas_udf(run, "string")(F.col(text_col)))


def batch_predict(ex: DataFrame, predictor: Callable[[pd.Series], pd.Series] = rule_predictor,
                  text_col: str = "text") -> DataFrame:
    """U1 as a table of predictions (example_id, raw) by a ready function."""
    def load() -> Callable[[pd.Series], pd.Series]:
        return predictor
    return predicted(ex.select("example_id", text_col), load, text_col).select("example_id", "raw")


# ------------------------------------------------------------------ parse + compare

def parse_prediction(raw: Column) -> Column:
    """V4 (F.15 + F.13): strip; a text starting with a code fence keeps the
    second fence segment minus a leading ``json``; JSON object or NULL."""
    s = strip(F.coalesce(raw, F.lit("")))
    seg = F.try_element_at(F.split(s, "```"), F.lit(2))
    seg = strip(F.when(seg.startswith("json"), F.substring(seg, 5, 1 << 30)).otherwise(seg))
    body = F.when(s.startswith("```"), seg).otherwise(s)
    v = F.try_parse_json(body)
    return F.when(F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False)), v)


def with_parsed(df: DataFrame, raw: str = "raw") -> DataFrame:
    """V4 as successive projections (each intermediate computed once):
    strip -> fence segment -> body -> JSON -> object or NULL in ``_v``."""
    df = df.withColumn("_s", strip(F.coalesce(F.col(raw), F.lit(""))))
    df = df.withColumn("_seg", F.try_element_at(F.split(F.col("_s"), "```"), F.lit(2)))
    seg = strip(F.when(F.col("_seg").startswith("json"), F.substring(F.col("_seg"), 5, 1 << 30))
                .otherwise(F.col("_seg")))
    df = df.withColumn("_j", F.try_parse_json(F.when(F.col("_s").startswith("```"), seg).otherwise(F.col("_s"))))
    is_obj = F.coalesce(F.schema_of_variant(F.col("_j")).startswith("OBJECT"), F.lit(False))
    return df.withColumn("_v", F.when(is_obj, F.col("_j"))).drop("_s", "_seg", "_j")


def field_checks_cols(f: str, truth: Column) -> tuple[Column, Column]:
    """V5 from the projected ``pv_f`` / ``pt_f`` / ``pn_f`` columns:
    (value equal, predicted JSON null); a missing key is neither."""
    pv, ptype, pnull = F.col(f"pv_{f}"), F.col(f"pt_{f}"), F.col(f"pn_{f}")
    if f in NUMERIC_FIELDS:
        is_num = ptype.isin("BIGINT", "DOUBLE", "FLOAT", "INT") | ptype.startswith("DECIMAL")
        val_ok = is_num & (F.abs(F.variant_get(pv, "$", "double") - truth) < F.lit(TOLERANCE))
    else:
        val_ok = (ptype == "STRING") & (F.variant_get(pv, "$", "string") == truth)
    ok = F.when(truth.isNull(), pnull).otherwise(F.coalesce(val_ok, F.lit(False)))
    return ok, pnull


def with_field_parts(df: DataFrame, v: str = "_v") -> DataFrame:
    """Project the eight per-field variant values, then their types and
    JSON-null flags, each exactly once."""
    df = df.select("*", *[F.variant_get(F.col(v), f"$.{f}", "variant").alias(f"pv_{f}") for f in inv.ALL_FIELDS])
    return df.select("*", *[c for f in inv.ALL_FIELDS for c in (
        F.schema_of_variant(F.col(f"pv_{f}")).alias(f"pt_{f}"),
        F.coalesce(F.col(f"pv_{f}").isNotNull() & F.is_variant_null(F.col(f"pv_{f}")), F.lit(False))
        .alias(f"pn_{f}"))])


def field_checks(v: Column, f: str, truth: Column) -> tuple[Column, Column]:
    """V5 for one field straight from a parsed object (small inputs/tests)."""
    pv = F.variant_get(v, f"$.{f}", "variant")
    pnull = F.coalesce(pv.isNotNull() & F.is_variant_null(pv), F.lit(False))
    ptype = F.schema_of_variant(pv)
    if f in NUMERIC_FIELDS:
        is_num = ptype.isin("BIGINT", "DOUBLE", "FLOAT", "INT") | ptype.startswith("DECIMAL")
        val_ok = is_num & (F.abs(F.variant_get(pv, "$", "double") - truth) < F.lit(TOLERANCE))
    else:
        val_ok = (ptype == "STRING") & (F.variant_get(pv, "$", "string") == truth)
    ok = F.when(truth.isNull(), pnull).otherwise(F.coalesce(val_ok, F.lit(False)))
    return ok, pnull


def scored(spark: SparkSession, sf_dir: str, predictions: DataFrame | None = None) -> DataFrame:
    """V4 + V5 on every eval example: parsed flag and eight field booleans,
    plus per-row null-recall counters (parsed rows only)."""
    if predictions is None:
        return _scored_defects(spark, sf_dir)
    return _scored(spark, sf_dir, predictions)


def _scored_defects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir, None)


def _scored(spark: SparkSession, sf_dir: str, predictions: DataFrame | None) -> DataFrame:
    ex = inv.eval_examples(spark, sf_dir)
    truth = ex.select("example_id", "case", *[f"t_{f}" for f in inv.ALL_FIELDS])
    if predictions is None:
        # B7 predictions are a column of the example row: no join needed.
        return score(ex.select(*truth.columns, defect_raw().alias("raw")))
    return score(truth, predictions)


def score(truth: DataFrame, predictions: DataFrame | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """V4 + V5 for any truth table (example_id, case, t_<field> for the eight
    fields; NULL = expected null) and predictions (example_id, raw).  A
    missing prediction is a parse failure (left join, J2).  Without
    ``predictions`` the truth table must already carry ``raw``; further
    columns named in ``carry`` go along."""
    n_null = sum(F.when(F.col(f"t_{f}").isNull(), 1).otherwise(0) for f in inv.ALL_FIELDS)
    j = truth if predictions is None else truth.join(predictions, "example_id", "left")
    j = with_field_parts(with_parsed(j.withColumn("n_null_expected", n_null)))
    parsed = F.col("_v").isNotNull()
    out_cols = []
    for f in inv.ALL_FIELDS:
        t = F.col(f"t_{f}")
        ok, pnull = field_checks_cols(f, t)
        out_cols += [F.when(parsed, ok).alias(f"ok_{f}"),
                     F.when(parsed, t.isNull() & pnull).alias(f"nullok_{f}"),
                     F.when(parsed, t.isNotNull() & pnull).alias(f"halluc_{f}")]
    out = j.select("example_id", "case", *carry, "n_null_expected", parsed.alias("parsed"), *out_cols)
    all_ok = F.col("parsed")
    for f in inv.ALL_FIELDS:
        all_ok = all_ok & F.col(f"ok_{f}")
    return out.withColumn("all_ok", F.coalesce(all_ok, F.lit(False)))


def _int(c: Column) -> Column:
    return F.when(c, 1).otherwise(0)


def eval_case_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10 (+ O2): per case n, exact rate, parse failures, null recall,
    hallucinated-null rate, in the declared case order."""
    return case_report(scored(spark, sf_dir))


def case_report(sc: DataFrame) -> DataFrame:
    """A10 from a ``scored`` table."""
    p = F.col("parsed")
    null_ok = sum(_int(F.col(f"nullok_{f}")) for f in inv.ALL_FIELDS)
    halluc = sum(_int(F.col(f"halluc_{f}")) for f in inv.ALL_FIELDS)
    g = sc.groupBy("case").agg(
        F.count(F.lit(1)).alias("n"),
        F.count(F.when(~p, F.lit(1))).alias("parse_fail"),
        F.count(F.when(F.col("all_ok"), F.lit(1))).alias("all_fields_correct"),
        F.sum(F.when(p, F.col("n_null_expected")).otherwise(0)).alias("null_expected"),
        F.sum(F.when(p, null_ok).otherwise(0)).alias("null_correct"),
        F.sum(F.when(p, F.lit(len(inv.ALL_FIELDS)) - F.col("n_null_expected")).otherwise(0)).alias("value_expected"),
        F.sum(F.when(p, halluc).otherwise(0)).alias("hallucinated_null"))
    order = F.array(*[F.lit(c) for c in inv.EVAL_CASES])
    return g.select(
        "case", F.array_position(order, F.col("case")).cast("int").alias("case_pos"),
        "n", "parse_fail", "all_fields_correct", "null_expected", "null_correct",
        "value_expected", "hallucinated_null",
        F.try_divide(F.col("all_fields_correct").cast("double"), F.col("n").cast("double")).alias("exact"),
        F.try_divide(F.col("null_correct").cast("double"), F.col("null_expected").cast("double")).alias("null_recall"),
        F.try_divide(F.col("hallucinated_null").cast("double"), F.col("value_expected").cast("double"))
         .alias("halluc_null_rate")).orderBy("case_pos")


def eval_field_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per case and field, accuracy over parsed rows (divisor >= 1)."""
    return field_report(scored(spark, sf_dir))


def field_report(sc: DataFrame) -> DataFrame:
    """A11 from a ``scored`` table."""
    long = sc.select("case", "parsed", F.explode(F.array(*[
        F.struct(F.lit(f).alias("field"), F.col(f"ok_{f}").alias("ok")) for f in inv.ALL_FIELDS
    ])).alias("fo"))
    g = long.groupBy("case", F.col("fo.field").alias("field")).agg(
        F.count(F.when(F.col("parsed"), F.lit(1))).alias("n_ok"),
        F.count(F.when(F.col("fo.ok"), F.lit(1))).alias("correct"))
    return g.select("case", "field", "n_ok", "correct",
                    (F.col("correct").cast("double") / F.greatest(F.col("n_ok"), F.lit(1)).cast("double"))
                    .alias("accuracy"))


def first_failures(spark: SparkSession, sf_dir: str, k: int = 3) -> DataFrame:
    """First three failures per case in example order, parse and value
    failures sharing one budget; the rank predicate is group-limited before
    the shuffle, so even the huge "clean" case moves only k rows per task."""
    return failure_rows(scored(spark, sf_dir), k)


def failure_rows(sc: DataFrame, k: int = 3) -> DataFrame:
    """W6 from a ``scored`` table."""
    sc = sc.withColumn("reason", F.when(F.col("parsed"), F.lit("value")).otherwise(F.lit("parse")))
    wrong = F.filter(F.array(*[F.when(~F.col(f"ok_{f}"), F.lit(f)) for f in inv.ALL_FIELDS]),
                     lambda x: x.isNotNull())
    # Failures sort first inside each case, so their row_number is their rank
    # among failures; filtering on all_ok *after* the window keeps Catalyst
    # from inlining the whole parse expression into a pushed-down filter.
    top = first_k(sc, "case", [F.col("all_ok"), F.col("example_id")], k).filter(~F.col("all_ok"))
    return top.select("case", "example_id", "reason", F.col("rk").alias("rank"),
                      F.array_join(wrong, ",").alias("wrong_fields"))


def failure_details(spark: SparkSession, sf_dir: str, k: int = 3) -> DataFrame:
    """W6 + F.18: the first failures of each case with the raw output, the
    text, and (field, got, want) of every wrong field."""
    ex = inv.eval_examples(spark, sf_dir)
    top = first_failures(spark, sf_dir, k).select(F.col("example_id").alias("failed_id"), "reason", "rank")
    return failures_of(ex.select("example_id", "case", "text", *[f"t_{f}" for f in inv.ALL_FIELDS], defect_raw().alias("raw")), top)


def failures_of(rows: DataFrame, top: DataFrame) -> DataFrame:
    """F.18 for the rows (example_id, case, text, raw, t_<field>) named in
    ``top (failed_id, reason, rank)``: k rows a case, few enough by that bound
    to go to the examples instead of the examples to them."""
    j = rows.join(F.broadcast(top), F.col("example_id") == F.col("failed_id"))
    j = with_field_parts(with_parsed(j))
    parts = []
    for f in inv.ALL_FIELDS:
        pv, ptype, truth = F.col(f"pv_{f}"), F.col(f"pt_{f}"), F.col(f"t_{f}")
        ok, _ = field_checks_cols(f, truth)
        number = F.try_variant_get(pv, "$", "double").cast("decimal(24,7)").cast("string")
        got = (F.when(pv.isNull(), F.lit("missing")).when(F.col(f"pn_{f}"), F.lit("null"))
               .when(ptype == "STRING", F.variant_get(pv, "$", "string")).otherwise(number))
        want = F.coalesce(truth.cast("decimal(24,7)").cast("string") if f in NUMERIC_FIELDS else truth, F.lit("null"))
        parts.append(F.when(F.col("_v").isNotNull() & ~ok, F.concat(F.lit(f"{f}: ("), got, F.lit(", "), want, F.lit(")"))))
    wrong = F.filter(F.array(*parts), lambda x: x.isNotNull())
    return j.select("case", "example_id", "rank", "reason", "raw", "text", F.array_join(wrong, "; ").alias("wrong"))


# ------------------------------------------------------------------ J2

UNKNOWN_CASE = "(unknown)"


def logged_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A predictions log (seq, example_id, raw) as a batch run leaves it: ids
    divisible by 7 are missing, those divisible by 11 were first answered with
    broken output and then again, and for those divisible by 13 there is one
    more answer under an id that no example has."""
    p = defect_predictions(inv.eval_examples(spark, sf_dir)).where(F.pmod("example_id", F.lit(7)) != 0)
    one = F.struct(F.lit(1).cast("bigint").alias("seq"), F.col("example_id").alias("id"), F.col("raw").alias("answer"))
    first = F.struct(F.lit(0).cast("bigint").alias("seq"), F.col("example_id").alias("id"), F.lit("{broken").alias("answer"))
    other = F.struct(F.lit(1).cast("bigint").alias("seq"), (-1 - F.col("example_id")).alias("id"), F.col("raw").alias("answer"))
    rows = F.filter(F.array(one, F.when(F.pmod("example_id", F.lit(11)) == 0, first), F.when(F.pmod("example_id", F.lit(13)) == 0, other)),
                    lambda x: x.isNotNull())
    return p.select(F.explode(rows).alias("r")).select("r.seq", F.col("r.id").alias("example_id"), F.col("r.answer").alias("raw"))


def last_predictions(log: DataFrame) -> DataFrame:
    """One prediction per example, the one of the highest ``seq`` (ties:
    the greatest text), with the number of answers -- a partial aggregate."""
    return log.groupBy("example_id").agg(F.max_by("raw", F.struct("seq", "raw")).alias("raw"), F.count(F.lit(1)).alias("n_answers"))


def prediction_join_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J2 registered: the log scored against the truth; per case the examples
    without an answer (parse failures), those answered more than once, and the
    answers that belong to no example in a row of their own."""
    ex = inv.eval_examples(spark, sf_dir)
    return prediction_report(ex.select("example_id", "case", *[f"t_{f}" for f in inv.ALL_FIELDS]), logged_predictions(spark, sf_dir))


def prediction_report(truth: DataFrame, log: DataFrame) -> DataFrame:
    last = last_predictions(log)
    answered = truth.join(last, "example_id", "left")
    sc = score(answered, carry=("n_answers",))
    known = sc.groupBy("case").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("n_answers").isNull(), 1)).alias("n_missing"),
        F.count(F.when(F.col("n_answers") > 1, 1)).alias("n_repeated"), F.count(F.when(~F.col("parsed"), 1)).alias("parse_fail"),
        F.count(F.when(F.col("all_ok"), 1)).alias("all_fields_correct"))
    zero = F.lit(0).cast("bigint")
    unknown = (last.join(truth.select("example_id"), "example_id", "left_anti")
               .agg(F.lit(UNKNOWN_CASE).alias("case"), F.count(F.lit(1)).alias("n"), zero.alias("n_missing"),
                    F.count(F.when(F.col("n_answers") > 1, 1)).alias("n_repeated"), zero.alias("parse_fail"), zero.alias("all_fields_correct")))
    return known.unionByName(unknown)


def json_exact_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A12 + V6 + Z3 + F.18: per case, valid JSON and strictly correct
    outputs (key set equal to the eight fields and every value equal, no
    tolerance, no fence stripping)."""
    ex = inv.eval_examples(spark, sf_dir)
    j = ex.select("example_id", "case", *[f"t_{f}" for f in inv.ALL_FIELDS], defect_raw().alias("raw"))
    j = j.withColumn("_s", strip(F.coalesce(F.col("raw"), F.lit(""))))
    j = j.withColumn("_v", F.try_parse_json(F.col("_s")))
    keys = F.json_object_keys(F.col("_s"))
    keys_ok = F.coalesce(F.array_sort(keys) == F.array_sort(F.array(*[F.lit(f) for f in inv.ALL_FIELDS])),
                         F.lit(False))
    j = with_field_parts(j.withColumn("_keys_ok", keys_ok))
    same_all = F.lit(True)
    for f in inv.ALL_FIELDS:
        pv, ptype, truth = F.col(f"pv_{f}"), F.col(f"pt_{f}"), F.col(f"t_{f}")
        if f in NUMERIC_FIELDS:
            is_num = ptype.isin("BIGINT", "DOUBLE", "FLOAT", "INT") | ptype.startswith("DECIMAL")
            eq = is_num & (F.variant_get(pv, "$", "double") == truth)
        else:
            eq = (ptype == "STRING") & (F.variant_get(pv, "$", "string") == truth)
        same = F.when(truth.isNull(), F.col(f"pn_{f}")).otherwise(F.coalesce(eq, F.lit(False)))
        same_all = same_all & same
    exact = F.col("_v").isNotNull() & F.col("_keys_ok") & same_all
    return j.groupBy("case").agg(
        F.count(F.lit(1)).alias("n"),
        F.count(F.when(F.col("_v").isNotNull(), F.lit(1))).alias("valid_json"),
        F.count(F.when(exact, F.lit(1))).alias("fully_correct"))


def rule_predictor_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U1 end to end: the pluggable predictor (here the rule baseline) over
    Arrow batches as a column of the example, scored, A10 report."""
    ex = predicted(inv.eval_examples(spark, sf_dir))
    return case_report(score(ex.select("example_id", "case", *[f"t_{f}" for f in inv.ALL_FIELDS], "raw")))
