"""Invariants of SURVEY 5 (ours, item 3-5)."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from tokenlake.operators import chat, invoices as inv, sqlcorpus, telemetry as tel
from tokenlake.operators.ordered import sequence_scan
from tokenlake.sources import fixtures as fx


def test_gaps_per_request_equal_tokens_minus_one(spark, sf):
    gaps = tel.inter_token_gaps(spark, sf).groupBy("request_id").count()
    base = tel.request_base(spark, sf).select("request_id", "n_tokens")
    j = base.join(gaps, "request_id", "left").fillna(0, ["count"])
    bad = j.filter(F.col("count") != F.greatest(F.col("n_tokens") - 1, F.lit(0)))
    assert bad.count() == 0


@pytest.mark.parametrize("bucket", [60, 3600, 86400 * 40])
def test_sequence_scan_independent_of_bucket_width(spark, sf, bucket):
    ev = fx.events(spark, sf).withColumnRenamed("user_id", "request_id")
    te = (sequence_scan(ev, "request_id", "ts", "event_id", bucket_seconds=bucket, idx="token_idx", prev_ts="prev_ts")
          .select("request_id", "event_id", "token_idx", "prev_ts"))
    ref = fx.token_events(spark, sf).select("request_id", "event_id", "token_idx", "prev_ts")       # prefix scan
    assert te.exceptAll(ref).count() == 0 and ref.exceptAll(te).count() == 0


@pytest.mark.parametrize("parts", [1, 7, 64])
def test_same_result_for_any_partitioning(spark, sf, parts):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        a5 = sorted(tuple(r) for r in tel.concurrency_summary(spark, sf).collect())
        w5 = tel.running_peak(spark, sf).agg(F.sum("running_peak_mib")).collect()[0][0]
        ex = sorted(tuple(r) for r in inv.case_examples(spark, sf).select("example_id", "label_text").collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert a5 == sorted(tuple(r) for r in tel.concurrency_summary(spark, sf).collect())
    assert w5 == tel.running_peak(spark, sf).agg(F.sum("running_peak_mib")).collect()[0][0]
    assert ex == sorted(tuple(r) for r in inv.case_examples(spark, sf).select("example_id", "label_text").collect())


def test_running_sum_matches_window(spark, sf):
    from pyspark.sql import Window
    d = chat.dialogs(spark, sf).withColumn("L", F.length("content"))
    a = sequence_scan(d, "conv_id", "turn", "turn", idx=None, prev_ts=None, running_sum="L",
                      running_sum_out="s", bucket_col=F.floor(F.col("turn") / 2))
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    b = d.withColumn("s", F.coalesce(F.sum("L").over(w), F.lit(0)))
    assert a.select("conv_id", "turn", "s").exceptAll(b.select("conv_id", "turn", "s")).count() == 0


def test_corruption_changes_exactly_k_positions(spark, sf):
    ex = inv.examples(spark, sf).filter(F.col("label_field").isNotNull()
                                        & F.col("case").isin("accepted_corrupted_label",
                                                             "rejected_corrupted_or_unlabeled"))
    vocab = set(inv.label_vocab_lower())
    n = 0
    for r in ex.select("case", "field", "label_text").collect():
        orig = inv.LABELS[r.field]
        assert len(orig) == len(r.label_text)
        ham = sum(a != b for a, b in zip(orig, r.label_text))
        k = 1 if r.case == "accepted_corrupted_label" else 3
        assert ham == min(k, len(orig))                           # distinct positions, different chars
        assert r.label_text.lower() not in vocab                  # J8 rejection
        n += 1
    assert n > 0


def test_aliases_come_from_vocabulary(spark, sf):
    ex = inv.examples(spark, sf).filter(F.col("case") == "label_format_variation")
    for r in ex.select("field", "label_text").collect():
        assert r.label_text in inv.ALIASES[r.field]


def test_shuffled_lines_same_multiset(spark, sf):
    ev = inv.eval_examples(spark, sf).filter(F.col("case") == inv.HARD_CASE).select("example_id", "text")
    clean = inv.examples(spark, sf).select("example_id", F.col("text").alias("orig"))
    for r in ev.join(clean, "example_id").collect():
        a = [l for l in r.text.split("\n") if l.strip()]
        b = [l for l in r.orig.split("\n") if l.strip()]
        assert Counter(a) == Counter(b) and r.text.endswith("\n")


def test_split_sums_to_total(spark, sf):
    cc = inv.case_counts(spark, sf).collect()
    assert all(r.matches for r in cc)
    total = inv.examples(spark, sf).count()
    assert sum(r.n for r in cc) == total


def test_mixture_exact_counts(spark):
    m = inv.mixture_plan(spark).groupBy("split", "case").count().collect()
    got = {(r.split, r.case): r["count"] for r in m}
    assert sum(v for (s, _), v in got.items() if s == "train") == 1305
    assert sum(v for (s, _), v in got.items() if s == "validation") == 145
    assert [got[("train", c)] for c, _ in inv.CASE_MIXTURE] == [675, 180, 135, 135, 180]
    assert [got[("validation", c)] for c, _ in inv.CASE_MIXTURE] == [75, 20, 15, 15, 20]


def test_invoice_truth_domains(spark):
    t = inv.invoice_truth(spark.range(2000), "id", seed=123)
    r = t.agg(F.min("subtotal_cents"), F.max("subtotal_cents"), F.min("tax_pct"), F.max("tax_pct"),
              F.min("invoice_date"), F.max("invoice_date"),
              F.sum((F.col("subtotal_cents") + F.col("tax_cents") != F.col("total_cents")).cast("int"))).collect()[0]
    assert 100 <= r[0] and r[1] <= 1_000_000
    assert r[2] >= 5 and r[3] <= 20
    assert str(r[4]) >= "2024-03-09" and str(r[5]) <= "2026-12-03"   # 2024-03-08 + 1000 d
    assert r[6] == 0                                               # V2 on all rows
    prefixes = {x[0].split("-")[0] for x in t.select("invoice_number").collect()}
    assert prefixes <= set(inv.NUMBER_PREFIXES)


def test_perfect_predictor_is_exact(spark, sf):
    from tokenlake.operators import evaluate as ev
    ex = inv.eval_examples(spark, sf)
    perfect = ex.filter(F.pmod("example_id", F.lit(10)) == 0).select(
        "example_id", ev.defect_raw().alias("raw"))
    sc = ev.scored(spark, sf, perfect).filter(F.pmod("example_id", F.lit(10)) == 0)
    assert sc.filter(~F.col("all_ok")).count() == 0


def test_rule_predictor_runs_batched(spark, sf):
    from tokenlake.operators import evaluate as ev
    rep = {r.case: r for r in ev.rule_predictor_report(spark, sf).collect()}
    assert rep["clean"].all_fields_correct == rep["clean"].n and rep["clean"].exact == 1.0   # clean texts fully extracted


def test_sft_contract_flags_negative_rows(spark, sf):
    rows = inv.chat_rows(spark, sf)
    bad = rows.withColumn("completion", F.array(F.struct(F.lit("assistant").alias("role"),
                                                         F.lit('{"a": 1}').alias("content"))))
    from tokenlake.operators.invoices import ALL_FIELDS, _arr
    keys = F.json_object_keys(F.col("completion")[0]["content"])
    ok = F.coalesce(F.array_sort(keys) == F.array_sort(_arr(ALL_FIELDS)), F.lit(False))
    assert bad.filter(ok).count() == 0
    assert all(r.n_violations == 0 for r in inv.sft_contract(spark, sf).collect())


def test_sql_dialog_generator(spark):
    d = sqlcorpus.sql_dialogs(spark)
    assert d.count() == 200
    r = d.filter((F.col("i") == 3) & (F.col("table") == "orders")).collect()[0]
    assert r.schema == "orders_4(order_id, customer_id, order_date, amount, status)"
    assert r.turns[3].a == ("SELECT * FROM orders_4 WHERE status = 'Completed' AND amount > 100 "
                            "AND YEAR(order_date) = 2024;")
    m = sqlcorpus.dialog_flatten(d).filter(F.col("i") == 0).select("messages").first().messages
    assert len(m) == 8 and m[0].content.startswith(r"users(") and "\n\nShow all records" in m[0].content
    assert m[2].content == "Only where country is 'USA'."


def test_chatml_pair(spark):
    df = spark.createDataFrame([("Book a flight", '{"function": "book"}')], "instruction string, response string")
    p, c = sqlcorpus.chatml_pair(F.col("instruction"), F.col("response"))
    r = df.select(p.alias("p"), c.alias("c")).first()
    assert r.p == "<|im_start|>user\nBook a flight<|im_end|>\n<|im_start|>assistant\n"
    assert r.c == '{"function": "book"}<|im_end|>'


def test_assistant_spans_cover_assistant_text(spark, sf):
    r = chat.chatml_render(spark, sf).select("conv_id", "rendered")
    s = chat.assistant_spans(spark, sf)
    d = chat.dialogs(spark, sf).filter(F.col("role") == "assistant").select("conv_id", "turn", "content")
    j = s.join(d, ["conv_id", "turn"]).join(r, "conv_id")
    bad = j.filter(F.substring("rendered", F.col("span_start") + 1, F.col("span_end") - F.col("span_start"))
                   != F.col("content"))
    assert bad.count() == 0


def test_mask_gate(spark, sf):
    c = chat.completion_labels(spark, sf)
    for r in c.collect():
        assert r.mask_ok == (r.n_prompt_tokens >= 10 and r.n_completion_tokens > 0)
