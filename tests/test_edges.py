"""Edge cases of SURVEY 0.1 / 0.2 on tiny literal frames."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tokenlake.functions.common import array_tail, token_estimate, truncate_label
from tokenlake.operators import chat
from tokenlake.operators import evaluate as ev
from tokenlake.operators import sse


def _lines(spark, items):
    return spark.createDataFrame(items, "request_id long, line_no int, line string")


def test_sse_parse_edges(spark):
    # blank, comment, bad JSON, role-only, content, two usages, [DONE], after-done
    items = [
        (1, 0, 'data: {"choices":[{"index":0,"delta":{"role":"assistant"}}]}'),
        (1, 1, ""),
        (1, 2, ": keep-alive"),
        (1, 3, 'data: {"choices": ['),
        (1, 4, 'data: {"choices":[{"index":0,"delta":{"content":"Hi"}}]}\r'),
        (1, 5, 'data: {"choices":[{"index":0,"delta":{"content":""}}]}'),
        (1, 6, 'data: {"choices":[],"usage":{"completion_tokens":3}}'),
        (1, 7, 'data: {"choices":[],"usage":{"completion_tokens":7}}'),
        (1, 8, "data: [DONE]"),
        (1, 9, 'data: {"choices":[{"index":0,"delta":{"content":"late"}}]}'),
    ]
    p = sse.parse_lines(_lines(spark, items)).orderBy("line_no").collect()
    assert [r.line_no for r in p] == [0, 3, 4, 5, 6, 7]          # blank, comment, [DONE], after cut
    assert [r.valid for r in p] == [True, False, True, True, True, True]
    assert [r.content for r in p] == [None, None, "Hi", None, None, None]   # role-only / empty not content
    last = max((r for r in p if r.usage is not None), key=lambda r: r.line_no)
    assert last.usage == 7                                          # W8: last usage wins


def test_stream_without_content_has_no_ttft(spark):
    items = [(2, 0, 'data: {"choices":[{"index":0,"delta":{"role":"assistant"}}]}'), (2, 1, "data: [DONE]")]
    p = sse.parse_lines(_lines(spark, items))
    g = p.agg(F.min(F.when(F.col("content").isNotNull(), F.col("line_no"))).alias("first")).collect()[0]
    assert g.first is None                                          # trap 2 -> failed request


def _parse(spark, raws):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "i int, raw string")
    return [r.v for r in df.select("i", F.to_json(ev.parse_prediction(F.col("raw"))).alias("v"))
            .orderBy("i").collect()]


def test_prediction_parse(spark):
    out = _parse(spark, ['{"a": 1}', '```json\n{"a": 2}\n```', "```\n{\"a\": 3}\n```", "{bad",
                         "[1, 2]", "  {\"a\": 4}  ", None, "```"])
    assert out[0] == '{"a":1}'
    assert out[1] == '{"a":2}'                                      # fenced + json tag
    assert out[2] == '{"a":3}'                                      # fenced, no tag
    assert out[3] is None                                           # invalid JSON
    assert out[4] is None                                           # array is not an object
    assert out[5] == '{"a":4}'
    assert out[6] is None                                           # missing prediction
    assert out[7] is None


def test_field_compare_semantics(spark):
    df = spark.createDataFrame([
        ('{"total": 10.0000001}', 10.0, "tolerance"),
        ('{"total": 10.01}', 10.0, "off by a cent"),
        ('{"total": "10.0"}', 10.0, "string vs float"),
        ('{"total": true}', 1.0, "bool never equals a number"),
        ('{"total": null}', None, "null == null"),
        ('{}', None, "missing key is not null"),
        ('{"total": 10}', 10.0, "int equals float"),
    ], "raw string, truth double, what string")
    v = ev.parse_prediction(F.col("raw"))
    ok, pnull = ev.field_checks(v, "total", F.col("truth"))
    got = {r.what: (r.ok, r.pnull) for r in df.select("what", ok.alias("ok"), pnull.alias("pnull")).collect()}
    assert got["tolerance"] == (True, False)
    assert got["off by a cent"][0] is False
    assert got["string vs float"][0] is False
    assert got["bool never equals a number"][0] is False
    assert got["null == null"] == (True, True)
    assert got["missing key is not null"] == (False, False)
    assert got["int equals float"][0] is True


def test_scalar_helpers(spark):
    df = spark.createDataFrame([([1, 2, 3], "short", "x" * 40, "abcdefghij")],
                               "a array<int>, s string, long string, t string")
    r = df.select(array_tail("a", 2).alias("t2"), array_tail("a", 5).alias("t5"),
                  truncate_label("s").alias("s"), truncate_label("long").alias("l"),
                  token_estimate("t").alias("e"), token_estimate(F.lit("")).alias("e0")).collect()[0]
    assert r.t2 == [2, 3]
    assert r.t5 == [1, 2, 3]                                        # F.9: n > size keeps all
    assert r.s == "short"
    assert r.l == "x" * 25 + "..."
    assert r.e == 2 and r.e0 == 1                                    # F.8 floor at 1


def test_request_profile_edges(spark, sf):
    from tokenlake.operators import telemetry as tel
    p = tel.request_profile(spark, sf)
    rows = {r.request_id: r for r in p.collect()}
    # status 500 requests are failed (trap 1) and excluded from means
    for rid, r in rows.items():
        assert r.ok == (r.http_status == 200 and r.n_tokens >= 1)
        if rid % 17 == 0:
            assert r.http_status == 500 and r.ok is False
        if rid % 13 == 0:
            assert r.usage_tokens == 0                              # usage 0 -> 100 in both client rates
    a5 = tel.concurrency_summary(spark, sf).collect()
    assert sum(r.num_requests for r in a5) == len(rows)
    for r in a5:
        assert 0.0 <= r.failure_rate <= 1.0


def test_empty_group_nulls(spark):
    from tokenlake.operators.telemetry import _div
    df = spark.createDataFrame([(0, 0)], "a long, b long")
    assert df.select(_div(F.col("a"), F.col("b")).alias("x")).collect()[0].x is None   # F.20 / trap 3


def test_timestamps_are_ntz_and_micros_exact(spark):
    from tokenlake.functions.common import micros
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1, 0, 0, 1, 5),)], "ts timestamp_ntz")
    assert df.select(micros("ts").alias("u")).collect()[0].u == 1704067201000005


def _events(spark, rows):
    return spark.createDataFrame(
        [(r, e, dt.datetime(2024, 1, 1, 0, 0, s), t) for r, e, s, t in rows],
        "request_id long, event_id long, ts timestamp_ntz, text string")


def test_one_token_request(spark):
    from tokenlake.operators import telemetry as tel
    # request 1: prompt + one token; request 2: prompt only (no content -> failed)
    ev = _events(spark, [(1, 1, 0, "prompt"), (1, 2, 2, "tok"), (2, 3, 0, "prompt")])
    attributes = spark.createDataFrame([(1, "vLLM", 2, 200, 1), (2, "vLLM", 4, 200, None)],
                                       "request_id long, backend string, concurrency int, http_status int, usage_tokens long")
    b = tel.request_metrics(ev, attributes)
    p = {r.request_id: r for r in tel.profile_of(b).collect()}
    assert p[1].n_tokens == 1 and p[1].ok and p[1].ttft_content == 2.0
    assert p[1].decode_tps_excl_first is None                 # needs a token after the first
    assert p[1].second_token_latency is None
    assert p[2].ok is False and p[2].ttft_content is None     # trap 2
    a5 = tel.concurrency_of(b).collect()
    by_level = {r.concurrency: r for r in a5}
    # request 1 has no gaps: pooled gap mean of its level is NULL (trap 3, sweep keeps NULL)
    assert by_level[2].avg_inter_token_latency is None and by_level[2].avg_ttft == 2.0
    assert by_level[4].failure_rate == 1.0 and by_level[4].avg_ttft is None


def test_ttft_variants_are_measured_apart(spark):
    """Blank chunks before the first content, with and without a logged send time, and an empty prompt text."""
    from tokenlake.operators import telemetry as tel
    ev = _events(spark, [(1, 1, 2, "prompt"), (1, 2, 5, ""), (1, 3, 6, None), (1, 4, 7, ""), (1, 5, 9, "tok"), (1, 6, 10, "tok"),
                         (2, 1, 3, ""), (2, 2, 7, ""), (2, 3, 8, "tok"), (3, 1, 0, "prompt"), (3, 2, 4, "")])
    attributes = spark.createDataFrame([(1, "vLLM", 1, 200, 2, dt.datetime(2024, 1, 1)), (2, "vLLM", 1, 200, 2, None), (3, "vLLM", 1, 200, 2, None)],
                                       "request_id long, backend string, concurrency int, http_status int, usage_tokens long, sent_ts timestamp_ntz")
    b = tel.request_metrics(ev, attributes)
    got = {r.request_id: (r.ttft_prompt_relative, r.ttft_any_chunk, r.ttft_content, r.total_s) for r in tel.profile_of(b).collect()}
    assert got == {1: (3.0, 5.0, 9.0, 10.0), 2: (4.0, 4.0, 5.0, 5.0), 3: (4.0, 4.0, None, 4.0)}
    w10 = tel.cold_hot_of(b.withColumn("system_prompt", F.lit("p"))).collect()
    assert {(r.run_label, r.n, r.avg_ttft) for r in w10} == {("RUN 1 - COLD", 1, 5.0), ("RUN 2 - HOT", 2, 4.0)}


def test_reports_on_a_log_with_role_only_chunks(spark):
    """A1, A4 and A5 by the formulas of SURVEY 0.1, worked out by hand: content TTFT, gaps between chunks with text, no content is failed."""
    from tokenlake.operators import telemetry as tel
    ev = _events(spark, [(1, 1, 0, "prompt"), (1, 2, 1, None), (1, 3, 3, "a"), (1, 4, 4, ""), (1, 5, 7, "b"), (1, 6, 9, "c"), (1, 7, 11, ""),
                         (2, 1, 0, "prompt"), (2, 2, 2, ""), (2, 3, 6, "a"), (2, 4, 8, "b"),
                         (3, 1, 0, "prompt"), (3, 2, 1, ""), (3, 3, 5, None),
                         (4, 1, 0, "prompt"), (4, 2, 4, "a")])
    attributes = spark.createDataFrame([(1, "vLLM", 8, 200, 3), (2, "vLLM", 8, 200, 2), (3, "vLLM", 8, 200, 2), (4, "SGLang", 8, 500, 1)],
                                       "request_id long, backend string, concurrency int, http_status int, usage_tokens long")
    b = tel.request_metrics(ev, attributes)
    p = {r.request_id: r for r in tel.profile_of(b).collect()}
    assert {i: (r.ok, r.ttft_any_chunk, r.ttft_content) for i, r in p.items()} == {
        1: (True, 1.0, 3.0), 2: (True, 2.0, 6.0), 3: (False, 1.0, None), 4: (False, 4.0, 4.0)}
    assert p[1].decode_tps_usage_minus1 == 2 / 8 and p[2].decode_tps_usage_minus1 == 1 / 2
    (a5,) = tel.concurrency_of(b).collect()
    assert (a5.avg_ttft, a5.avg_inter_token_latency, a5.failure_rate, a5.num_requests) == (4.5, (6 + 2) / 3, 0.5, 4)
    hosts = spark.createDataFrame([("vLLM", 0), ("SGLang", 1)], "backend string, host int")
    samples = spark.createDataFrame([(0, 0, 2**30, 50, 1000), (0, 1, 2**33, 99, 9000)],
                                    "host int, gpu_index int, used_bytes long, util_pct int, power_mw long")
    (a4,) = tel.client_summary_of(b, hosts, samples).collect()
    assert (a4.backend, a4.avg_ttft_sec, a4.avg_decode_tokens_per_sec, a4.peak_vram_gb, a4.avg_power_watts) == ("vLLM", 4.5, 0.375, 1.0, 1.0)


def test_parse_fail_only_case(spark, sf):
    from tokenlake.operators import evaluate as ev
    from tokenlake.operators import invoices as inv
    bad = inv.eval_examples(spark, sf).select("example_id", F.lit("{not json").alias("raw"))
    rep = ev.case_report(ev.scored(spark, sf, bad)).collect()
    for r in rep:
        assert r.parse_fail == r.n and r.all_fields_correct == 0 and r.exact == 0.0
        assert r.null_recall is None and r.halluc_null_rate is None   # empty denominators -> NULL
    fr = ev.field_report(ev.scored(spark, sf, bad)).collect()
    assert all(r.n_ok == 0 and r.accuracy == 0.0 for r in fr)        # divisor floored at 1


def test_missing_prediction_is_a_parse_failure(spark, sf):
    from tokenlake.operators import evaluate as ev
    from tokenlake.operators import invoices as inv
    none = inv.eval_examples(spark, sf).select("example_id", F.lit(None).cast("string").alias("raw")).limit(0)
    rep = ev.case_report(ev.scored(spark, sf, none)).collect()
    assert all(r.parse_fail == r.n for r in rep)                     # left join J2


def test_exact_split_has_exactly_the_share(spark):
    from tokenlake.functions.split import exact_split, split_hash
    for n in (0, 1, 19, 20, 997, 4000):
        for parts in (1, 7):
            df = spark.range(n).repartition(parts)
            out = exact_split(df, "id", 0.05)
            test = {r.id for r in out.where("is_test").collect()}
            assert len(test) == n // 20 and out.count() == n
            order = sorted((r.h, r.id) for r in df.select("id", split_hash("exact-split:42", F.col("id")).alias("h")).collect())
            assert test == {i for _, i in order[:n // 20]}


def test_loader_runs_once_per_worker(spark, sf, scratch):
    """More tasks and batches than workers: as many loads as processes."""
    import os
    from tokenlake.operators import evaluate as ev, invoices as inv
    log = os.path.join(scratch, "loads")

    def load():
        with open(log, "a") as f:
            f.write(f"{os.getpid()}\n")
        return ev.rule_predictor
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
        ex = inv.eval_examples(spark, sf).repartition(24)
        got = ev.predicted(ex, load).select("example_id", "raw")
        want = ev.batch_predict(ex)
        assert got.exceptAll(want).count() == 0 and got.count() == want.count()
        two = spark.createDataFrame([("a b",), (None,), ("c",)], "t string").repartition(3)
        counts = [chat.token_count_udf(load=lambda: (lambda t: t.split())), chat.token_count_udf(lambda t: list(t))]
        assert sorted(tuple(r) for r in two.select(counts[0]("t"), counts[1]("t")).collect()) == [(0, 0), (1, 1), (2, 3)]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    pids = open(log).read().split()
    assert len(pids) == len(set(pids))


def test_long_conversations_are_rendered_as_pieces(spark):
    """A conversation with a third of all rows: pieces with offsets from equal partitions; the assembled form refuses it."""
    rows = [(i % 40 if i % 3 else 1000, i, "user" if i % 2 else "assistant", f"turn {i} " + "w" * (i % 23)) for i in range(3000)]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, content string")
    pieces = d.select("conv_id", "turn", chat.turn_piece(F.col("role"), F.col("content")).alias("piece"))
    out = chat.piece_offsets(pieces)
    got = {}
    for r in sorted(out.collect(), key=lambda r: (r.conv_id, r.turn)):
        assert r.offset == len(got.get(r.conv_id, ""))
        got[r.conv_id] = got.get(r.conv_id, "") + r.piece
    whole = {r.conv_id: r.rendered for r in chat._assemble(pieces).collect()}
    assert got == whole
    sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) <= 2 * 3000 / int(spark.conf.get("spark.sql.shuffle.partitions"))
    with pytest.raises(Exception, match="conversation 1000 renders to"):
        chat._assemble(pieces, max_chars=len(got[1000]) - 1).collect()
    assert len(chat._assemble(pieces, max_chars=len(got[1000])).collect()) == len(got)


def test_predictions_that_miss_repeat_and_add_ids(spark):
    from tokenlake.operators import evaluate as ev, invoices as inv
    fields = {f"t_{f}": ("1.50" if f in ev.NUMERIC_FIELDS else f"v-{f}") for f in inv.ALL_FIELDS}
    truth = spark.range(6).select(F.col("id").alias("example_id"), F.lit("clean").alias("case"),
                                  *(F.lit(float(v) if k[2:] in ev.NUMERIC_FIELDS else v).alias(k) for k, v in fields.items()))
    good = "{" + ", ".join(f'"{f}": ' + ("1.5" if f in ev.NUMERIC_FIELDS else f'"v-{f}"') for f in inv.ALL_FIELDS) + "}"
    log = spark.createDataFrame([(0, 0, good), (0, 1, good), (1, 1, "{bad"), (0, 2, "{bad"), (1, 2, good), (0, 3, None), (0, 77, good), (1, 78, good), (2, 78, good)],
                                "seq long, example_id long, raw string")
    rows = {r.case: tuple(r)[1:] for r in ev.prediction_report(truth, log).collect()}
    assert rows == {"clean": (6, 2, 2, 4, 2), ev.UNKNOWN_CASE: (2, 0, 1, 0, 0)}
