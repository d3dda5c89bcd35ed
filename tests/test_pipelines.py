"""End-to-end jobs write their reports; the persisted evaluation equals the
registered queries."""

from pyspark.sql import functions as F

from tokenlake.operators import evaluate as ev
from tokenlake.plans import pipelines


def test_run_evaluation_matches_queries(spark, sf, scratch):
    outs = pipelines.run_evaluation(spark, sf, scratch)
    case = spark.read.parquet(outs["case_report"]).select("case", "n", "parse_fail", "all_fields_correct")
    want = ev.eval_case_report(spark, sf).select("case", "n", "parse_fail", "all_fields_correct")
    assert case.exceptAll(want).count() == 0 and want.exceptAll(case).count() == 0
    fails = spark.read.parquet(outs["failures"]).select("case", "example_id")
    want_f = ev.first_failures(spark, sf).select("case", "example_id")
    assert fails.exceptAll(want_f).count() == 0
    assert spark.read.parquet(outs["field_report"]).count() == ev.eval_field_report(spark, sf).count()


def test_run_corpus_and_comparison(spark, sf, scratch):
    outs = pipelines.run_corpus(spark, sf, scratch)
    assert spark.read.parquet(outs["arith"]).agg(F.sum("n_violations")).first()[0] == 0
    cmp = pipelines.run_backend_comparison(spark, sf, scratch)
    assert [r.backend for r in spark.read.parquet(cmp["comparison"]).orderBy("report_pos").collect()] == \
        ["Hugging Face", "vLLM", "SGLang"]
