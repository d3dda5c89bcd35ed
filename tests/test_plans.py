"""Plan guards: the physical plans keep the shapes the scale design needs."""

import re

import pytest

from tokenlake.plans import catalog

QUERIES = catalog.queries()


def _plan(spark, sf, name):
    df = QUERIES[name](spark, sf)
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def static_spark(spark):
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")     # inspect the static plan
    yield spark
    spark.conf.set("spark.sql.adaptive.enabled", old)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_nested_loop_or_cartesian(static_spark, sf, name):
    p = _plan(static_spark, sf, name)
    assert "BroadcastNestedLoopJoin" not in p and "CartesianProduct" not in p


@pytest.mark.parametrize("name", ["a5_concurrency_summary", "a15_warm_mean_latency", "w6_first_failures",
                                  "w2_first_second_token"])
def test_first_k_is_limited_before_the_shuffle(static_spark, sf, name):
    p = _plan(static_spark, sf, name)
    partial = [m.start() for m in re.finditer(r"WindowGroupLimit .*Partial", p)]
    assert partial, p


@pytest.mark.parametrize("name,unread", [("a5_concurrency_summary", ["props", "value"]), ("a7_wall_clock", ["props", "value", "event_type"]),
                                         ("a6_batch_throughput", ["props", "value", "event_type"])])
def test_scan_prunes_columns(static_spark, sf, name, unread):
    """A5 is about chunks with text, so it reads the text; the wall-clock reports don't."""
    p = _plan(static_spark, sf, name)
    for line in p.split("\n"):
        if "FileScan parquet" in line:
            assert not any(c in line for c in unread)


def test_interval_join_is_an_equi_join(static_spark, sf):
    p = _plan(static_spark, sf, "a2_run_gpu_rollup")
    assert re.search(r"(BroadcastHashJoin|SortMergeJoin|ShuffledHashJoin) \[host#\d+, _jb#\d+L\]", p), p


def test_filters_reach_the_scan(static_spark, sf):
    p = _plan(static_spark, sf, "k2_progressive_where")
    assert "PushedFilters: [IsNotNull(o_orderstatus), EqualTo(o_orderstatus,F)" in p


PYTHON_NODES = ("ArrowEvalPython", "BatchEvalPython", "MapInPandas", "FlatMapGroupsInPandas",
                "PythonMapInArrow", "MapInArrow")


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"u1_rule_predictor"}))
def test_no_python_outside_the_predictor(static_spark, sf, name):
    p = _plan(static_spark, sf, name)
    assert not any(n in p for n in PYTHON_NODES), name


def test_predictor_runs_in_arrow_batches(static_spark, sf):
    p = _plan(static_spark, sf, "u1_rule_predictor")
    assert p.count("ArrowEvalPython") == 1 and "MapIn" not in p       # a column of the example: only the texts go to Python
