"""Plans of the training-data queries and the pipeline."""

import pytest
from pyspark.sql.classic.dataframe import DataFrame
from pyspark.sql.readwriter import DataFrameWriter

import __spark_entry__ as E
from tokenlake.plans import catalog

ADDED = {k: fn for k, fn in E.queries().items() if k not in catalog.queries()}


@pytest.fixture(scope="module")
def static_spark(spark):
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")     # inspect the static plan
    yield spark
    spark.conf.set("spark.sql.adaptive.enabled", old)


@pytest.mark.parametrize("name", sorted(ADDED))
def test_no_nested_loop_or_cartesian_in_added_queries(static_spark, sf, name, monkeypatch):
    """The training-data queries and the pipeline: the plans of what they write and collect on the way, and of the result."""
    plans = []

    def noted(owner, method, frame):
        real = getattr(owner, method)

        def call(self, *args, **kwargs):
            plans.append(frame(self)._jdf.queryExecution().executedPlan().toString())
            return real(self, *args, **kwargs)
        monkeypatch.setattr(owner, method, call)
    noted(DataFrameWriter, "parquet", lambda w: w._df)
    for method in ("collect", "toArrow", "isEmpty"):
        noted(DataFrame, method, lambda df: df)
    ADDED[name](static_spark, sf).collect()
    assert plans and not any("BroadcastNestedLoopJoin" in p or "CartesianProduct" in p for p in plans)
