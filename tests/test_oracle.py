"""Every registered query against its DuckDB oracle (driver contract)."""

import duckdb
import pytest

import __spark_entry__ as E
from tokenlake.sources.tables import TABLES
from tools.oracle_check import rows_of

ORACLE = E.oracle_sql()
QUERIES = E.queries()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def test_contract_keys():
    assert set(ORACLE) <= set(QUERIES)
    assert len(QUERIES) >= 60


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["concurrency", "avg_ttft", "avg_inter_token_latency", "failure_rate", "num_requests"]
    assert df.count() > 0


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_oracle(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    srows = df.collect()
    cur = duck.execute(ORACLE[name])
    dcols = [d[0] for d in cur.description]
    drows = cur.fetchall()
    assert sorted(df.columns) == sorted(dcols)
    assert len(srows) == len(drows)
    assert rows_of(df.columns, srows, True) == rows_of(dcols, drows, True)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs_without_oracle(spark, sf, name):
    assert QUERIES[name](spark, sf).count() >= 0


SPARK_TO_DUCK = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
                 "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "date": "DATE", "float": "FLOAT"}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_oracle_column_types_match(spark, sf, duck, name):
    st = dict(QUERIES[name](spark, sf).dtypes)
    rel = duck.sql(ORACLE[name])
    dt = dict(zip(rel.columns, [str(t) for t in rel.types]))
    assert {c: SPARK_TO_DUCK.get(t, t.upper()) for c, t in st.items()} == dt
