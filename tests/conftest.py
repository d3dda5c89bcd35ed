import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = os.environ.get("TOKENLAKE_TEST_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from tokenlake.session import DEFAULTS
    b = (SparkSession.builder.master("local[*]")
         .appName("tokenlake-tests")
         .config("spark.sql.shuffle.partitions", "8")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.driver.memory", "8g"))
    for k, v in DEFAULTS.items():
        b = b.config(k, v)
    s = b.getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    # tests are the one place that may pick a checkpoint folder themselves
    if not s.conf.get("spark.checkpoint.dir", None):
        d = tempfile.mkdtemp(prefix="tokenlake-ckpt-")
        s.conf.set("spark.checkpoint.dir", d)
    yield s


@pytest.fixture(scope="session")
def sf():
    return SF_SMALL


@pytest.fixture()
def scratch():
    return tempfile.mkdtemp(prefix="tokenlake-test-")


def rows(df, order=None):
    """Collected rows as sorted tuples (column order of ``df``)."""
    out = [tuple(r) for r in df.collect()]
    return sorted(out, key=repr)
