"""The invoice examples at size (findings F1, F2): dealt evenly, cheap per row, the same draws as ever."""

import hashlib
import json
import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tokenlake.functions.draws import draw, draw_at, hex_at, stem
from tokenlake.operators import evaluate as evl
from tokenlake.operators import invoices as inv


@pytest.fixture()
def one_file(spark, scratch):
    """``orders`` as a single file with a single row group: one task reads it all."""
    spark.range(400).selectExpr("id o_orderkey", "id % 37 o_custkey", "100.0 + id o_totalprice", "timestamp'2024-01-05 00:00:00' o_orderdate") \
         .coalesce(1).write.parquet(f"{scratch}/orders.parquet")
    return scratch


@pytest.mark.parametrize("made", [inv.chat_rows, inv.eval_examples, lambda s, d: evl.predicted(inv.eval_examples(s, d))])
def test_examples_are_dealt_over_all_shuffle_partitions(spark, one_file, made):
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sizes = [r["count"] for r in made(spark, one_file).groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert len(sizes) == parts and sum(sizes) == 400 and max(sizes) <= 2 * 400 / parts


def test_split_reads_the_ids_without_a_shuffle_of_rows(spark, one_file):
    plan = inv.chat_rows(spark, one_file)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Repartition") == 1                                  # the examples, not their keys
    keys = {tuple(r) for r in inv.example_keys(spark, one_file).select("example_id", "case").collect()}
    assert keys == {tuple(r) for r in inv.examples(spark, one_file).select("example_id", "case").collect()}


def _draw(*key) -> int:
    return int(hashlib.md5(":".join(map(str, key)).encode()).hexdigest()[:8], 16)


def _corrupted(label, k, key, salt):
    """J8 in plain Python, as far as the free attempts go."""
    pool, vocab = inv.CORRUPTION_POOL, set(inv.label_vocab_lower())
    for a in range(1, inv.CORRUPT_ATTEMPTS + 1):
        made = list(label)
        for _, i in sorted((_draw("corrupt:pos", key, salt, a, i), i) for i in range(len(label)))[:k]:
            ci = pool.find(label[i])
            j = _draw("corrupt:chr", key, salt, a, i) % (61 if ci >= 0 else 62)
            made[i] = pool[j + 1 if 0 <= ci <= j else j]
        if "".join(made).lower() not in vocab:
            return "".join(made)
    return None


@pytest.mark.parametrize("k,salt", [(1, "c1"), (3, "c3")])
def test_corrupted_labels_follow_the_draws(spark, k, salt):
    rows = [(i, label) for i in range(40) for label in [*inv.LABELS.values(), "Sub-Total", "No"]]
    df = spark.createDataFrame(rows, "key long, label string")
    for r in df.withColumn("got", inv.corrupt_label(F.col("label"), F.lit(k), F.col("key"), F.lit(salt))).collect():
        want = _corrupted(r.label, k, r.key, salt)
        assert r.got == want or (want is None and r.got is not None)


def test_draw_in_two_parts(spark):
    df = spark.createDataFrame([(1, 2), (None, 3), (-7, 0)], "a long, b int")
    at = stem("x:1", "a")
    for r in df.select(draw("x:1", "a", "b").alias("d"), draw_at(at, F.col("b")).alias("e"), F.conv(hex_at(at, F.col("b")), 16, 10).cast("long").alias("h")).collect():
        assert r.d == r.e == r.h


def test_json_text_of_odd_strings(spark):
    odd = ["", "plain", 'a"b', "back\\slash", "tab\t nl\n", "\x00\x1f\x7f", "£ ₹ é  "]
    got = spark.createDataFrame([(x,) for x in [*odd, None]], "v string").select("v", inv._json_str(F.col("v")).alias("j")).collect()
    assert all(json.loads(r.j) == r.v for r in got)
    assert [r.j for r in got if r.v == "plain"] == ['"plain"'] and [r.j for r in got if r.v is None] == ["null"]


def _by_regex(text):
    """The label lines by one expression per field."""
    found = {}
    for f, canon in inv.LABELS.items():
        labels = "|".join(re.escape(x) for x in [canon, *inv.ALIASES[f]])
        m = re.search(rf"(?m)^[ \t]*(?:{labels})[ \t]*:[ \t]*(.*?)[ \t]*$", text)
        if m:
            found[f] = m[1]
    return found


def test_predictor_reads_odd_lines_as_the_expressions_did():
    odd = ["", "Acme Ltd.\n\nInvoice No. : INV-1 \nTotal:\t$1,234.50\t\nTotal Due: $9.00", " \n Vendor\r\nTax:\nTax: £5.00", "VAT : : €1.2.3\n",
           "a: b\nTotal: 12\rSubtotal: 3", "Invoice Number:  x \ntotal: 5", "GST:x\x0bTotal: ₹7.25", ": $1\nTotal $2"]
    assert [evl.labelled_values(x) for x in odd] == [_by_regex(x) for x in odd]
    read = [json.loads(x) for x in evl.rule_predictor(pd.Series([*odd, None]))]
    assert read[1] == dict(zip(inv.ALL_FIELDS, ["Acme Ltd.", "INV-1", None, None, "USD", None, None, 1234.5]))
    assert read[3]["tax"] is None and read[0] == read[-1] == dict.fromkeys(inv.ALL_FIELDS)
