"""Sources and sinks: write, read back, compare."""

import os

import pytest
from pyspark.sql import functions as F

from tokenlake.operators import invoices as inv, telemetry as tel, tokens
from tokenlake.sources import files
from tokenlake.sources import fixtures as fx


def test_report_round_trip_equals_direct_comparison(spark, sf, scratch):
    hf = tel.hf_run_summary(spark, sf)
    cl = tel.client_run_summary(spark, sf)
    paths = {}
    for b in fx.BACKENDS:
        p = os.path.join(scratch, f"{b.replace(' ', '_').lower()}_res.json")
        src = hf if b == fx.BACKENDS[0] else cl.filter(F.col("backend") == b)
        files.report_sink(src, p)
        paths[b] = p
    paths["missing"] = os.path.join(scratch, "absent.json")          # skipped like the reference
    got = files.normalized_reports(files.report_scan(spark, paths), fx.BACKENDS)
    want = tel.backend_comparison(spark, sf)
    g = [(r.backend, r.report_pos, round(r.ttft, 9), round(r.tps, 9), round(r.vram, 9), float(r.gpu))
         for r in got.collect()]
    w = [(r.backend, r.report_pos, round(r.ttft, 9), round(r.tps, 9), round(r.vram, 9), float(r.gpu))
         for r in want.collect()]
    assert g == w
    text = open([os.path.join(paths["vLLM"], f) for f in os.listdir(paths["vLLM"])
                 if f.startswith("part-")][0]).read()
    assert text.startswith("{\n") and '"avg_power_watts"' in text   # indented, nulls kept


def test_jsonl_round_trip(spark, sf, scratch):
    rows = inv.chat_rows(spark, sf)
    path = os.path.join(scratch, "corpus")
    files.jsonl_sink(rows, path)
    back = files.jsonl_scan(spark, path)
    assert {"split=train", "split=validation"} <= set(os.listdir(path))
    a = rows.select("example_id", "split", F.col("completion")[0]["content"].alias("c"))
    b = back.select("example_id", "split", F.col("completion")[0]["content"].alias("c"))
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    raw = spark.read.text(os.path.join(path, "split=train")).first().value
    assert "\\u20ac" not in raw                                         # no ASCII escaping


def test_token_csv_round_trip(spark, sf, scratch):
    d = tokens.doc_ids(spark, sf).select("doc_id", "ids")
    path = os.path.join(scratch, "ids_csv")
    files.token_csv_sink(d.select("ids"), path)
    back = files.token_csv_scan(spark, path)
    assert sorted(map(tuple, (r.ids for r in back.collect()))) == sorted(map(tuple, (r.ids for r in d.collect())))
    tail = files.token_csv_scan(spark, path, max_input_length=5).collect()
    assert all(len(r.ids) <= 5 for r in tail)


def test_tensor_chunks_round_trip(spark, sf, scratch):
    """Ids, logits (rank 2) and log-probs of unequal length; whole, by slice, and from single positions."""
    d = tokens.doc_ids(spark, sf).select("doc_id", "ids", F.transform("ids", lambda x: x / 7.0).alias("logprobs"),
                                         F.transform(F.slice("ids", 1, 40), lambda x: F.array(x / 2.0, x / 3.0, x / 5.0)).alias("logits"))
    want = {r.doc_id: r for r in d.collect()}
    path = os.path.join(scratch, "tensors")
    chunks = files.tensor_chunks(d, "doc_id", ["ids", "logprobs", "logits"], chunk=64)
    assert chunks.agg(F.max(F.size("values"))).first()[0] == 64
    files.tensor_sink(chunks, path)
    for name in ("ids", "logprobs", "logits"):
        back = {r.key: r for r in files.tensor_slice(spark, path, name, chunk=64).collect()}
        assert set(back) == set(want)
        for k, r in back.items():
            whole = want[k][name]
            assert r["values"] == [x for row in whole for x in row] if name == "logits" else r["values"] == whole
            assert r["shape"] == ([len(whole), 3 if whole else 0] if name == "logits" else [len(whole)])
    part = {r.key: r["values"] for r in files.tensor_slice(spark, path, "logprobs", 70, 140, chunk=64).collect()}
    assert part == {k: r.logprobs[70:140] for k, r in want.items() if len(r.ids) > 64}       # those with a chunk there
    assert any(len(v) == 70 for v in part.values())
    long = d.select(F.lit("ids").alias("tensor"), F.col("doc_id").alias("key"), F.posexplode("ids").alias("pos", "value"))
    shapes = d.select(F.lit("ids").alias("tensor"), F.col("doc_id").alias("key"), F.array(F.size("ids")).alias("shape"))
    a = files.tensor_chunks_of_values(long, shapes, chunk=64)
    b = chunks.where("tensor = 'ids' and size(values) > 0").select(*a.columns)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_report_sink_refuses_more_than_one_row(spark, scratch):
    with pytest.raises(ValueError):
        files.report_sink(spark.range(2), os.path.join(scratch, "two"))


def _lines(n, tag):
    return [f"{tag} {i} " + "x" * (i * 37 % 211) if i % 17 else "" for i in range(n)]


@pytest.mark.parametrize("parts", [1, 7, 64])
def test_numbered_lines_by_any_split(spark, scratch, parts):
    """Two files, read in blocks of three sizes: the same ids, lines of one file, then of the other."""
    folder = os.path.join(scratch, f"lines{parts}")
    os.mkdir(folder)
    texts = {"a.txt": _lines(3000, "a"), "b.txt": _lines(1111, "b")}
    for name, lines in texts.items():
        with open(os.path.join(folder, name), "w") as f:
            f.write("\n".join(lines) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    size = sum(os.path.getsize(os.path.join(folder, n)) for n in texts)
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size // parts + 1))
        spark.conf.set("spark.sql.files.openCostInBytes", "64")
        rows = files.numbered_lines(spark, folder)
        got = sorted((r.line_id, os.path.basename(r.file), r.line_no, r.value) for r in rows.collect())
        n = spark.read.text(folder).rdd.getNumPartitions()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    want = [(name, i, line) for name, lines in texts.items() for i, line in enumerate(lines)]
    assert [x[1:] for x in got] == want and [x[0] for x in got] == list(range(len(want)))
    assert n >= min(parts, 2)


def test_lines_of_two_files_are_paired_by_number(spark, scratch):
    left, right = _lines(500, "in"), _lines(420, "out")
    for name, lines in (("left.txt", left), ("right.txt", right)):
        with open(os.path.join(scratch, name), "w") as f:
            f.write("\n".join(lines) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
        rows = files.zip_lines(spark, os.path.join(scratch, "left.txt"), os.path.join(scratch, "right.txt"), "\n").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted((r.line_id, r.left, r.right) for r in rows) == [(i, x, right[i] if i < 420 else None) for i, x in enumerate(left)]


def test_gpu_csv_file_scan(spark, sf, scratch):
    lines = tel.gpu_csv_lines(spark, sf).select(F.col("line").alias("value"))
    path = os.path.join(scratch, "smi")
    lines.write.text(path)
    back = files.gpu_csv_scan(spark, path)
    assert back.agg(F.max("used_mib")).first()[0] == \
        tel.gpu_csv_scan(spark, sf).agg(F.max("peak_used_mib")).first()[0]


def test_prompt_lines_scan(spark, scratch):
    path = os.path.join(scratch, "prompts.txt")
    with open(path, "wb") as f:
        f.write(b"first prompt\nbad \xff byte\nthird\n")
    got = [r.prompt for r in files.prompt_lines_scan(spark, path).orderBy("line_id").collect()]
    assert got[0] == "first prompt" and got[2] == "third" and "�" in got[1]
