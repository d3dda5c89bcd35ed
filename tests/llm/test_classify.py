"""Classifiers by held-out accuracy, quality rules against brute force."""

import collections
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tokenlake.llm import language, quality, rules, toxicity
from tokenlake.llm.common import documents
from tokenlake.llm.queries import QUERIES
from tokenlake.llm.words import word_blocks

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _held_out(rows, labels, parts, part):
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % parts == part)
        assert 0 <= r.score <= 1
    return [(r, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]


def test_op1_held_out(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = QUERIES["op1_nbsvm_quality"](spark, SF).collect()
    assert len({r.doc_id for r in rows}) == len(rows) == documents(spark, SF).count()
    held = _held_out(rows, labels, 4, 2)
    assert np.mean([r.predicted == y for r, y in held]) > 0.95
    assert all(r.predicted == (r.score >= 0.7) for r in rows)


def test_op7_held_out(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = QUERIES["op7_subword_toxicity"](spark, SF).collect()
    held = _held_out(rows, labels, 5, 0)
    assert np.mean([r.predicted == y for r, y in held]) > 0.9
    assert all(r.predicted == (r.score >= 0.5) for r in rows)


def test_op3_held_out(spark):
    langs = {r.doc_id: r.lang for r in documents(spark, SF, "doc_id", "lang").collect()}
    rows = QUERIES["op3_zstd_language"](spark, SF).collect()
    held = _held_out(rows, langs, 4, 2)
    assert np.mean([r.lang_pred == y for r, y in held]) > 0.96
    assert np.mean([r.rejected for r in rows]) < 0.1


@pytest.mark.parametrize("module,label", [(quality, "quality"), (toxicity, "toxic")])
def test_odd_training_sets(module, label, spark, odd_docs, no_docs):
    texts = pa.array(["good text here", "", None, "x" * 5000])
    for y, share in (([], None), ([1, 1], 1), ([0, 0], 0)):
        model = module.fit(pa.array(["a b c", "d e f"][:len(y)], pa.string()), np.array(y, np.int64))
        s = model.scores(texts)
        assert ((0 <= s) & (s <= 1)).all()
        if share is not None:
            assert (s.round() == share).all()
    model = module.fit(pa.array(["a b c", "d e f"] * 6), np.array([0, 1] * 6))
    rows = module.score(spark, odd_docs, model).collect()
    assert sorted(r.doc_id for r in rows) == list(range(16)) and all(0 <= r.score <= 1 for r in rows)
    by = {r.doc_id: r.score for r in rows}
    assert by[0] == by[1] == by[2] and by[5] == by[6] and by[4] == by[15]
    assert module.score(spark, no_docs, model).collect() == []


def test_toxic_misspelling_shares_ngrams():
    clean = [f"the weather in town {i} was calm and the river ran low" for i in range(60)]
    toxic = [f"you worthless {w} go away from town {i}" for i, w in enumerate(["disgusting", "pathetic", "worthless"] * 20)]
    model = toxicity.fit(pa.array([x for p in zip(clean, toxic) for x in p]), np.array([0, 1] * 60))
    bad, fine = model.scores(pa.array(["such a disgustinng patheticc day", "the river ran calm in town"]))
    assert bad > fine


def test_training_sample_is_bounded_by_label(spark):
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(50)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 5 == 0) for i in range(50)], "doc_id long, y boolean").selectExpr("doc_id", "int(y) toxic")
    rows = toxicity.training_sample(docs, labels, "toxic", 12).collect()
    assert len(rows) == 12 and sum(r.y for r in rows) == 6
    twice = labels.union(labels.selectExpr("doc_id", "1 - toxic").where("doc_id < 25")).union(labels)
    rows = toxicity.training_sample(docs, twice, "toxic", 100).collect()
    assert sorted((r.doc_id, r.y) for r in rows) == [(i, int(i % 5 == 0)) for i in range(25, 50)]


def test_trained_in_a_task_equals_the_function(spark):
    rows = [(i, f"{'bad worse worst' if i % 2 else 'fine good better'} text {i % 7}", i % 2) for i in range(40)]
    sample = spark.createDataFrame(rows, "doc_id long, text string, y long").repartition(5)
    texts = pa.array([t for _, t, _ in rows])
    for module in (quality, toxicity):
        here, there = module.fit(texts, np.array([y for _, _, y in rows])), toxicity.trained(sample, module.fit)
        assert (here.scores(texts) == there.scores(texts)).all()
    empty = toxicity.trained(sample.where("false"), toxicity.fit)
    assert (empty.scores(texts) < 0.5).all()


def test_punctuation_is_trimmed_at_any_length():
    words = ["plain", "..a..", "." * 300 + "b" + "!" * 500, "?" * 200, "x.y"]
    for _, _, block in word_blocks(pa.array([" ".join(words)])):
        starts, ends = toxicity._trimmed(block)
        assert [block.data[a:b].tobytes().decode() for a, b in zip(starts, ends)] == ["plain", "a", "b", "?", "x.y"]


def test_op3_odd_rows(spark, odd_docs, no_docs):
    model = language.fit(odd_docs)
    rows = {r.doc_id: r for r in language.identified(spark, odd_docs, model).collect()}
    assert [rows[i].lang_pred for i in (0, 1, 2)] == ["und"] * 3 and rows[0].score == 0.0
    assert all(rows[i].lang_pred in ("en", "de") for i in range(3, 16))
    assert language.fit(no_docs).samples == {}
    assert {r.lang_pred for r in language.identified(spark, odd_docs, language.fit(no_docs)).collect()} == {"und"}


def test_op3_uses_all_of_every_sampled_text(spark):
    """Equal texts count once; every part of every different one is in the dictionary, also in a large one."""
    rng = np.random.default_rng(3)
    texts = ["".join(map(chr, rng.integers(97, 123, 1500))) for _ in range(language.SAMPLE_DOCS)] + ["a common header"] * 200
    model = language.fit(spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string"))
    held = model.samples["en"].decode()
    assert sum(t in held for t in texts[:language.SAMPLE_DOCS]) >= language.SAMPLE_DOCS - 1 and held.count("header") <= 1
    large = rng.integers(97, 123, 3_000_000).astype(np.uint8).tobytes()
    model = language.Model({"x": large})
    for at in (0, 1_000_000, len(large) - 2000):
        assert model.sizes(large[at:at + 2000])[0] < 100 and model.sizes(large[at:at + 300])[0] < 50


def test_op3_sizes_equal_a_plain_compressor():
    import zstandard as zs
    rng = np.random.default_rng(5)
    words = ["".join(map(chr, rng.integers(97, 123, int(rng.integers(2, 9))))) for _ in range(400)]
    samples = {k: " ".join(rng.choice(words[i * 100:i * 100 + 200], 2000)).encode() for i, k in enumerate("abc")}
    model = language.Model(samples)
    for n in (3, 60, 400, 900):
        text = language.letters(" ".join(rng.choice(words, n)))
        pieces, level = ([text], language.SHORT_LEVEL) if len(text) <= language.SHORT else (
            [text[i:i + language.PIECE] for i in range(0, len(text), language.PIECE)], language.LEVEL)
        want = []
        for sample in samples.values():
            plain = zs.ZstdCompressor(level=level, dict_data=zs.ZstdCompressionDict(sample, dict_type=zs.DICT_TYPE_RAWCONTENT),
                                      write_content_size=False, write_checksum=False, write_dict_id=False)
            want.append(sum(len(plain.compress(p)) for p in pieces))
        got = model.sizes(text)
        assert np.abs(got - want).max() <= 0.05 * max(want) and got.argmin() == int(np.argmin(want))


def test_op3_dictionaries_have_equal_size_and_all_parts(spark):
    """A language of long texts gets no larger dictionary; every text is in it from its head to its end; a dirty lang column is refused."""
    rng = np.random.default_rng(1)
    long = ["".join(map(chr, rng.integers(97, 123, 20_000))) for _ in range(30)]
    rows = [(i, t, "long") for i, t in enumerate(long)] + [(100 + i, f"short text number {'abcdefgh'[i % 8] * (i + 1)}", "short") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    samples = language.fit(docs).samples
    assert len(samples["long"]) <= language.DICT_BYTES and len(samples["long"]) > 0.9 * language.DICT_BYTES
    for t in long:
        places = [t.find(samples["long"][i:i + 64].decode()) for i in range(0, len(samples["long"]) - 64, 64)]
        places = [p for p in places if p >= 0]
        assert min(places) < 4000 and max(places) > 16_000
    many = docs.withColumn("lang", F.col("doc_id").cast("string"))
    old, language.MAX_LANGUAGES = language.MAX_LANGUAGES, 10
    try:
        with pytest.raises(ValueError, match="different values of lang"):
            language.fit(many)
    finally:
        language.MAX_LANGUAGES = old


def test_op1_ratios_and_hinge_dual_equal_a_dense_solution():
    rng = np.random.default_rng(2)
    docs = [np.unique(rng.integers(0, 40, rng.integers(3, 15))).astype(np.int32) for _ in range(60)]
    labels = np.array([int((d < 18).mean() > 0.45) for d in docs])
    count = np.full((2, quality.FEATURES), quality.SMOOTH)
    for d, y in zip(docs, labels):
        for f in d:
            count[y, f] += 1
    want = np.log((count[1] / count[1].sum()) / (count[0] / count[0].sum()))
    ratio = quality.log_count_ratio(docs, labels)
    assert np.abs(ratio - want).max() < 1e-5
    rows = [(d, ratio[d].astype(np.float64) / np.linalg.norm(ratio[d])) for d in docs]
    w, bias = quality.dual_descent(rows, labels, rounds=2000)
    # the same dual, dense, by projected gradient steps
    x = np.zeros((len(docs), 41))
    for i, (f, v) in enumerate(rows):
        x[i, f] = v
    x[:, 40] = 1
    y = np.where(labels == 1, 1.0, -1.0)
    most = quality.COST * np.where(labels == 1, 0.5 / labels.mean(), 0.5 / (1 - labels.mean()))
    gram = (x @ x.T) * y[:, None] * y
    alpha, rate = np.zeros(len(docs)), 1 / np.linalg.eigvalsh(gram).max()
    for _ in range(200_000):
        alpha = np.clip(alpha - rate * (gram @ alpha - 1), 0, most)
    dense = x.T @ (alpha * y)
    assert np.abs(np.append(w[:40], bias) - dense).max() < 2e-3


def test_op7_scores_equal_a_loop():
    """The most toxic window of every text, word by word and n-gram by n-gram."""
    rng = np.random.default_rng(8)
    model = toxicity.Model(rng.normal(0, 3, toxicity.BUCKETS).astype(np.float32), -1.5)
    texts = ["one", "a a b", "Alpha, beta; gamma!", "x " * 5 + "y z", " ".join(f"w{i % 9}" for i in range(50)), "é ü 词 ..", "", " \n"]

    def word_value(word):
        raw = word.lower().encode() if word.isascii() else bytes(c + 32 if 65 <= c <= 90 else c for c in word.encode())
        grams, _ = toxicity.word_grams(np.frombuffer(raw, np.uint8), np.array([0]), np.array([len(raw)]))
        return float(np.mean(model.weights[grams].astype(np.float64)))

    def trimmed(word):
        edge = "".join(chr(i) for i in range(33, 127) if not chr(i).isalnum())
        return word.strip(edge) or word[0]
    for text, got in zip(texts, model.scores(pa.array(texts))):
        raw = WORD.findall(text)
        words = [trimmed(w) for i, w in enumerate(raw) if i == 0 or w.lower() != raw[i - 1].lower()]
        best = model.bias
        if words:
            starts = range(0, max(1, len(words) - toxicity.WINDOW + toxicity.WINDOW // 2), toxicity.WINDOW // 2) if len(words) > toxicity.WINDOW else [0]
            best = max(sum(map(word_value, words[s:s + toxicity.WINDOW])) / toxicity.WINDOW + model.bias for s in starts)
        assert abs(got - 1 / (1 + np.exp(-best))) < 1e-4


def _counts(text):
    w = WORD.findall(text or "")
    seen = collections.Counter(zip(w, w[1:], w[2:]))
    covered = {k + j for k in range(len(w) - 2) if seen[tuple(w[k:k + 3])] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered),
            len(w) < 50 or 100 * len(covered) > 50 * len(w))


def test_op9_counts(spark, sf, odd_docs, no_docs):
    for docs in (documents(spark, sf, "doc_id", "text", "lang"), odd_docs):
        want = {r.doc_id: _counts(r.text) for r in docs.collect()}
        rows = rules.quality_rules(docs).collect()
        assert {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows} == want
        assert not any(r.kept and r.base_failed for r in rows)
    assert rules.quality_rules(no_docs).collect() == []


def test_op9_distances(spark):
    import math
    df = spark.createDataFrame([([0.5, 0.5, 0.0],), ([0.0, 0.0, 1.0],), ([0.2, 0.3, 0.5],)], "p array<double>")
    q = [0.4, 0.6, 0.0]
    got = [r[0] for r in df.select(rules.js_distance(F.col("p"), F.array(*map(F.lit, q)))).collect()]
    for p, g in zip(([0.5, 0.5, 0.0], [0.0, 0.0, 1.0], [0.2, 0.3, 0.5]), got):
        m = [(a + b) / 2 for a, b in zip(p, q)]
        kl = lambda x: sum(a * math.log2(a / b) for a, b in zip(x, m) if a > 0)
        assert abs(g - math.sqrt((kl(p) + kl(q)) / 2)) < 1e-9


def test_op9_many_languages(spark):
    """A dirty lang column makes more references, not a larger plan."""
    docs = documents(spark, SF, "doc_id", "text").withColumn("lang", F.concat(F.lit("l"), (F.col("doc_id") % 300).cast("string")))
    rows = rules.quality_rules(docs).collect()
    assert len({r.doc_id for r in rows}) == docs.count() and len({r.nearest for r in rows}) > 100


def test_op9_separates_junk(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = QUERIES["op9_divergence_rules"](spark, SF).join(labels, "doc_id").where("not base_failed").collect()
    good = [r.kept for r in rows if r.quality == 1]
    junk = [r.kept for r in rows if r.quality == 0]
    assert np.mean(good) > 0.99 and np.mean(junk) < 0.2


def test_op9_runs_without_python(spark, sf):
    plan = QUERIES["op9_divergence_rules"](spark, sf)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|ArrowEval|MapInArrow", plan)
