"""The pipeline's stages against what their operators decide."""

import zlib

import numpy as np

import corpus_pipeline as cp
from test_dedup import _near_duplicates, _without_repeats
from tokenlake.llm import rules, toxicity
from tokenlake.llm.common import documents, saved
from tokenlake.llm.queries import toxicity_model
from tokenlake.llm.tokenize import default_path, encoder


def test_stages_take_effect(spark, sf):
    docs = documents(spark, sf, *cp.COLUMNS)
    text = {r.doc_id: r.text for r in docs.collect()}

    kept = saved(cp.drop_toxic(spark, docs, sf), "t")
    score = toxicity.score(spark, docs, toxicity_model(spark, docs, sf)).collect()
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in score if r.predicted == 0}
    assert tuple(kept.columns) == cp.COLUMNS

    after = saved(cp.drop_low_quality(spark, kept, sf), "q")
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in rules.quality_rules(kept).collect() if r.kept}

    before, after = after, saved(cp.drop_near_duplicates(spark, after, sf), "m")
    want = {i for i, (_, c) in _near_duplicates([(r.doc_id, r.text) for r in before.collect()]).items() if i == c}
    assert {r.doc_id for r in after.collect()} == want
    assert all(r.text == text[r.doc_id] for r in after.collect())

    cut = saved(cp.cut_shared_passages(spark, after, sf), "s")
    want = _without_repeats([(r.doc_id, r.text) for r in after.collect()])
    for r in cut.collect():
        assert r.text.split() == want[r.doc_id][2].split() and r.n_chars == len(r.text)
    assert tuple(cut.columns) == cp.COLUMNS

    ids = {r.doc_id: encoder(default_path()).encode([r.text])[0].tolist() + [1] for r in cut.collect()}
    pieces = cp.pack(spark, cut, sf).collect()
    for r in pieces:
        own = ids[r.doc_id][r.start:r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(np.array(own, "<i4").tobytes())
    assert sum(r.length for r in pieces) == sum(map(len, ids.values()))


def test_run_and_contract(spark, sf):
    assert [n for n, _ in cp.STAGES] == ["toxicity", "quality rules", "minhash near-dedup", "substring dedup", "packing"]
    assert cp.run(spark, sf).count() > 0 and cp.ORACLE_SQL is None


def test_stages_on_odd_rows(spark, sf, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        docs = docs.select(*cp.COLUMNS)
        for name, stage in cp.STAGES[:-1]:
            docs = saved(stage(spark, docs, sf), "odd")
            assert tuple(docs.columns) == cp.COLUMNS, name
        cp.STAGES[-1][1](spark, docs, sf).collect()
