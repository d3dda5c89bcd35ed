"""Best-fit packing: every id once, whole documents, few sequences."""

import itertools
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from tokenlake.llm import bestfit, tokenize
from tokenlake.llm.common import documents
from tokenlake.llm.queries import QUERIES

TEXT = "doc_id long, text string, length long, open string"


def check(rows, texts, library):
    """Rows hold each document's pieces once, gapless sequences; returns the number of sequences and the least possible one."""
    want = sorted(((i, library.encode(t or "", add_special_tokens=False).ids + [0]) for i, t in texts), key=repr)
    pieces, sequences = {}, {}
    for r in rows:
        ids = np.frombuffer(bytes(r.ids), "<i4").tolist()
        assert r.length == len(ids) and r.start == 2048 * r.piece
        pieces.setdefault(r.doc_id, []).append((r.piece, ids))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    if len({i for i, _ in texts}) == len(texts):
        got = []
        for i, own in pieces.items():
            own.sort()
            assert [p for p, _ in own] == list(range(len(own))) and all(len(ids) == 2048 for _, ids in own[:-1]) and 0 < len(own[-1][1]) <= 2048
            got.append((i, [t for _, ids in own for t in ids]))
        assert sorted(got, key=repr) == want
    for own in sequences.values():
        own.sort()
        assert [o for o, _ in own] == [0, *itertools.accumulate(n for _, n in own)][:-1] and sum(n for _, n in own) <= 2048
    assert sum(r.length for r in rows) == sum(len(ids) for _, ids in want)
    return len(sequences), -(-sum(len(ids) for _, ids in want) // 2048)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokenize.default_path())


def fewest(sizes, capacity):
    """Least number of bins, by trying all."""
    best = len(sizes)

    def place(k, fills):
        nonlocal best
        if len(fills) >= best:
            return
        if k == len(sizes):
            best = len(fills)
            return
        for i in range(len(fills)):
            if fills[i] + sizes[k] <= capacity and fills[i] not in fills[:i]:
                fills[i] += sizes[k]
                place(k + 1, fills)
                fills[i] -= sizes[k]
        place(k + 1, [*fills, sizes[k]])
    place(0, [])
    return best


def test_op12_small_pools_near_the_optimum():
    rng, found, least = random.Random(1), 0, 0
    for _ in range(120):
        sizes = sorted((rng.randint(1, 20) for _ in range(rng.randint(1, 9))), reverse=True)
        bins = bestfit.pack(np.array(sizes), 20)
        assert sorted(i for b in bins for i in b) == list(range(len(sizes))) and all(sum(sizes[i] for i in b) <= 20 for b in bins)
        found, least = found + len(bins), least + fewest(sizes, 20)
    assert found <= least * 1.02


def test_op12_search_empties_bins_that_best_fit_leaves():
    rng, before, after = np.random.default_rng(3), 0, 0
    for _ in range(10):
        sizes = rng.integers(20, 60, 300)
        bins = bestfit.best_fit(sizes, 100)
        search = bestfit._Search(sizes, bins, 100)
        squares = (search.fill ** 2).sum()
        search.improve()
        assert (search.fill ** 2).sum() >= squares and search.fill.max() <= 100
        assert (search.fill == np.bincount(search.bin, sizes, len(bins))).all()
        before, after = before + len(bins), after + np.count_nonzero(search.fill)
    assert after < before


def test_op12_every_step_raises_the_squares():
    rng = np.random.default_rng(5)
    sizes = rng.integers(200, 900, 200)
    search = bestfit._Search(sizes, [[i] for i in range(200)], 2048)        # far from packed: moves first
    while True:
        squares, out = (search.fill ** 2).sum(), int(np.argmin(np.where(search.fill > 0, search.fill, 9999)))
        if not search.step(out):
            break
        assert (search.fill ** 2).sum() > squares and search.fill.max() <= 2048
    assert np.count_nonzero(search.fill) < 100


def test_op12_odd_rows(odd_docs, no_docs, library):
    texts = [(r.doc_id, r.text) for r in odd_docs.collect()]
    found, least = check(bestfit.packed(odd_docs).collect(), texts, library)
    assert found <= least + 1
    assert bestfit.packed(no_docs).collect() == []


def test_op12_null_and_repeated_ids(spark, library):
    texts = [(None, "a b"), (None, None), (3, "c " * 3000), (3, "c " * 3000), (4, "x " * 2047), (5, "x " * 2048)]
    rows = bestfit.packed(spark.createDataFrame([(i, t, 7, "x") for i, t in texts], TEXT)).collect()
    check(rows, texts, library)
    assert [(r.piece, r.length) for r in rows if r.doc_id == 4] == [(0, 2048)]
    assert sorted((r.piece, r.length) for r in rows if r.doc_id == 5) == [(0, 2048), (1, 1)]


def test_op12_many_partitions(spark, library, monkeypatch):
    """Open bins of the partitions are packed again, in groups of groups."""
    monkeypatch.setattr(bestfit, "FAN", 3)
    monkeypatch.setattr(bestfit, "POOL", 4000)
    rng = random.Random(7)
    texts = [(i, "w " * rng.randint(1, 1400)) for i in range(150)]
    rows = bestfit.packed(spark.createDataFrame([(i, t, 1, "x") for i, t in texts], TEXT).repartition(11)).collect()
    found, least = check(rows, texts, library)
    assert found <= least * 1.02 + 1


def test_op12_query(spark, sf, library):
    docs = documents(spark, sf)
    rows = bestfit.packed(docs).collect()
    found, least = check(rows, [(r.doc_id, r.text) for r in docs.collect()], library)
    assert found <= least + 2
    got = {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in QUERIES["op12_swap_packing"](spark, sf).collect()}
    assert got == {(r.doc_id, r.piece): (r.start, r.length, zlib.crc32(bytes(r.ids))) for r in rows}
