"""MinHash and substring dedup, and vectors, against brute force."""

import collections
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tokenlake.llm import minhash, substring, vectors
from tokenlake.llm.common import components, documents, saved

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _find(parent, x):
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def _near_duplicates(rows):
    sets = {}
    for i, t in rows:
        w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    parent, index = {i: i for i in sets}, collections.defaultdict(list)
    for i in sorted(sets):
        shared = collections.Counter(j for g in sets[i] for j in index[g])
        for g in sets[i]:
            index[g].append(i)
        for j, k in shared.items():
            if 100 * k >= 75 * (len(sets[i]) + len(sets[j]) - k):
                a, b = sorted((_find(parent, i), _find(parent, j)))
                parent[b] = a
    return {i: (len(s), _find(parent, i)) for i, s in sets.items()}


def _check_near(df, docs):
    got = {r.doc_id: r for r in df.collect()}
    want = _near_duplicates([(r.doc_id, r.text) for r in docs.collect()])
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())


def test_op6_equals_brute_force(spark, sf):
    docs = documents(spark, sf)
    _check_near(minhash.near_duplicates(docs), docs)


def test_op6_odd_rows(odd_docs, no_docs):
    _check_near(minhash.near_duplicates(odd_docs), odd_docs)
    assert minhash.near_duplicates(no_docs).collect() == []


def test_op6_large_group_of_near_copies(spark):
    """Edited copies whose links are not all to one document: components must still be whole."""
    rng = random.Random(4)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(400):
        words = list(base)
        for _ in range(rng.choice((1, 2, 3, 4, 6))):
            words[rng.randrange(len(words))] = f"e{rng.randrange(10 ** 9)}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    _check_near(minhash.near_duplicates(docs), docs)


def test_op6_estimates():
    rng = np.random.default_rng(1)
    for share in (0.3, 0.75, 0.9):
        both = rng.integers(0, 1 << 63, 4000, dtype=np.uint64)
        cut = int(4000 * share)
        a = np.unique(np.concatenate((both[:cut], both[cut:cut + (4000 - cut) // 2])))
        b = np.unique(np.concatenate((both[:cut], both[cut + (4000 - cut) // 2:])))
        exact = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        coarse = minhash.estimate(minhash.registers(a, 1), minhash.registers(b, 1), np.float64(len(a)), np.float64(len(b)))
        fine = minhash.fine_estimate(minhash.fine_registers(a), minhash.fine_registers(b))
        assert abs(coarse - exact) < 0.2 and abs(fine - exact) < 0.08


def test_op6_short_texts_whose_fine_sketch_is_far_off(spark):
    """Texts of 7, 7 and 8 words, similarity exactly 3 of 4: a shared fine bucket must not lose a link."""
    rows, i = [], 0
    for k in range(6000):
        w = [f"t{k}x{j}" for j in range(8)]
        texts = [" ".join(w[:7]), " ".join(w[1:]), " ".join(w)]
        a, b, c = (minhash.fine_registers(s) for s in minhash.shingle_sets(pa.array(texts)))
        if min(minhash.fine_estimate(a, c), minhash.fine_estimate(b, c)) < minhash.FINE_ESTIMATE:
            rows += [(i + n, t) for n, t in enumerate(texts)]
            i += 3
    assert len(rows) >= 30
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    _check_near(minhash.near_duplicates(docs), docs)


def test_op6_sets_around_the_exact_size(spark):
    """Near copies of 100 to 170 shingles, some compared exactly and some by sketch, not all linked to one."""
    rng = random.Random(6)
    base = [f"b{i}" for i in range(174)]
    rows = []
    for i in range(300):
        words = base[:rng.choice((110, 128, 131, 132, 133, 150, 174))]
        for _ in range(rng.choice((1, 2, 3, 4))):
            words[rng.randrange(len(words))] = f"e{rng.randrange(10 ** 9)}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    _check_near(minhash.near_duplicates(docs), docs)


def test_op6_refuses_thresholds_that_lose_pairs(no_docs):
    with pytest.raises(ValueError, match="threshold"):
        minhash.near_duplicates(no_docs, 60)
    assert minhash.near_duplicates(no_docs, 90).collect() == []


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 99), (99, 98)], "a long, b long")
    got = {r.id: r.component for r in components(edges).collect()}
    assert all(got[i] == 0 for i in range(1, 61)) and got[99] == got[100] == 98


def _without_repeats(rows):
    owner, out = {}, {}
    for i, t in sorted(rows):
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for k in range(len(w) - 49):
            if owner.setdefault(tuple(w[k:k + 50]), i) < i:
                gone[k:k + 50] = [True] * 50
        out[i] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g))
    return out


def test_op8_equals_brute_force(spark, sf, odd_docs, no_docs):
    for docs in (documents(spark, sf), odd_docs):
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring.without_repeats(docs).collect()}
        assert got == _without_repeats([(r.doc_id, r.text) for r in docs.collect()])
    assert substring.without_repeats(no_docs).collect() == []


def test_op8_layout_keeps_the_rest(spark):
    passage = " ".join(f"p{i}" for i in range(55))
    docs = spark.createDataFrame([(1, f"a  b\n{passage}\nend"), (2, f"c\t{passage}  d\ne"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r.kept for r in substring.without_repeats(docs, layout=True).collect()}
    assert got == {1: f"a  b\n{passage}\nend", 2: "c\td\ne", 3: None}


def test_op8_split_anchor(spark, monkeypatch):
    """An anchor of many different pieces is split by window hash without losing a window."""
    monkeypatch.setattr(substring, "ANCHOR_PIECES", 3)
    monkeypatch.setattr(substring, "SHARD_WORDS", 500)
    rng = random.Random(2)
    passage = [f"p{i}" for i in range(120)]
    rows = []
    for i in range(40):
        w = list(passage)
        w[rng.randrange(120)] = f"x{i}"
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring.without_repeats(docs).collect()}
    assert got == _without_repeats(rows)


def test_op8_common_passage_costs_in_proportion(spark, monkeypatch):
    """A passage of 60 words between other words in every document, some documents whole copies: one short row a window, few words in the shards."""
    monkeypatch.setattr(substring, "ANCHOR_PIECES", 50)
    dealt = []
    real = substring._piece_texts
    monkeypatch.setattr(substring, "_piece_texts", lambda rows, shards: dealt.append(saved(real(rows, shards), "dealt")) or dealt[0])
    rng = random.Random(4)
    own = lambda n: [f"w{rng.randrange(10 ** 9)}" for _ in range(n)]
    passage = [f"p{i}" for i in range(60)]
    rows = [(i, " ".join(own(60) + passage + own(60))) for i in range(600)]
    rows += [(1000 + i, rows[i * 7][1]) for i in range(40)] + [(2000, " ".join(passage * 3))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring.without_repeats(docs).collect()}
    assert got == _without_repeats(rows)
    assert dealt[0].agg(F.coalesce(F.sum(F.size(F.split("words", " "))), F.lit(0))).first()[0] < 3 * sum(len(t.split()) for _, t in rows) / 4


def test_op8_backward_search():
    rng = np.random.default_rng(3)
    text = np.concatenate((rng.integers(2, 6, 300), [1], rng.integers(2, 6, 200), [1, 0]))
    index = substring.FMIndex(text)
    for _ in range(50):
        n = int(rng.integers(1, 6))
        pattern = rng.integers(2, 6, n)
        lo, hi = np.array([0]), np.array([index.n])
        for c in pattern[::-1]:
            lo, hi = index.extend(lo, hi, np.array([c]))
        want = sum((text[k:k + n] == pattern).all() for k in range(len(text) - n + 1))
        assert hi[0] - lo[0] == want


def _links(ids, labels, vectors_, threshold=0.98):
    n = {i: 0 for i in ids}
    parent = {i: i for i in ids}
    usable = {}
    for i, v in zip(ids, vectors_):
        if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, np.float64)
            usable[i] = x / np.abs(x).max()
    for a in range(len(ids)):
        for b in range(a):
            i, j = ids[a], ids[b]
            if labels[a] is None or labels[a] != labels[b] or i not in usable or j not in usable or len(usable[i]) != len(usable[j]):
                continue
            x, y = usable[i], usable[j]
            if x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= threshold:
                n[i] += 1
                n[j] += 1
                p, q = sorted((_find(parent, i), _find(parent, j)))
                parent[q] = p
    return {i: (n[i], _find(parent, i)) for i in ids}


@pytest.mark.parametrize("block", [8, 256])
def test_op10_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(vectors, "BLOCK", block)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 16))
    rows = []
    for i in range(240):
        v = centres[rng.integers(6)] + rng.normal(size=16) * rng.choice((0.05, 0.15, 1.0))
        rows.append((i, [float(x) for x in v.astype(np.float32)], int(rng.integers(2))))
    rows += [(300, rows[0][1], rows[0][2]), (301, rows[0][1], rows[0][2]), (302, None, 1), (303, [0.0] * 16, 1), (304, [1.0, None] * 8, 1),
             (305, [float("nan")] * 16, 1), (306, [float("inf")] * 16, 1), (307, rows[3][1], None), (308, [1.0, 2.0], 1), (309, [2.0, 4.0], 1), (310, [], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_vectors(df).collect()}
    assert got == _links([r[0] for r in rows], [r[2] for r in rows], [r[1] for r in rows])
    assert vectors.near_vectors(df.limit(0)).collect() == []


def test_op10_null_and_repeated_ids(spark):
    rows = [(None, [1.0, 0.0], 1, "x"), (None, None, 1, "x"), (1, [1.0, 0.0], 1, "x"), (2, [1.0, 0.001], 1, "x"), (3, [0.0, 1.0], 1, "x"), (3, [0.0, 1.0], 1, "x"),
            (4, [-1.0, 0.0], 1, "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, n_links string")
    got = sorted((tuple(r) for r in vectors.near_vectors(df).collect()), key=repr)
    assert got == sorted([(None, 0, None, True), (None, 0, None, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 3, True), (3, 1, 3, True), (4, 0, 4, True)], key=repr)


def test_op10_table(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = df.collect()
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_vectors(df).collect()}
    assert got == _links([r.vec_id for r in rows], [r.label for r in rows], [r.embedding for r in rows])


def test_kept_digest_of_the_query(spark, sf):
    from tokenlake.llm.queries import QUERIES
    want = _without_repeats([(r.doc_id, r.text) for r in documents(spark, sf).collect()])
    got = {r.doc_id: r.kept_sha256 for r in QUERIES["op8_fm_substring"](spark, sf).collect()}
    assert got == {i: hashlib.sha256(k.encode()).hexdigest() for i, (_, _, k) in want.items()}
