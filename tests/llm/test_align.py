"""Cross-tokenizer alignment against both libraries and plain loops."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tokenlake.llm import align
from tokenlake.llm.common import documents
from tokenlake.llm.queries import QUERIES

PIECES = ["a", "aa", "the", " ", "  ", "\n", "é", "日本", "!", "!!", "==", "\t", "0", "12", "'s", "ñ", "😀", "\x1c", "\x85", "\xa0", "İ", "Σς", "́",
          "<|endoftext|>", "\r", ";\r", "<0x41>", "<s>", "\x0b", "\0"]


@pytest.fixture(scope="module")
def libraries():
    path_a, path_b = align.default_paths()
    a = Tokenizer.from_file(path_a)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=path_b)
    byte = {c: i for i, c in enumerate(align._byte_characters())}

    def tokens(text):
        if not text:
            return [], []
        own_a = [(i, bytes(byte[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
        own_b = [(i, bytes([int(b.id_to_piece(i)[3:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode())
                 for i in b.encode(text, num_threads=1)]
        whole = (" " + text).encode()
        return (own_a, own_b) if b"".join(t for _, t in own_a) == b"".join(t for _, t in own_b) == whole else ([], [])
    return tokens


def plain(texts, tokens):
    """``id -> (n_a, n_b, n_groups, n_links, n_best, count_sum, groups)`` by loops; texts as (id, text) rows."""
    rows, held = [], Counter()
    for i, text in texts:
        spans = []
        for side in tokens(text):
            at, own = 0, []
            for t, raw in side:
                own.append((t, at, at + len(raw)))
                at += len(raw)
            spans.append(own)
        a, b = spans
        cuts = sorted({e for _, _, e in a} & {e for _, _, e in b})
        groups, last = [], 0
        for cut in cuts:
            groups.append("|".join(",".join(str(t) for t, s, e in side if s >= last and e <= cut) for side in (a, b)))
            last = cut
        links = [(x, y) for x, s, e in a for y, u, v in b if s < v and u < e]
        held.update(set(links))
        rows.append((i, len(a), len(b), groups, links))
    highest = defaultdict(int)
    for (x, _), n in held.items():
        highest[x] = max(highest[x], n)
    return [(i, n_a, n_b, len(g), len(k), sum(held[x] == highest[x[0]] for x in k), sum(held[x] for x in k), ";".join(g)) for i, n_a, n_b, g, k in rows]


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_coalesce_small():
    a_group, b_group, link_a, link_b = align.coalesce(np.array([1, 4, 2, 3]), np.array([3, 2, 5]))
    assert a_group.tolist() == [0, 0, 1, 1] and b_group.tolist() == [0, 0, 1]
    assert list(zip(link_a.tolist(), link_b.tolist())) == [(0, 0), (1, 0), (1, 1), (2, 2), (3, 2)]


def test_chunks_encode_as_whole_texts(libraries):
    enc, rng = align.Encoder(*align.default_paths()), random.Random(3)
    assert enc.splits
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.choice([1, 2, 3, 8, 60]))) for _ in range(600)]
    for t in texts:
        place = enc.look_up(enc.chunks(t))
        a, b = libraries(t)
        assert enc.equal[place].all() == bool(a)
        if a:
            assert enc.tokens(0, place)[0].tolist() == [i for i, _ in a] and enc.tokens(1, place)[0].tolist() == [i for i, _ in b]
    enc.splits = False                      # whole texts as chunks: same ids
    enc._forget()
    for t in texts[:100]:
        place = enc.look_up(enc.chunks(t))
        if enc.equal[place].all():
            assert enc.tokens(0, place)[0].tolist() == [i for i, _ in libraries(t)[0]]


def test_op11_random_texts(spark, libraries):
    rng = random.Random(5)
    texts = [(i, "".join(rng.choice(PIECES + ["▁"] * (i % 9 == 0)) for _ in range(rng.choice([1, 2, 5, 25])))) for i in range(150)]
    texts += [(7, "the same the same"), (7, "the same the same"), (None, "the same"), (200, None), (201, "")]
    docs = spark.createDataFrame([(i, t, "x", 0.5) for i, t in texts], "doc_id long, text string, groups string, n_a double").repartition(5)
    assert got(align.aligned(docs)) == sorted(plain(texts, libraries), key=repr)


def test_op11_long_texts_in_parts(spark, odd_docs, no_docs, libraries, monkeypatch):
    texts = [(r.doc_id, r.text) for r in odd_docs.where("doc_id not in (10, 11, 12)").collect()]
    want = sorted(plain(texts, libraries), key=repr)
    docs = odd_docs.where("doc_id not in (10, 11, 12)")
    assert got(align.aligned(docs)) == want
    enc = align.Encoder(*align.default_paths())
    long = next(r.text for r in odd_docs.collect() if r.doc_id == 10)
    whole = align._long(enc, long, False)
    monkeypatch.setattr(align, "CHUNKS", 1000)
    parts = align._long(enc, long, False)
    assert whole[:5] == parts[:5] and (whole[5] == parts[5]).all() and (whole[6] == parts[6]).all()
    assert align._long(enc, long, True)[4] == hashlib.sha256(whole[4].encode()).hexdigest()
    assert align._long(enc, long + "▁", False) is None
    a, b = libraries(long)
    assert whole[:2] == (len(a), len(b))
    assert align.aligned(no_docs).collect() == []


def test_op11_query(spark, sf, libraries):
    texts = [(r.doc_id, r.text) for r in documents(spark, sf).collect()]
    short = {i for i, t in texts if len(t or "") < 3000}
    rows = {r.doc_id: r for r in QUERIES["op11_interval_alignment"](spark, sf).collect()}
    assert set(rows) == {i for i, _ in texts}
    for i, t in texts:
        a, b = libraries(t)
        assert (rows[i].n_a, rows[i].n_b) == (len(a), len(b))
        if not a:
            assert rows[i].groups_sha256 == ""
    for i, n_a, n_b, n_groups, n_links, _, _, groups in plain([(i, t) for i, t in texts if i in short], libraries):
        r = rows[i]
        assert (r.n_a, r.n_b, r.n_groups, r.n_links) == (n_a, n_b, n_groups, n_links)
        assert r.groups_sha256 == (hashlib.sha256(groups.encode()).hexdigest() if groups else "")
    full = sorted((tuple(r) for r in align.aligned(documents(spark, sf)).select("doc_id", "n_best", "count_sum").collect()), key=repr)
    assert full == sorted(((r.doc_id, r.n_best, r.count_sum) for r in rows.values()), key=repr)
