"""Tokenisation, packing and training order against the tokenizer libraries and brute force."""

import base64
import hashlib
import random
import re
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from tokenlake.llm import bpe, order, packing, tokenize
from tokenlake.llm.common import documents, shared_folder
from tokenlake.llm.queries import QUERIES

PIECES = ["a", "aa", "the", " ", "  ", "\n", "é", "日本", "!", "!!", "==", "\t", "0", "12", "'s", "ñ", "😀", "\x1c", "\x85", "\xa0", "İ", "Σς", "́", "<|endoftext|>"]


def _random_texts(n):
    rng = random.Random(2)
    return ["".join(rng.choice(PIECES) for _ in range(60)) for _ in range(n)] + ["", "a" * 3000, " " * 1000, "ab" * 999, "!" * 777]


@pytest.fixture(scope="module")
def tiktoken_encoding():
    import tiktoken
    with open(bpe.default_path(), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("early", [False, True])
def test_op4_random_texts(tiktoken_encoding, early):
    enc = bpe.Encoder(bpe.default_path(), public_tokenizers.PATTERN)
    if early:
        enc.ranks.early[:] = True         # one position of a word at a time
    texts = _random_texts(400)
    ids, sizes = enc.encode(texts)
    at = np.cumsum(sizes) - sizes
    for t, a, n in zip(texts, at, sizes):
        assert ids[a:a + n].tolist() == tiktoken_encoding.encode_ordinary(t)
        assert enc.ranks.decode(ids[a:a + n]).decode() == t


def test_op4_query(spark, sf, tiktoken_encoding):
    texts = {r.doc_id: r.text or "" for r in documents(spark, sf).collect()}
    for r in QUERIES["op4_bpe_replay"](spark, sf).collect():
        ids = tiktoken_encoding.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_op4_odd_rows(odd_docs, no_docs):
    rows = {r.doc_id: r for r in bpe.decoded(bpe.encoded(odd_docs)).collect()}
    for r in odd_docs.collect():
        assert bytes(rows[r.doc_id].bytes).decode() == (r.text or "")
    assert bpe.decoded(bpe.encoded(no_docs)).collect() == []


def test_op4_memory_of_a_block_without_its_matches():
    enc = bpe.Encoder(bpe.default_path(), public_tokenizers.PATTERN)
    texts = ["it is as it was and so it goes on " * 2000] * 20
    enc.encode(texts)
    tracemalloc.start()
    ids, sizes = enc.encode(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sizes.sum() == len(ids) and ids.dtype.itemsize == 4
    assert peak < 26 * sum(map(len, texts)), peak


def test_op4_decodes_in_blocks(monkeypatch):
    monkeypatch.setattr(bpe, "DECODED_BYTES", 5000)
    enc = bpe.Encoder(bpe.default_path(), public_tokenizers.PATTERN)
    texts = ["", "a" * 9000, *("one two " * i for i in range(60)), ""]
    ids, sizes = enc.encode(texts)
    edges = np.concatenate(([0], np.cumsum(sizes)))
    batch = pa.record_batch([pa.array(range(len(texts))), pa.array(sizes), pa.array([ids[a:b].tobytes() for a, b in zip(edges, edges[1:])], pa.binary())],
                            names=["doc_id", "n_tokens", "ids"])
    blocks = list(bpe._with_bytes(enc.ranks, batch))
    assert len(blocks) > 2 and all(sum(map(len, b.column(3).to_pylist()[:-1])) < 5000 for b in blocks)
    assert [(i, v.decode()) for b in blocks for i, v in zip(b.column(0).to_pylist(), b.column(3).to_pylist())] == list(enumerate(texts))
    assert list(bpe._with_bytes(enc.ranks, batch.slice(0, 0))) == []


def _library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(tokenize.default_path())


def test_word_encoder_equals_the_library():
    library, enc = _library(), tokenize.WordEncoder(tokenize.default_path())
    texts = _random_texts(400) + ["it's We'Re 'twas !'s", "Straße ²³ ½"]
    ids, sizes = enc.encode(texts)
    at = np.cumsum(sizes) - sizes
    assert [ids[a:a + n].tolist() for a, n in zip(at, sizes)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_literals_of_added_tokens_are_the_library_s():
    library, enc = _library(), tokenize.WordEncoder(tokenize.default_path())
    texts = ["hello <|endoftext|> world", "<|startoftext|>", "a<|EndOfText|>b", "x <|endoftext|", "< |endoftext|>", "<|endoftext|><|endoftext|>", "plain words"]
    ids, sizes = enc.encode(texts)
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == want
    assert want[0] == [3306, 49407, 1002]


_WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|[0-9]|(?:[^\s\w]|_)+")


def test_words_are_the_pattern_s():
    rng = random.Random(5)
    pieces = ["'s", "'t", "'re", "'ve", "'m", "'ll", "'d", "'", "l", "r", "st", "é", "ß", " ", "\n", "\r\t", "5", "42", ".", "!?", "_", ""]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(9))) for _ in range(4000)] + ["'", "s", "a'", "ll", ""]
    for some in (texts, texts[-5:], [""], []):
        words, counts = tokenize.words_of(pa.array(some, pa.large_string()))
        want = [_WORD.findall(t) for t in some]
        assert counts.tolist() == list(map(len, want))
        assert words.to_pylist() == [w for own in want for w in own]


def test_different_words_of_a_batch_are_looked_up_once(monkeypatch):
    """Whatever stands beside them: 1000 pairs of a word and a mark are 70 words."""
    enc, seen = tokenize.WordEncoder(tokenize.default_path()), []
    places = enc._places
    monkeypatch.setattr(enc, "_places", lambda words: seen.append(len(words)) or places(words))
    marks = ["." * i + "," * j for i in range(1, 5) for j in range(1, 6)]
    texts = [f"{'ab' * k}x{m} " for k in range(50) for m in marks]
    ids, sizes = enc.encode(texts)
    assert seen == [50 + len(marks)]
    library = _library()
    assert ids.tolist() == [i for t in texts for i in library.encode(t, add_special_tokens=False).ids]


def test_a_vocabulary_of_another_alphabet_is_refused():
    enc = tokenize.WordEncoder(tokenize.default_path())
    from tokenizers.pre_tokenizers import WhitespaceSplit
    enc.library.pre_tokenizer = WhitespaceSplit()
    with pytest.raises(ValueError):
        enc.encode(["café isn't"])


def _check_packed(rows, texts):
    library = _library()
    want = {i: library.encode(t or "", add_special_tokens=False).ids + [1] for i, t in texts.items()}
    seen, sequences = {i: np.zeros(len(v), int) for i, v in want.items()}, {}
    for r in rows:
        assert r.doc_tokens == len(want[r.doc_id]) and r.length > 0
        ids = want[r.doc_id][r.start:r.start + r.length]
        assert np.frombuffer(bytes(r.ids), "<i4").tolist() == ids
        seen[r.doc_id][r.start:r.start + r.length] += 1
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all((v == 1).all() for v in seen.values())
    padding = 0
    for pieces in sequences.values():
        pieces.sort()
        assert [o for o, _ in pieces] == np.concatenate(([0], np.cumsum([n for _, n in pieces])[:-1])).tolist()
        n = sum(n for _, n in pieces)
        assert n <= 2048
        padding += 2048 - n if n & (n - 1) else 0
    return padding / max(1, sum(map(len, want.values())))


def test_op5_pieces(spark, sf, odd_docs, no_docs):
    docs = documents(spark, sf)
    assert _check_packed(packing.packed(docs).collect(), {r.doc_id: r.text for r in docs.collect()}) < 0.03
    _check_packed(packing.packed(odd_docs).collect(), {r.doc_id: r.text for r in odd_docs.collect()})
    assert packing.packed(no_docs).collect() == []


def test_op5_query_digest(spark, sf):
    ids = {(r.doc_id, r.start): zlib.crc32(bytes(r.ids)) for r in packing.packed(documents(spark, sf)).collect()}
    got = {(r.doc_id, r.start): r.ids_crc32 for r in QUERIES["op5_dp_packing"](spark, sf).collect()}
    assert got == ids


def test_op5_words_are_looked_up_once_a_batch(spark, monkeypatch):
    """The ids of a batch come from its different words, whatever marks stand beside them."""
    texts = [f"don't {w}{m} {w}'s {m}{w}" for w in ("alpha", "béta", "x", "7") for m in (".", "!?", "(", "'", "''")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    _check_packed(packing.packed(docs).collect(), dict(enumerate(texts)))
    enc, seen = tokenize.WordEncoder(tokenize.default_path()), []
    places = enc._places
    monkeypatch.setattr(enc, "_places", lambda words: seen.append(sorted(words)) or places(words))
    enc.encode(texts)
    assert seen == [sorted({w for t in texts for w in _WORD.findall(t)})]


def test_op5_cuts_are_optimal():
    rng = random.Random(1)
    for _ in range(300):
        at = np.unique(np.cumsum([rng.randint(1, 9) for _ in range(rng.randint(1, 40))]))
        penalty = np.array([rng.choice([0, 2, 5]) for _ in at])
        capacity = rng.randint(9, 20)
        cuts = packing.best_cuts(at, penalty, capacity)
        pos = [0, *at.tolist()]
        best = [0] + [10 ** 9] * len(at)
        for j in range(1, len(pos)):
            for i in range(j):
                if pos[j] - pos[i] <= capacity:
                    best[j] = min(best[j], best[i] + capacity - (pos[j] - pos[i]) + penalty[j - 1])
        cost, last, of = 0, 0, dict(zip(at.tolist(), penalty.tolist()))
        for c in cuts:
            assert c - last <= capacity
            cost, last = cost + capacity - (c - last) + of[c], c
        assert cost == best[-1] and last == at[-1]


def test_op5_stretches(spark, monkeypatch, sf):
    """Streams longer than a stretch, with the rest carried over."""
    enc = tokenize.encoder(tokenize.default_path())
    stream, rng = packing._Stream(enc.ends_sentence, 0), np.random.default_rng(1)
    docs, rows = {}, []
    for i in range(60):
        ids = rng.integers(300, 400, int(rng.integers(1, 9000))).astype(np.int32)
        docs[i] = ids
        stream.add(np.array([i]), ids, np.array([len(ids)]))
        if stream.waiting > 20_000:
            rows += stream.flush(False).to_pylist()
    rows += stream.flush(True).to_pylist()
    back = {i: [] for i in docs}
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["start"])):
        back[r["doc_id"]] += np.frombuffer(r["ids"], "<i4").tolist()
    assert all(back[i] == v.tolist() for i, v in docs.items())


def test_op2_permutation():
    for n in (1, 2, 3, 7, 100, 4097):
        p = order.Permutation(n)
        slots = p.slots(np.arange(n))
        assert sorted(slots.tolist()) == list(range(n)) and (p.indexes(slots) == np.arange(n)).all()
    assert order.Permutation(1000, 1).slots(np.arange(1000)).tolist() != order.Permutation(1000, 2).slots(np.arange(1000)).tolist()


def test_op2_round_trip(spark, sf, odd_docs, no_docs):
    library = _library()
    for docs in (documents(spark, sf, "text"), odd_docs):
        folder = shared_folder(spark, "order")
        rows = sorted(order.materialise(spark, docs, folder, length=128, shard=50).collect(), key=lambda r: r.slot)
        records = list(order.read_from(folder))
        assert [r.slot for r in rows] == list(range(len(records)))
        assert [zlib.crc32(x.tobytes()) for x in records] == [r.crc32 for r in rows]
        assert [x.tolist() for x in order.read_from(folder, 7)] == [x.tolist() for x in records[7:]]
        parts = {}
        for r in sorted(rows, key=lambda r: (r.part, r.place)):
            parts.setdefault(r.part, []).extend(records[r.slot][:r.n_ids].tolist())
        want = sorted(tuple(library.encode(r.text or "", add_special_tokens=False).ids) for r in docs.select("text").collect())
        got = []
        for ids in parts.values():
            cut = [i for i, x in enumerate(ids) if x == 1]
            got += [tuple(ids[a:b]) for a, b in zip([0, *(c + 1 for c in cut)], cut)]
        assert sum(map(len, got)) <= sum(map(len, want))
        assert all(1 in w for w in set(want) - set(got))          # only texts that hold id 1 themselves split otherwise
    empty = shared_folder(spark, "order")
    assert order.materialise(spark, no_docs, empty).collect() == [] and list(order.read_from(empty)) == []
