"""Token ids of whole texts by a public tokenizers vocabulary, word by word.

The vocabulary drops white space, splits the rest by a pattern without
look-around and encodes every word on its own.  So a batch is cut into words
all at once, where the class of the bytes changes, and each different word is
encoded once by the model of the tokenizers library and remembered.  This
holds for texts of the characters in ``_PLAIN`` (where lower-casing and NFC
are one-to-one) without the literal of an added token such as
``<|endoftext|>``; any other text goes through the library whole, as a
``Tokenizer`` with its default settings encodes it.
"""

from __future__ import annotations

import os
import re
import unicodedata
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tokenlake.llm.words import gather, text_buffer

VOCABULARY = "word_bpe_49k.json"
MOST_WORDS = 500_000          # remembered words; then the memory starts anew
BATCH_CHARS = 1 << 21

_LETTERS = "".join(c for c in map(chr, range(0x180)) if unicodedata.category(c)[0] == "L" and c != "İ")
_PLAIN = f"[^\t\n\r\x20-\x7e{_LETTERS}]"          # a character that is not plain
# classes of a lower-cased plain text's bytes; those beyond ASCII all belong to letters
_SPACE, _LETTER, _DIGIT, _OTHER = range(4)
_KIND = np.full(256, _LETTER, np.uint8)
_KIND[:128] = _OTHER
_KIND[list(b"\t\n\r ")] = _SPACE
_KIND[list(b"abcdefghijklmnopqrstuvwxyz")] = _LETTER
_KIND[list(b"0123456789")] = _DIGIT
_ENDINGS = (b"s", b"t", b"re", b"ve", b"m", b"ll", b"d")     # one word with the apostrophe before
# the byte-level alphabet: printable characters stand for themselves, the other bytes for U+0100 and on
_SHOWN = [*range(0x21, 0x7f), *range(0xa1, 0xad), *range(0xae, 0x100)]
_BYTES = {b: 0x100 + i for i, b in enumerate(sorted(set(range(0x100)) - set(_SHOWN))) if b != 0x0a}
_PROBES = 16                  # new words of a batch that go through the whole library too


def words_of(low: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words of lower-cased plain texts, text after text, and the number of words of each:
    a run of letters, a digit, a run of other characters, or an apostrophe with an ending."""
    data, offsets = text_buffer(low)
    n = len(data)
    data = np.concatenate((data, np.zeros(3, np.uint8)))
    kind = _KIND[data]
    begins = np.zeros(n + 3, bool)                   # first byte of a text, or behind the last
    begins[offsets] = True
    begins[n:] = True
    cut = begins.copy()
    cut[1:n] |= (kind[1:n] != kind[:n][:-1]) | (kind[1:n] == _DIGIT)
    quote = np.flatnonzero(data[:n] == ord("'"))
    quote = quote[cut[quote] & ~begins[quote + 1]]
    for ending in _ENDINGS:
        at = quote
        for i, c in enumerate(ending):
            at = at[(data[at + 1 + i] == c) & ~begins[at + 1 + i]]
        cut[at + 1] = False
        cut[at + 1 + len(ending)] = True
    starts = np.flatnonzero(cut[:n])
    pieces = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, n)), pa.py_buffer(data))
    word = kind[starts] != _SPACE
    return pieces.filter(pa.array(word)), np.diff(np.searchsorted(starts[word], offsets))


def default_path() -> str:
    import public_tokenizers
    return public_tokenizers.path(VOCABULARY)


class WordEncoder:
    """Encodes texts; one per Python worker, see ``encoder``."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"       # the cores belong to Spark's tasks
        from tokenizers import Tokenizer
        self.library = Tokenizer.from_file(path)
        self.added = [t.content.lower() for t in self.library.get_added_tokens_decoder().values()]
        size = self.library.get_vocab_size()
        self.ends_sentence, self.ends_word = np.zeros(size, bool), np.zeros(size, bool)
        for token, i in self.library.get_vocab().items():
            self.ends_sentence[i] = bool(re.fullmatch(r"[.!?]+(</w>)?", token))
            self.ends_word[i] = token.endswith("</w>")
        self._forget()

    def _forget(self) -> None:
        self.places: dict[str, int] = {}
        self._flat = (np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64))

    def _learn(self, words: list[str]) -> None:
        """Encodes new words by the library's model, in the byte-level alphabet."""
        shown = "\n".join(words).encode().decode("latin-1").translate(_BYTES).split("\n")
        ids, lens, tokens = [], np.zeros(len(words), np.int64), self.library.model.tokenize
        for i, w in enumerate(shown):
            own = [t.id for t in tokens(w)]
            lens[i] = len(own)
            ids += own
        probe = min(len(words), _PROBES)
        if self.library.encode(" ".join(words[:probe]), add_special_tokens=False).ids != ids[:lens[:probe].sum()]:
            raise ValueError("the vocabulary doesn't encode word by word")
        flat, _, before = self._flat
        lens = np.concatenate((before, lens))
        self._flat = (np.concatenate((flat, np.array(ids, np.int32))), np.cumsum(lens) - lens, lens)
        self.places.update(zip(words, range(len(self.places), len(self.places) + len(words))))

    def _places(self, words: list[str]) -> np.ndarray:
        """Places of different words among those remembered."""
        if len(self.places) > MOST_WORDS:
            self._forget()
        place = np.fromiter(map(self.places.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(place < 0)
        if len(new):
            place[new] = np.arange(len(self.places), len(self.places) + len(new))
            self._learn([words[i] for i in new.tolist()])
        return place

    def encode(self, texts: pa.Array | list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (null: none), text after text, and the number of ids of each."""
        texts = pc.fill_null(texts.cast(pa.large_string()) if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string()), "")
        low = pc.utf8_lower(texts)
        odd = pc.match_substring_regex(texts, _PLAIN)
        for literal in self.added:
            odd = pc.or_(odd, pc.match_substring(low, literal))
        whole = {i: self.library.encode(texts[i].as_py(), add_special_tokens=False).ids for i in np.flatnonzero(odd.to_numpy(zero_copy_only=False))}
        words, counts = words_of(pc.if_else(odd, "", low))
        coded = words.dictionary_encode()
        place = self._places(coded.dictionary.to_numpy(zero_copy_only=False).tolist())[coded.indices.to_numpy()]
        flat, first, lens = self._flat
        lens = lens[place]
        ids = flat[gather(first[place], lens)]
        total = np.concatenate(([0], np.cumsum(lens)))
        sizes = np.diff(total[np.concatenate(([0], np.cumsum(counts)))])
        if whole:
            parts, at = [], 0
            for i in range(len(texts)):
                if i in whole:
                    sizes[i] = len(whole[i])
                    parts.append(np.array(whole[i], np.int32))
                else:
                    parts.append(ids[at:at + sizes[i]])
                    at += sizes[i]
            ids = np.concatenate(parts)
        return ids, sizes

    def batches(self, texts: pa.Array):
        """``(a, b, ids, sizes)`` of rows a..b-1; a batch holds about ``BATCH_CHARS`` bytes or one longer text."""
        size = np.array([0 if v is None else v for v in pc.binary_length(texts).to_pylist()], np.int64)
        total, a = np.concatenate(([0], np.cumsum(size))), 0
        while a < len(texts):
            b = max(a + 1, int(np.searchsorted(total, total[a] + BATCH_CHARS, "right")) - 1)
            yield a, b, *self.encode(texts.slice(a, b - a))
            a = b


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]
