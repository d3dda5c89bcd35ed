"""Language identification by compression (operator 3).

A language is known by its training texts, held as a raw-content zstandard
dictionary.  A text is reduced to lower-case letters
with single spaces and cut into pieces of ``PIECE`` bytes; every piece is
compressed with every language's dictionary, and the language of the smallest
total wins.  The dictionaries are a bounded sample: at most ``SAMPLE_DOCS``
different texts a language (those of smallest id hash; equal texts count once)
and ``DICT_BYTES`` bytes, so that no language gains by longer texts; where the
texts hold more, every text gives its share in pieces of ``SPAN`` bytes spread
evenly over its whole length.  A dictionary is built in a task of its own; the
driver gets ``DICT_BYTES`` a language, of ``MAX_LANGUAGES`` at most (more
values in ``lang`` raise, as a sign of a dirty column).

``score`` is a softmax of the sizes (``SCALE`` bytes a step, at most for
``SCALE_BYTES`` of text); a relative margin to the runner-up under
``MARGIN`` sets ``rejected``: the best guess is still reported.  Null texts
and texts without a letter are ``und`` with score 0; equal sizes go to the
language with more training texts, then the smaller name; with no training
rows everything is ``und``.  Repeated rows get equal answers; further columns
are ignored.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tokenlake.llm.common import saved

SAMPLE_DOCS = 40
DICT_BYTES, SPAN = 1 << 16, 256
MAX_LANGUAGES = 1000
SALTS = 16                        # the first rank is taken within so many parts of a language
PIECE = 2048
LEVEL = 6
SHORT, SHORT_LEVEL = 400, 19      # bytes; short texts are worth the stronger search (sizes of all languages change level together)
SCALE, SCALE_BYTES = 2.0, 2000
MARGIN = 0.01
UNKNOWN = "und"

_OTHER = re.compile(r"[\W\d_]+")


def letters(text: str) -> bytes:
    """Lower-case letters of a text, words separated by one space."""
    return _OTHER.sub(" ", text.lower()).strip().encode()


class Model:
    """Dictionaries by language, in order of preference on ties."""

    def __init__(self, samples: dict[str, bytes]):
        self.samples = samples
        self._compressors: dict[int, list] | None = None

    def __getstate__(self):
        return {"samples": self.samples, "_compressors": None}

    def _made(self, level: int) -> list:
        import zstandard as zs
        if self._compressors is None:
            self._compressors = {}
        if level not in self._compressors:
            made = []
            for sample in self.samples.values():
                d = zs.ZstdCompressionDict(sample or b" ", dict_type=zs.DICT_TYPE_RAWCONTENT)
                # zstandard's tables forget the head of a dictionary of more bytes than places
                log, p = max(6, len(sample).bit_length()), zs.ZstdCompressionParameters.from_level(level, dict_size=len(sample))
                d.precompute_compress(compression_params=zs.ZstdCompressionParameters.from_level(
                    level, dict_size=len(sample), hash_log=max(p.hash_log, log), chain_log=max(p.chain_log, log)))
                made.append(zs.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))
            self._compressors[level] = made
        return self._compressors[level]

    def sizes(self, text: bytes) -> np.ndarray:
        """Compressed size of a text for every language."""
        if len(text) <= SHORT:
            return np.array([len(c.compress(text)) for c in self._made(SHORT_LEVEL)], np.int64)
        pieces = [text[i:i + PIECE] for i in range(0, len(text), PIECE)]
        return np.array([sum(len(c.compress(p)) for p in pieces) for c in self._made(LEVEL)], np.int64)

    def identify(self, text: str | None) -> tuple[str, float, bool, float]:
        """Language, score, rejected, relative margin."""
        plain = letters(text or "")
        if not self.samples or not any(map(str.isalpha, plain.decode())):
            return UNKNOWN, 0.0, True, 0.0
        size = self.sizes(plain)
        best = int(size.argmin())
        shrink = min(1.0, SCALE_BYTES / len(plain)) / SCALE
        score = 1 / sum(math.exp(-min(700.0, (s - size[best]) * shrink)) for s in size.tolist())
        rest = np.delete(size, best)
        margin = float((rest.min() - size[best]) / size[best]) if len(rest) else 1.0
        return list(self.samples)[best], score, margin < MARGIN, margin


def dictionary(texts: list[bytes], size: int = DICT_BYTES, span: int = SPAN) -> bytes:
    """At most ``size`` bytes of the texts, each giving its share from all of its parts."""
    whole = b" ".join(texts)
    if len(whole) <= size:
        return whole
    share, out = size / len(whole), []
    for t in texts:
        pieces = max(1, int(len(t) * share / (span + 1)))
        at = np.linspace(0, max(0, len(t) - span), pieces).astype(int)
        out += [t[i:i + span] for i in at.tolist()] if len(t) * share < len(t) - span else [t]
    return b" ".join(out)[:size]


def fit(docs: DataFrame) -> Model:
    """Dictionaries from ``docs (doc_id, text, lang)``; rows with null lang or text are not used."""
    known = docs.where("lang is not null and text is not null").select(F.col("lang").cast("string"), F.col("text").cast("string"), "doc_id")
    place = F.struct(F.xxhash64("doc_id").alias("spread"), "doc_id")
    different = known.groupBy("lang", F.xxhash64("text").alias("digest"), F.length("text").alias("n")).agg(F.min(place).alias("first"))
    chosen = different.select("lang", "first", F.pmod(F.xxhash64("digest"), F.lit(SALTS)).alias("salt"))
    for keys in (("lang", "salt"), ("lang",)):          # a hot language is ranked in parts first
        chosen = (chosen.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("first")))
                  .where(F.col("place") <= SAMPLE_DOCS))
    chosen = saved(chosen.select("lang", F.col("first.doc_id").alias("doc_id"), "place"), "language-sample")
    languages = chosen.select("lang").distinct().count()
    if languages > MAX_LANGUAGES:
        raise ValueError(f"{languages} different values of lang; at most {MAX_LANGUAGES} are fitted")

    def build(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table.column("place").to_pylist(), table.column("text").to_pylist()))
        return pa.table({"lang": table.column("lang").slice(0, 1), "n": pa.array([len(rows)], pa.int32()),
                         "sample": pa.array([dictionary([letters(t) for _, t in rows])], pa.binary())})
    # SAMPLE_DOCS ids of MAX_LANGUAGES languages at most: small by that bound
    rows = known.join(F.broadcast(chosen.withColumnRenamed("lang", "of")), "doc_id").where("lang = of").select("lang", "place", "text")
    made = rows.groupBy("lang").applyInArrow(build, "lang string, n int, sample binary").collect()
    return Model({r["lang"]: bytes(r["sample"]) for r in sorted(made, key=lambda r: (-r["n"], r["lang"]))})


def identified(spark: SparkSession, docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, lang_pred, score, rejected, margin)`` of every row."""
    shipped = spark.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            found = [shipped.value.identify(t.as_py()) for t in batch.column(1)]
            lang, score, rejected, margin = zip(*found) if found else [()] * 4
            yield pa.record_batch([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_()),
                                   pa.array(margin, pa.float64())], names=["doc_id", "lang_pred", "score", "rejected", "margin"])
    return (docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
            .mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean, margin double"))
