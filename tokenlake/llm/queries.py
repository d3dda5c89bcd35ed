"""The registered queries of this package and, where SQL can express them, their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenlake.llm import align, bestfit, bpe, language, minhash, oracles, order, packing, periodic, quality, rules, substring, toxicity, vectors
from tokenlake.llm.common import documents, held_out, shared_folder
from tokenlake.sources.tables import table


def op6_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate documents: doc_id, n_shingles, component_id, kept."""
    return minhash.near_duplicates(documents(spark, sf_dir))


def op8_fm_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words that a smaller doc_id already has, removed: doc_id, n_words, n_removed, kept_sha256."""
    return (substring.without_repeats(documents(spark, sf_dir))
            .select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256")))


def op9_divergence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality rules by counts and distribution divergence."""
    return (rules.quality_rules(documents(spark, sf_dir, "doc_id", "text", "lang"))
            .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"))


def toxicity_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> toxicity.Model:
    """Learnt from labelled rows of ``docs`` that are not held out."""
    labels = table(spark, sf_dir, "labels").where(~held_out("doc_id", 5, 0))
    return toxicity.trained(toxicity.training_sample(docs, labels, "toxic", toxicity.MAX_DOCS), toxicity.fit)


def op1_nbsvm_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document: doc_id, held_out, score, predicted; learnt from the rows not held out."""
    docs = documents(spark, sf_dir)
    labels = table(spark, sf_dir, "labels").where(~held_out("doc_id", 4, 2))
    model = toxicity.trained(toxicity.training_sample(docs, labels, "quality", quality.MAX_DOCS), quality.fit)
    return (quality.score(spark, docs, model)
            .select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "score", "predicted"))


def op2_feistel_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as fixed-stride shards in keyed training order; one row per sequence."""
    return order.materialise(spark, documents(spark, sf_dir, "text"), shared_folder(spark, "training-order"))


def op3_zstd_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document by compressed size: doc_id, held_out, lang_pred, score."""
    docs = documents(spark, sf_dir, "doc_id", "text", "lang")
    model = language.fit(docs.where(~held_out("doc_id", 4, 2)))
    return (language.identified(spark, docs, model)
            .select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score", "rejected", "margin"))


def op4_bpe_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE of every document and back: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return (bpe.decoded(bpe.encoded(documents(spark, sf_dir)))
            .select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256")))


def packed_pieces(docs: DataFrame) -> DataFrame:
    return packing.packed(docs).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op5_dp_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 ids: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    return packed_pieces(documents(spark, sf_dir))


def op7_subword_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document: doc_id, held_out, score, predicted; learnt from the rows not held out."""
    docs = documents(spark, sf_dir)
    return (toxicity.score(spark, docs, toxicity_model(spark, docs, sf_dir))
            .select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", "predicted"))


def op10_grid_order_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate vectors within a label: vec_id, n_links, component_id, kept."""
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"))


def op11_interval_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tokenisations of every document laid over each other: counts, and the SHA-256 of the groups."""
    return align.aligned(documents(spark, sf_dir), digest=True).withColumnRenamed("groups", "groups_sha256")


def op12_swap_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents in as few sequences of at most 2048 ids as found: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return (bestfit.packed(documents(spark, sf_dir))
            .select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset"))


def _with_periods(docs: DataFrame) -> DataFrame:
    """A tenth of the texts, by id, made periodic from some word on, as the contract of operator 13 lays down."""
    word = F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    docs = (docs.withColumn("h", F.crc32(F.col("doc_id").cast("string"))).withColumn("g", F.expr("h div 10"))
            .withColumn("w", F.when(F.expr("h % 10 = 0"), word)).withColumn("n", F.size("w")))
    docs = docs.withColumn("a", F.expr("int(g % n)")).withColumn("p", F.expr("int(1 + (n - a) div (3 + g % 8))"))
    made = F.expr("array_join(concat(slice(w, 1, a), slice(flatten(array_repeat(slice(w, a + 1, p), int((n - a) div p + 1))), 1, n - a)), ' ')")
    return docs.select("doc_id", F.when(F.col("n") > 0, made).otherwise(F.col("text")).alias("text"))


def op13_recompression_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words of every document: how many, the longest one, and the text with every run collapsed."""
    found = periodic.periodic_runs(_with_periods(documents(spark, sf_dir)))
    best = F.expr("array_max(transform(runs, r -> struct(r.length as length, -r.start as before, -r.period as less)))")
    lines = F.expr("array_join(transform(runs, r -> concat_ws(',', string(r.start), string(r.length), string(r.period)) || '\n'), '')")
    return (found.withColumn("best", best)
            .select("doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.before")).alias("start"),
                    F.col("best.length").alias("length"), (-F.col("best.less")).alias("period"),
                    F.expr("1000 * best.length div -best.less").alias("exponent_milli"),
                    F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_nbsvm_quality": op1_nbsvm_quality,
    "op2_feistel_order": op2_feistel_order,
    "op3_zstd_language": op3_zstd_language,
    "op4_bpe_replay": op4_bpe_replay,
    "op5_dp_packing": op5_dp_packing,
    "op6_hyperminhash": op6_hyperminhash,
    "op7_subword_toxicity": op7_subword_toxicity,
    "op8_fm_substring": op8_fm_substring,
    "op9_divergence_rules": op9_divergence_rules,
    "op10_grid_order_join": op10_grid_order_join,
    "op11_interval_alignment": op11_interval_alignment,
    "op12_swap_packing": op12_swap_packing,
    "op13_recompression_runs": op13_recompression_runs,
}

#: The classifiers, tokenisers and packing have no SQL form; tests/llm holds them against brute force.
ORACLE: dict[str, str] = oracles.SQL
