"""Token-id array operators on documents (S6-S10, G20-G23, J3, O7, P8,
F.9-F.11, F.19, W7; FIXTURES B10/B11).

Every operator is a per-row array expression over the *whole* document
(no explode, no shuffle): ids per whitespace word are md5 draws modulo the
vocabulary (U2 default tokenizer), padded to a multiple of 64 with the pad id 0.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenlake.functions.common import array_tail
from tokenlake.operators.chat import VOCAB_SIZE, token_ids, word_ids, words
from tokenlake.session import checkpoint_dir, materialize
from tokenlake.sources import files
from tokenlake.sources.tables import table

PAD_ID = 0
PAD_TO = 64
MAX_INPUT_LEN = 48          # O7: keep the last N ids
END_ID = VOCAB_SIZE - 1     # default stop id appended by G23
SOP_ID = VOCAB_SIZE + 1     # special id appended by G22
STOP_WORD = "the"           # W7
WHITE = " \t\n\r\f\x0b"     # what a blank line may hold


def doc_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return d.withColumn("ids", token_ids(F.col("text")))


def id_sum(ids: Column) -> Column:
    return F.aggregate(ids, F.lit(0).cast("bigint"), lambda a, x: a + x)


def padded(ids: Column, width: int = PAD_TO) -> Column:
    """Ids filled up with the pad id to the next multiple of ``width`` (one ``width`` at least)."""
    rows = F.greatest(F.lit(1), F.ceil(F.size(ids) / width)).cast("int")
    return F.concat(ids, F.array_repeat(F.lit(PAD_ID), rows * width - F.size(ids)))


def parse_id_line(line: Column) -> Column:
    """Ids of one CSV line; a blank line is an empty array."""
    return F.when(F.length(F.btrim(line, F.lit(" \t\r\n"))) > 0,
                  F.transform(F.split(line, ","), lambda x: F.btrim(x, F.lit(" \t\r\n")).cast("int"))) \
        .otherwise(F.array().cast("array<int>"))


def token_csv_scan(spark: SparkSession, sf_dir: str, max_input_len: int = MAX_INPUT_LEN) -> DataFrame:
    """S9 -> S6 -> O7: ids written as a CSV line, read back with split +
    cast (ragged rows; a blank line is an empty row), last ``max_input_len`` ids kept."""
    d = doc_ids(spark, sf_dir).select("doc_id", F.array_join("ids", ",").alias("line"))
    t = d.select("doc_id", parse_id_line(F.col("line")).alias("ids")).withColumn("tail", array_tail(F.col("ids"), max_input_len))
    return t.select("doc_id", F.size("ids").alias("n_ids"), id_sum(F.col("ids")).alias("id_sum"), F.size("tail").alias("tail_len"),
                    F.array_join("tail", ",").alias("tail"))


def token_matrix_scan(spark: SparkSession, sf_dir: str, max_input_len: int = MAX_INPUT_LEN) -> DataFrame:
    """Padded id rows, pad id dropped, last ``max_input_len`` kept."""
    d = doc_ids(spark, sf_dir).select("doc_id", padded(F.col("ids")).alias("row"))
    kept = F.filter(F.col("row"), lambda x: x != PAD_ID)
    t = d.select("doc_id", F.size("row").alias("row_len"), kept.alias("kept"))
    return t.select("doc_id", "row_len", F.size("kept").alias("n_kept"), id_sum(F.col("kept")).alias("id_sum"),
                    F.array_join(array_tail(F.col("kept"), max_input_len), ",").alias("tail"))


def virtual_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G21 + F.11: prepend ids VOCAB .. VOCAB+p-1 (p = doc_id % 5); p = 0
    must not call ``sequence`` (it would count down)."""
    d = doc_ids(spark, sf_dir).withColumn("p", F.pmod(F.col("doc_id"), F.lit(5)).cast("int"))
    pre = F.when(F.col("p") > 0, F.sequence(F.lit(VOCAB_SIZE), F.lit(VOCAB_SIZE) + F.col("p") - 1)) \
           .otherwise(F.array().cast("array<int>"))
    out = d.select("doc_id", "p", F.concat(pre, F.col("ids")).alias("ids"))
    return out.select("doc_id", F.col("p").alias("n_prefix"), F.size("ids").alias("n_ids"),
                      F.try_element_at("ids", F.lit(1)).alias("first_id"),
                      F.aggregate("ids", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("id_sum"))


def request_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G22 + G23: SOP id appended for one model family (lang = 'en'); the
    default stop id appended to each request's own stop list (documents
    with doc_id % 3 = 0 carry their last id as a stop word)."""
    d = doc_ids(spark, sf_dir)
    ids = F.when(F.col("lang") == "en", F.array_append(F.col("ids"), F.lit(SOP_ID))).otherwise(F.col("ids"))
    own = F.when(F.pmod(F.col("doc_id"), F.lit(3)) == 0, F.slice(F.col("ids"), -1, 1))
    stops = F.concat(F.coalesce(own, F.array().cast("array<int>")), F.array(F.lit(END_ID)))
    return d.select("doc_id", F.size(ids).alias("n_ids"), F.try_element_at(ids, F.lit(-1)).alias("last_id"),
                    F.array_join(stops, ",").alias("stop_ids"))


def generation_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G20 + F.19: outputs[seq][beam][pos] -> one row per (sequence, beam);
    beams are the two halves of the padded row (the second one has the
    middle id of an odd row), sequence length is the
    beam's non-pad count, the new tokens are ids in [input_len, seq_len)
    with input_len = doc_id % 8; batch = floor(i / n_beams)."""
    d = doc_ids(spark, sf_dir).withColumn("row", padded(F.col("ids")))
    half = (F.size("row") / 2).cast("int")
    beams = F.array(F.slice("row", 1, half), F.slice("row", half + 1, F.size("row") - half))
    b = d.select("doc_id", F.pmod(F.col("doc_id"), F.lit(8)).cast("int").alias("input_len"),
                 F.posexplode(beams).alias("beam", "out"))
    seq_len = F.size(F.filter("out", lambda x: x != PAD_ID))
    new = F.when(seq_len > F.col("input_len"),
                 F.slice("out", F.col("input_len") + 1, seq_len - F.col("input_len"))) \
           .otherwise(F.array().cast("array<int>"))
    i = F.col("doc_id") * 2 + F.col("beam")
    return b.select("doc_id", "beam", "input_len", seq_len.alias("seq_len"),
                    F.floor(i / 2).alias("batch_idx"), F.pmod(i, F.lit(2)).alias("beam_of_batch"),
                    F.size(new).alias("n_new"),
                    F.aggregate(new, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("new_sum"))


def positional_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inputs and outputs paired by an explicit sequence id (never by
    generated row ids), prompt prefix stripped from the output."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    # the prompt side only needs its first input_len (< 8) tokens
    first = F.slice(words(F.col("text")), 1, F.pmod(F.col("doc_id"), F.lit(8)).cast("int"))
    inp = docs.select(F.col("doc_id").alias("seq_id"), word_ids(first).alias("inp"))
    out = doc_ids(spark, sf_dir).select(F.col("doc_id").alias("seq_id"), F.col("ids").alias("out"))
    j = inp.join(out, "seq_id")
    gen = F.slice("out", F.size("inp") + 1, F.greatest(F.size("out") - F.size("inp"), F.lit(1)))
    gen = F.when(F.size("out") > F.size("inp"), gen).otherwise(F.array().cast("array<int>"))
    return j.select("seq_id", F.size("inp").alias("n_input"), F.size(gen).alias("n_generated"),
                    F.try_element_at(gen, F.lit(1)).alias("first_generated"))


def line_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S6 + S8 + S9 + J3 over files: input ids and output ids written as CSV
    lines to two files, read back as ragged rows, paired by global line number
    (the order of doc_id) and the input stripped from the output."""
    d = doc_ids(spark, sf_dir).select("doc_id", F.slice("ids", 1, F.pmod(F.col("doc_id"), F.lit(8)).cast("int")).alias("inp"), F.col("ids").alias("out"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = materialize(d.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id").withColumn("part", F.spark_partition_id()), "id-rows")
    folder = os.path.join(checkpoint_dir(spark), f"id-lines-{uuid.uuid4().hex}")
    for side in ("inp", "out"):
        files.token_csv_sink(ordered.repartitionById(n, F.col("part")).sortWithinPartitions("doc_id"), f"{folder}/{side}", side)
    j = files.zip_lines(spark, f"{folder}/inp", f"{folder}/out", "\n")
    j = j.select("line_id", parse_id_line(F.col("left")).alias("inp"), parse_id_line(F.col("right")).alias("out"))
    gen = F.when(F.size("out") > F.size("inp"), F.slice("out", F.size("inp") + 1, F.greatest(F.size("out") - F.size("inp"), F.lit(1)))) \
           .otherwise(F.array().cast("array<int>"))
    return j.select("line_id", F.size("inp").alias("n_input"), F.size(gen).alias("n_generated"), F.try_element_at(gen, F.lit(1)).alias("first_generated"))


def nonblank_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each document that are not blank."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    lines = F.split(F.col("text"), "\n")
    return d.select("doc_id", F.size(lines).alias("n_lines"),
                    F.size(F.filter(lines, lambda l: F.length(F.btrim(l, F.lit(WHITE))) > 0)).alias("n_nonblank"))


def stop_cut(spark: SparkSession, sf_dir: str, stop_word: str = STOP_WORD) -> DataFrame:
    """W7 + U4: the first word is the last prompt token; generation stops
    at the first token whose pair (previous token + token, lower-cased)
    contains the stop word; the stopping token is kept."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text") \
        .select("doc_id", words(F.col("text")).alias("w"))
    n = F.size("w")
    hits = F.transform(F.sequence(F.lit(2), F.greatest(n, F.lit(2))), lambda i: F.contains(
        F.lower(F.concat(F.try_element_at("w", i - 1), F.try_element_at("w", i))), F.lit(stop_word.strip().lower())))
    pos = F.when(n >= 2, F.array_position(hits, True)).otherwise(F.lit(0))
    stop = F.when(pos > 0, pos + 1)
    kept = F.when(stop.isNotNull(), stop - 1).otherwise(F.greatest(n - 1, F.lit(0)))
    return d.select("doc_id", n.alias("n_words"), stop.alias("stop_pos"), kept.alias("n_kept"),
                    F.when(kept > 0, F.try_element_at("w", (kept + 1).cast("int"))).alias("last_kept"))
