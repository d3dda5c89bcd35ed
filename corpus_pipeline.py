"""From raw documents to packed training sequences.

Every stage takes the documents its predecessor kept (columns doc_id, text,
lang, source, n_chars) and returns what it keeps, the last one the pieces of
the packed sequences.  ``run`` writes each stage's rows as Parquet under the
folder of spark.checkpoint.dir and reads them again, so a lost executor
costs no earlier stage.

Odd rows, at every stage: a null text counts as empty and fails the quality
rules, like an empty one; columns but the five are dropped; an empty table
stays empty through all stages; very long texts are worked off whole.  A
doc_id names a document: where it repeats, all of its rows go if one is
rejected by the quality rules or is a later copy of another document, while
the toxicity stage judges row by row; rows without a doc_id are judged for
toxicity only and stay.  Ties: of equal documents the smallest doc_id stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenlake.llm import minhash, rules, substring, toxicity
from tokenlake.llm.common import documents, saved
from tokenlake.llm.queries import packed_pieces, toxicity_model

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """Rows whose id is not among the rejected (rows without an id stay)."""
    return docs.select(*COLUMNS).join(rejected.select("doc_id"), "doc_id", "left_anti").select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go."""
    model = toxicity_model(spark, docs, sf_dir)
    return toxicity.score(spark, docs, model, carry=COLUMNS).where("predicted = 0").select(*COLUMNS)


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the quality rules go."""
    return _without(docs, saved(rules.quality_rules(docs).where("not kept").select("doc_id"), "rejected"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near-duplicates the smallest id stays."""
    return _without(docs, saved(minhash.near_duplicates(docs).where("not kept").select("doc_id"), "rejected"))


def cut_shared_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in passages of 50 that a smaller id has are cut out of the texts."""
    return (substring.without_repeats(docs, layout=True, carry=("lang", "source"))
            .select("doc_id", F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("long").alias("n_chars")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the packed sequences."""
    return packed_pieces(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality rules", drop_low_quality),
    ("minhash near-dedup", drop_near_duplicates),
    ("substring dedup", cut_shared_passages),
    ("packing", pack),
]

#: SQL cannot express the trained classifier or the packing; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table."""
    docs = documents(spark, sf_dir, *COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
