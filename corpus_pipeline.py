"""A corpus pipeline of the training-data operators.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns
the next stage's documents, the last one packed sequences. Every stage works on all rows it
gets. Empty tables pass through all stages; columns beside those of ``documents`` stay as
they are up to the last stage, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.llm import common, neardup, packing, quality, queries, substrings

#: Bytes from which on a repeated passage is cut: 50 words of running text have about 250
#: bytes or more (in the data's four languages 245 at least).
PASSAGE = 240


def reject_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go.

    Null texts score as empty ones, null ids have no label, repeated rows share a fate and
    very long texts are scored whole. Without any labels every document stays."""
    return quality.keep_good(docs, common.table(spark, sf_dir, "labels"))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicates the document with the least id stays.

    Null and empty texts are near-duplicates of each other, so one of them stays; a null id
    stays only if its class has no other; of repeated rows one stays."""
    return neardup.keep_one(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of PASSAGE bytes or more that repeat leave the texts; n_chars follows.

    Null texts stay null, empty ones empty; a text that is wholly repeated becomes empty.
    Very long texts are handled in overlapping parts."""
    cut = substrings.without_repeats(docs, length=PASSAGE)
    if "n_chars" not in docs.columns:
        return cut
    return cut.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of 2048: one row per piece.

    A null or empty text is its end token alone; very long texts are cut; repeated rows are
    packed each; other columns are left out."""
    return packing.pack(docs, queries.vocabulary())


STAGES = [
    ("quality_classifier", reject_poor),
    ("minhash_near_dedup", keep_one_of_each),
    ("suffix_array_dedup", cut_repeats),
    ("packing", pack),
]

#: The classifier, the sampling and the tokenizer can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each writes its rows for the next to read."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
