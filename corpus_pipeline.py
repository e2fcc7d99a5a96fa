"""The corpus pipeline: quality rules, line dedup, near-dedup, repeated passages, packing.

Each stage takes the documents that the stage before kept and returns documents; the last returns packed pieces.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segscore.llm import lines, neardup, packing, repeats, rules
from segscore.llm.common import saved


def counted(docs: DataFrame) -> DataFrame:
    """n_chars after a stage that changed texts."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the adaptive rules keep, whole rows. Null and empty texts go; repeated rows all stay or all go. No rows give no rows; further columns stay, whatever their names."""
    return rules.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of ten and more sources stay in their first document only. Null texts stay null; a text of such lines alone becomes empty. No rows give no rows; further columns stay, whatever their names."""
    return counted(lines.clean_lines(docs).select(*(F.col(f"`{c}`") for c in docs.columns)))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates. Null and empty texts are one class; of repeated rows one stays. No rows give no rows; further columns stay, whatever their names."""
    return neardup.keep_one(docs)


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every byte of a 50-byte string that a smaller doc_id has goes. Null texts stay null; repeated rows are cut alike. No rows give no rows; further columns stay, whatever their names."""
    return counted(repeats.remove_repeats(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all texts in sequences of powers of two. A null or empty text is its end id; repeated rows are packed each. No rows give no pieces."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality rules", quality), ("line dedup", line_dedup), ("near dedup", near_dedup), ("passage dedup", passage_dedup), ("packing", pack)]
#: Signatures, transforms and tokens have no SQL; a test holds every stage, and run(), against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again before the next; a stage's table goes when the next is
    written, so that one copy of the corpus stands beside the one in the making."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), ()
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name.replace(" ", "-"), done=before)
        before = (docs,)
    return STAGES[-1][1](spark, docs, sf_dir)
