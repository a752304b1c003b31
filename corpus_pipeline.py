"""Corpus pipeline: quality classifier, near-duplicates, personal data, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept.
All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import mixing, packing, pii, quality, simhash
from millrace.session import table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from the labels beside the input.

    Null and empty texts are judged as texts without words; rows with a null doc_id are judged like
    others; repeated rows share one fate; an empty table stays empty; where labels know one class
    only, or none, all rows get its share, or 1. Other columns pass as they are.
    """
    model = quality.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    scored = quality.classify(docs, model, "__score")
    return scored.where(F.col("__score") >= quality.THRESHOLD).drop("__score")


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one of smallest doc_id, null last.

    Null and empty texts are one group; of repeated rows one stays; rows without an id stay where no
    other of their group has one; an empty table stays empty. Other columns pass as they are.
    """
    return simhash.keep_one(docs)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; n_chars follows the text.

    A null text stays null, an empty one empty; repeated rows stay equal; an empty table stays
    empty. Other columns pass as they are.
    """
    return pii.redact(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out so that sources meet their target weights.

    A null source is a source of its own, last in order; a source without any word is left out, as it
    has no target; null and empty texts go with their source's rate; repeated rows, and rows without
    an id, are decided alike; an empty table stays empty. Other columns pass as they are.
    """
    return mixing.mix(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row gets a length bucket, a token-budget batch and a slot in it.

    Null and empty texts have length 0; repeated rows and rows without an id are packed each; an
    empty table gives no rows. Columns other than doc_id and text are not looked at.
    """
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality_stage),
    ("simhash", simhash_stage),
    ("pii", pii_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Models trained on the way and XXH64 fingerprints decide which rows there are; SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
