"""A training corpus from raw documents: filter, remove copies, mix, encode.

Every stage takes the documents that its predecessor kept and is written before
the next one starts, so a lost executor costs at most one stage's work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shelfledger.llm import byte_bpe, exact_dedup, mixing, near_dedup, quality_rules
from shelfledger.llm.entries import PATTERN, RANKS, table
from shelfledger.session import stage


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, learnt from the labelled ones among them."""
    return quality_rules.keep_good(docs, quality_rules.learn(docs, table(spark, sf_dir, "labels")))


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest id."""
    return exact_dedup.drop_copies(docs)


def dissimilar_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return near_dedup.keep_one(docs, width=PIPELINE_WIDTH)


def mixed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that sources meet their target weights."""
    return mixing.mix(docs)


def encoded_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids of every document."""
    return byte_bpe.encode(docs, RANKS, PATTERN)


#: Words in a shingle where no contract sets them.
PIPELINE_WIDTH = 5

STAGES = [
    ("quality rules", good_documents),
    ("exact dedup", distinct_documents),
    ("near dedup", dissimilar_documents),
    ("mixing", mixed_documents),
    ("byte bpe", encoded_documents),
]

#: The first stage follows a trained model, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, apply in STAGES[:-1]:
        docs = stage(apply(spark, docs, sf_dir), name.replace(" ", "-"))
    return stage(STAGES[-1][1](spark, docs, sf_dir), STAGES[-1][0].replace(" ", "-"))
