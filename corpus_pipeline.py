"""From raw documents to packed training sequences.

Stages in order: quality rules, toxicity, near duplicates, packing. Each is written as Parquet and read again, so
that a lost executor costs no more than the stage that runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumaforge.llm import ngram_join, packing, quality_rules, toxicity
from lumaforge.llm.queries import remainder
from lumaforge.llm.tables import stored, table
from lumaforge.session import configure


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    configure(spark)
    return quality_rules.keep(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity threshold, by a model that learns from the labelled ones among them."""
    configure(spark)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), where=remainder(3) != 1)
    return toxicity.keep(docs, model)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    configure(spark)
    return ngram_join.keep_one(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequence and offset."""
    configure(spark)
    return packing.pack(packing.pieces(docs))


STAGES = [
    ("quality_rules", quality),
    ("toxicity", clean),
    ("ngram_jaccard", distinct),
    ("packing", pack),
]

#: A tokenizer and a trained classifier decide, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
