"""The corpus pipeline (part of the llm subpackage): documents that are good enough and
not toxic, one of each text and one of each group of near copies, packed into sequences.

Each stage works on what its predecessor kept. Quality and toxicity models are fitted on
the labelled rows among the stage's own documents. Defined results: stages treat nulls,
empty texts, repeated rows and empty tables as their operators do; a null text passes
quality and toxicity as an empty one; all but the last stage return the columns of
documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewater.llm import exact_dedup, jaccard_join, packing, quality, toxicity
from tidewater.llm.common import stored, table


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.select(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def harmless(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.select(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.distinct_texts(docs)


def apart(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.one_of_each(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [
    ("quality", good),
    ("toxicity", harmless),
    ("exact_dedup", distinct),
    ("jaccard_join", apart),
    ("packing", packed),
]
#: SQL cannot express the models and the packing; a brute-force version is in the tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLE = {}
