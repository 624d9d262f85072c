"""A corpus pipeline over ``documents``: toxicity, exact and near copies, source mix, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from clipquery.llm import toxicity
from clipquery.llm.common import discard, materialize, table
from clipquery.llm.exact_dedup import drop_copies
from clipquery.llm.labelled import remainder
from clipquery.llm.mixing import mixed_documents
from clipquery.llm.near_dedup import drop_near_copies
from clipquery.llm.packing import pack
from clipquery.llm.queries import vocabulary


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator, fitted to these documents and the labels, doesn't reject."""
    lexicon = toxicity.fit(docs, table(spark, sf_dir, "labels"), remainder("doc_id", 5) != 0)
    return toxicity.drop_toxic(docs, lexicon)


def no_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id."""
    return drop_copies(docs)


def no_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, by shingles of five words and a similarity of 0.8, the document of the smallest id."""
    return drop_near_copies(docs, words=5, percent=80)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix to source targets takes them."""
    return mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens."""
    return pack(docs, vocabulary())


STAGES = [("toxicity", not_toxic), ("exact dedup", no_copies), ("near dedup", no_near_copies), ("source mix", mixed), ("packing", packed)]

#: The first and third stages can't be said in SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
        discard(before)  # the tables of stages before the last; the input stays
    return docs
