"""The corpus pipeline: stages that each call one operator, written as Parquet and read again between them.

A stage gets all that its predecessor kept and returns the columns of documents;
the last returns the encoded corpus.  Rows without an id are dropped by the
stages whose operators need one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from redraft.llm import bpe, decontamination, exact_dedup, ngram_join, quality
from redraft.llm.components import Tables
from redraft.llm.textblocks import table


def _kept(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs whose id is among ids, with the columns that they have."""
    return docs.join(ids.select("doc_id"), "doc_id", "left_semi").select(*[f"`{c}`" for c in docs.columns])


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality field does not reject (operator 6)."""
    scored = quality.score_documents(docs, table(spark, sf_dir, "labels"))
    return _kept(docs, scored.where("predicted = 1"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id (operator 2)."""
    return _kept(docs, exact_dedup.exact_duplicates(docs).where("kept"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents joined by similar word n-grams the one with the smallest id (operator 3): five words, similarity 0.8."""
    return _kept(docs, ngram_join.jaccard_components(docs, words=5, percent=80).where("doc_id = component_id"))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which no benchmark item has leaked (operator 1)."""
    return _kept(docs, decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark")).where("not contaminated"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document that is left, and the digests of ids and of the text decoded from them (operator 10)."""
    return bpe.encode_documents(docs)


STAGES = [
    ("quality classifier", good_documents),
    ("exact dedup", exact_copies),
    ("n-gram Jaccard join", near_copies),
    ("benchmark decontamination", without_benchmark),
    ("byte-level BPE encoding and decoding", encoded),
]

#: The classifier is trained and the tokens are merges of a vocabulary: SQL cannot express run().
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, tables = table(spark, sf_dir, "documents"), Tables(spark, "pipeline")
    for number, (_, stage) in enumerate(STAGES):
        # a stage's folder goes when the next one is written, the last when the result is saved
        docs = stage(spark, docs, sf_dir)
        docs = tables.saved(docs, "stage") if number < len(STAGES) - 1 else tables.last(docs)
    return docs
