"""The training-data pipeline: drop toxic texts, copies and near copies, mix the sources, encode.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet to the
folder that all executors share and read again as the next stage's documents, so a lost executor
never costs more than the stage it was in. All stages but the last return the columns of
``documents``. Nulls count as empty texts, empty tables pass through, and columns beyond those
of ``documents`` are kept by all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywise.llm import bpe_coding, exact_dedup, mixing, ngram_join, toxicity
from tallywise.llm.queries import vocabulary
from tallywise.plans.query import read_table
from tallywise.sources.workspace import stored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject; it learns from the labels of this table's rows."""
    return toxicity.without_toxic(docs, read_table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest id."""
    return exact_dedup.without_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id."""
    return ngram_join.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often and in the order that the curriculum asks for."""
    return mixing.sequence(docs)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the token ids, and their number."""
    return bpe_coding.encode(docs, vocabulary()).withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("ngram_join", drop_near_copies),
    ("source_mixing", mix_sources),
    ("bpe_coding", encode_texts),
]

# The classifier, the training order and the vocabulary are beyond SQL; tests hold them against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents of ``sf_dir``."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
