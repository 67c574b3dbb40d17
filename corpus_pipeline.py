"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one
before it kept; its result is written and read back as the next one's input.
Stages change or drop documents and keep the columns of ``documents``; the last
one returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tickloom.llm.exact_dedup import drop_exact_copies
from tickloom.llm.near_copies import keep_one_of_each
from tickloom.llm.packing import pack_documents
from tickloom.llm.suffixes import drop_passages
from tickloom.llm.toxicity import drop_toxic
from tickloom.llm.words import word_bpe_path
from tickloom.session import settle

END_ID = 1


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_exact_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_passages(docs)      # over 50 words, which op7's 400 bytes do not bound


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs, word_bpe_path(), END_ID)


STAGES = [
    ("toxicity", toxicity),
    ("exact dedup", exact_dedup),
    ("n-gram Jaccard join", near_dedup),
    ("suffix-array dedup", repeated_passages),
    ("best-fit packing", packing),
]

ORACLE_SQL = None      # the classifier and the tokenizer are beyond SQL; tests/llm checks every stage against plain Python


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir))
    return docs
