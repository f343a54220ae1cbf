"""A training-data pipeline of five of the operators: toxic documents go, one document of each near-duplicate group stays, later copies of
paragraphs and benchmark passages are cut, and what is left is encoded.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; between stages the rows are written as Parquet and read again, so a stage
works on all that its predecessor kept and a lost executor costs at most one stage.  All stages but the last return the columns of
documents.  Nulls, empty texts and repeated rows are treated as each operator states."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import bpe, decontaminate, ngram_join, paragraphs, toxicity
from tessera.llm.common import materialise, read_table
from tessera.llm.queries import tokenizer


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, read_table(spark, sf_dir, "labels"))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_first(docs)


def cut_repeated_paragraphs(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return paragraphs.cut(docs)


def cut_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, read_table(spark, sf_dir, "benchmark"))


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.round_trip(docs, *tokenizer())


STAGES = [
    ("toxicity", remove_toxic),
    ("n-gram Jaccard join", keep_one_of_near_copies),
    ("substring dedup", cut_repeated_paragraphs),
    ("benchmark decontamination", cut_benchmark_passages),
    ("byte-level BPE", encode_texts),
]

#: Training, MinHash components and the tokenizer's contraction are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
