"""The queries of this package's operators, each over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import bpe, decontaminate, ngram_join, paragraphs, sharding, suffix_dedup, toxicity, url_filter, vector_search, warc
from tessera.llm.common import read_table as table


def tokenizer() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op1_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), *tokenizer())


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.report(table(spark, sf_dir, "documents"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(table(spark, sf_dir, "pages"))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_search.top_scores(table(spark, sf_dir, "embeddings"))


def op9_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs.report(table(spark, sf_dir, "documents"))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join_documents(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_byte_level_bpe, op2_benchmark_decontamination, op3_toxicity, op4_suffix_array_dedup, op5_sharding, op6_warc, op7_url_filters, op8_exact_top_k, op9_paragraph_dedup, op10_ngram_jaccard_join)}
ORACLES = {"op2_benchmark_decontamination": decontaminate.ORACLE, "op5_sharding": sharding.ORACLE, "op6_warc": warc.ORACLE, "op7_url_filters": url_filter.ORACLE, "op8_exact_top_k": vector_search.ORACLE, "op10_ngram_jaccard_join": ngram_join.ORACLE}
