"""Tables of the driver as the engine's sequence, signature and ranking tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq_id, residues, class: country names as sequences, regions as classes."""
    return table(spark, sf_dir, "nation").select(F.col("n_name").alias("seq_id"), F.lower("n_name").alias("residues"), F.col("n_regionkey").cast("string").alias("class"))


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "region").select(F.col("r_name").alias("seq_id"), F.lower("r_name").alias("residues"))


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("seq_id"), F.lower("p_name").alias("residues"), F.col("p_brand").alias("class"))


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("seq_id"), F.lower("text").alias("residues"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("seq_id"), F.lower("text").alias("residues"))


def sign_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq_id (vec_id), features (0-origin places of positive components), label."""
    e = F.transform("embedding", lambda x, i: F.when(x > 0, i))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("seq_id"), F.filter(e, lambda i: i.isNotNull()).alias("features"), "label")


#: The same tables in SQL, as common table expressions.
NATIONS = "nations as (select n_name seq_id, lower(n_name) residues, n_regionkey::varchar class from nation)"
REGIONS = "regions as (select r_name seq_id, lower(r_name) residues from region)"
PARTS = "parts as (select p_partkey::varchar seq_id, lower(p_name) residues, p_brand class from part)"
TEXTS = "texts as (select doc_id::varchar seq_id, lower(text) residues from documents)"
ITEMS = "items as (select item_id::varchar seq_id, lower(text) residues from benchmark)"
BITS = "bits as (select vec_id seq_id, label, list_filter(list_transform(range(len(embedding)), lambda i: case when embedding[i + 1] > 0 then i end), lambda i: i is not null) features from embeddings)"


def words(source: str, k: int) -> str:
    """SQL: one row for each word of k symbols of a sequence expression's rows (seq_id, pos, word)."""
    return f"select seq_id, i::int pos, substr(residues, i + 1, {k}) word from (select seq_id, residues, unnest(range(0, length(residues) - {k} + 1)) i from {source})"
