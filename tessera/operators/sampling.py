"""Sampling and splitting; every choice is a hash of the id and a seed, so it doesn't depend on partitions, machines or engines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def order_of(id_: str | Column, seed: int) -> Column:
    """The MD5 of the id as text, a colon and the seed, in hex."""
    return F.md5(F.concat((F.col(id_) if isinstance(id_, str) else id_).cast("string"), F.lit(f":{seed}")))


def number_of(id_: str | Column, seed: int) -> Column:
    """The first 32 bits of `order_of`."""
    return F.conv(F.substring(order_of(id_, seed), 1, 8), 16, 10).cast("long")


def sample(df: DataFrame, n: int, id_: str = "seq_id", seed: int = 0) -> DataFrame:
    """Exactly min(n, rows) rows, uniformly; a top-n, no full sort."""
    return df.orderBy(order_of(id_, seed), id_).limit(n)


def minhash_sample(words: DataFrame, n: int, word: str = "word") -> DataFrame:
    """The n distinct words of least hash."""
    return words.select(word).distinct().orderBy(order_of(word, 0), word).limit(n)


def largest(df: DataFrame, n: int, size: str = "size", id_: str = "proto_id") -> DataFrame:
    return df.orderBy(F.col(size).desc(), id_).limit(n)


def largest_per_class(df: DataFrame, n: int, class_: str = "class", size: str = "size", id_: str = "proto_id") -> DataFrame:
    r = F.row_number().over(Window.partitionBy(class_).orderBy(F.col(size).desc(), id_))
    return df.withColumn("_r", r).where(F.col("_r") <= n).drop("_r")


def split_train_test(df: DataFrame, n_test: int, id_: str = "seq_id", seed: int = 0) -> DataFrame:
    """is_test marks exactly min(n_test, rows) rows: those under the n_test-th hash, which alone reaches the driver."""
    h = order_of(id_, seed)
    last = df.select(h.alias("h"), F.col(id_).alias("i")).orderBy("h", "i").limit(n_test).orderBy(F.col("h").desc(), F.col("i").desc()).first() if n_test > 0 else None
    if last is None:
        return df.withColumn("is_test", F.lit(False))
    return df.withColumn("is_test", (h < last["h"]) | ((h == last["h"]) & (F.col(id_) <= F.lit(last["i"]))))


def folds(df: DataFrame, n: int, id_: str = "seq_id", seed: int = 0) -> DataFrame:
    """part, from 1 to n."""
    return df.withColumn("part", (1 + number_of(id_, seed) % n).cast("int"))


def cross_fold_homologs(parts: DataFrame, classes: str = "classes", id_: str = "seq_id") -> DataFrame:
    """id and its homologs in other parts: those that share a class."""
    one = parts.select(F.col(id_).alias("topic"), F.col("part").alias("p1"), F.explode(classes).alias("class"))
    two = parts.select(F.col(id_).alias("doc"), F.col("part").alias("p2"), F.explode(classes).alias("class"))
    return one.join(two, "class").where("p1 <> p2").select("topic", F.col("p1").alias("part"), "doc").distinct()


def subset(df: DataFrame, ids: DataFrame, id_: str = "seq_id") -> DataFrame:
    """Rows whose id is listed (ids: one column)."""
    return df.join(ids.select(F.col(ids.columns[0]).alias(id_)), id_, "left_semi")


def query_subset(df: DataFrame, ids: DataFrame | None = None, n: int = 0, seed: int = 0, id_: str = "seq_id") -> DataFrame:
    """By list if one is given, else a sample of n, else all."""
    return subset(df, ids, id_) if ids is not None else sample(df, n, id_, seed) if n else df


def homolog_subset(homologs: DataFrame, queries: DataFrame) -> DataFrame:
    """homologs (topic, doc): rows of the queries (topic), without docs that are queries themselves."""
    q = queries.select(F.col(queries.columns[0]).alias("topic"))
    return homologs.join(q, "topic", "left_semi").join(q.withColumnRenamed("topic", "doc"), "doc", "left_anti").select("topic", "doc")
