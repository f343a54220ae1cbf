"""Columns of sequence tables: classes, metadata, padding, reverse complements, relatedness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import alphabets as A


def class_set(field: Column) -> Column:
    """Labels parted by ';' as a sorted set."""
    return F.array_sort(F.array_distinct(A.split_nonempty(F.coalesce(field, F.lit("")), ";")))


def encoded(df: DataFrame, alphabet: A.Alphabet, k: int, per_code: int = 1, pad: bool = True, text: str = "residues") -> DataFrame:
    """Clean, pad to k, and add the symbol codes (per_code symbols to a code)."""
    residues = A.clean(F.col(text), alphabet)
    residues = A.pad(residues, k, alphabet) if pad else residues
    df = df.withColumn(text, residues)
    if per_code == 1:
        return df.withColumn("codes", A.encode(F.col(text), alphabet))
    n = F.length(text) - per_code + 1
    codes = F.transform(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), lambda i: A.horner(F.substring(F.col(text), i + 1, F.lit(per_code)), alphabet))
    return df.withColumn("codes", codes)


def def_line(metadata: Column) -> Column:
    return F.array_join(metadata, "|")


def related(x: Column, y: Column) -> Column:
    """Class sets that meet."""
    return F.arrays_overlap(x, y)


def with_reverse_complements(df: DataFrame, id_: str = "seq_id", text: str = "residues") -> DataFrame:
    """df and, under the id with '_' behind, each sequence's reverse complement."""
    return df.unionByName(df.withColumn(text, A.reverse_complement(F.col(text))).withColumn(id_, F.concat(id_, F.lit("_"))))


def metadata_counts(df: DataFrame, metadata: str = "metadata") -> DataFrame:
    """column, n_values, n_rows: distinct values of each metadata field."""
    return df.select(F.posexplode(metadata).alias("column", "value")).groupBy("column").agg(F.count_distinct("value").alias("n_values"), F.count("*").alias("n_rows"))


def symbol_histogram(df: DataFrame, text: str = "residues") -> DataFrame:
    """symbol, n, p: counted within each partition before the shuffle; symbols of all sequences."""
    n = df.select(F.explode(F.split(text, "")).alias("symbol")).where("symbol <> ''").groupBy("symbol").agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("total"))
    return n.join(F.broadcast(total)).select("symbol", "n", (F.col("n") / F.col("total")).alias("p"))
