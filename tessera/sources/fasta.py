"""FASTA in and out.  Records are cut by Spark's text source at line ends before '>', so a file is read in parallel where it can be split."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tessera.functions import alphabets as A
from tessera.operators.sequences import class_set, def_line


def parse(records: DataFrame, id_index: int = 0, class_index: int = -1, alphabet: A.Alphabet = A.AMINO, unknown: str = "default") -> DataFrame:
    """records (value: a defline, with or without '>', and residue lines) -> seq_id, defline, metadata, residues, classes.

    Records without residues are dropped; empty metadata fields don't count ('a||b' has two)."""
    raw = F.regexp_replace("value", r"^\s*>", "")
    defline = F.regexp_extract(raw, r"^([^\r\n]*)", 1)
    residues = A.clean(F.regexp_replace(F.substring(raw, F.length(defline) + 1, F.length(raw)), r"[\r\n]", ""), alphabet, unknown)
    metadata = A.split_nonempty(defline, r"\|")
    classes = class_set(F.get("metadata", F.lit(class_index))) if class_index >= 0 else F.array().cast("array<string>")
    rows = records.select(defline.alias("defline"), metadata.alias("metadata"), residues.alias("residues")).where("residues <> ''")
    return rows.select(F.trim(F.get("metadata", F.lit(id_index))).alias("seq_id"), "defline", "metadata", "residues", classes.alias("classes"))


def read(spark: SparkSession, path: str, **options) -> DataFrame:
    """See `parse` for options."""
    return parse(spark.read.option("lineSep", "\n>").text(path).where("trim(value) <> ''"), **options)


def lines(df: DataFrame) -> DataFrame:
    """value: a record for each sequence, from defline, else metadata, else seq_id."""
    names = df.columns
    head = F.col("defline") if "defline" in names else def_line(F.col("metadata")) if "metadata" in names else F.col("seq_id")
    return df.select(F.concat(F.lit(">"), head, F.lit("\n"), F.col("residues")).alias("value"))


def write(df: DataFrame, path: str) -> None:
    lines(df).write.text(path)


def read_prototypes(spark: SparkSession, path: str, alphabet: A.Alphabet = A.AMINO) -> DataFrame:
    """proto_id, word, size, class: deflines '>proto_1|size=12' or '>proto_1|class|size=12'."""
    rows = read(spark, path, alphabet=alphabet)
    size = F.regexp_extract("defline", r"size=(\d+)", 1).cast("long")
    other = F.when(F.size("metadata") > 2, F.get("metadata", F.lit(1)))
    return rows.select(F.col("seq_id").alias("proto_id"), F.col("residues").alias("word"), size.alias("size"), other.alias("class"))


def write_prototypes(protos: DataFrame, path: str) -> None:
    middle = F.when(F.col("class").isNotNull(), F.concat(F.lit("|"), "class")).otherwise("") if "class" in protos.columns else F.lit("")
    protos.select(F.concat(F.lit(">"), "proto_id", middle, F.lit("|size="), "size", F.lit("\n"), "word").alias("value")).write.text(path)


class FastaDataSource(DataSource):
    """spark.read.format('fasta').load(path): for single files; after spark.dataSource.register(FastaDataSource)."""

    @classmethod
    def name(cls) -> str:
        return "fasta"

    def schema(self) -> str:
        return "defline string, residues string"

    def reader(self, schema) -> DataSourceReader:
        return _FastaReader(self.options["path"])


class _FastaReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        import glob
        import os

        found = sorted(glob.glob(os.path.join(self.path, "*"))) if os.path.isdir(self.path) else [self.path]
        return [InputPartition(p) for p in found]

    def read(self, partition):
        defline, parts = None, []
        with open(partition.value) as source:
            for line in source:
                if line.startswith(">"):
                    if defline is not None and parts:
                        yield defline, "".join(parts)
                    defline, parts = line[1:].rstrip("\n"), []
                elif stripped := re.sub(r"[-\s]", "", line):
                    parts.append(stripped.lower())
        if defline is not None and parts:
            yield defline, "".join(parts)
