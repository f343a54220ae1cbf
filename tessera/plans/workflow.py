"""Chains of named stages whose tables are kept: a stage runs again only when its own or an earlier stage's parameters change."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.matrices import MATRICES, Matrix
from tessera.operators import bags, evaluation, ranking, sampling, tiling, vocabulary


@dataclass
class Stage:
    """function(inputs by name, parameters) -> DataFrame; inputs are earlier stages or given tables."""

    name: str
    function: Callable[[dict[str, DataFrame], dict], DataFrame]
    inputs: list[str]
    parameters: dict = field(default_factory=dict)


class Workflow:
    def __init__(self, spark: SparkSession, root: str, given: dict[str, DataFrame], versions: dict[str, str] | None = None):
        """given: the input tables; versions: a mark for each that changes with its content (else its plan's hash is taken)."""
        self.spark, self.root, self.tables = spark, root.rstrip("/"), dict(given)
        self.marks = {n: (versions or {}).get(n) or str(df.semanticHash()) for n, df in given.items()}
        self.ran: list[str] = []

    def run(self, stages: list[Stage]) -> dict[str, DataFrame]:
        for s in stages:
            mark = json.dumps([s.name, s.parameters, [self.marks[i] for i in s.inputs]], sort_keys=True, default=str)
            self.marks[s.name] = hashlib.sha256(mark.encode()).hexdigest()[:16]
            path = f"{self.root}/{s.name}-{self.marks[s.name]}"
            done = self.spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
            if not done.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
                s.function({i: self.tables[i] for i in s.inputs}, s.parameters).write.mode("overwrite").parquet(path)
                self.ran.append(s.name)
            self.tables[s.name] = self.spark.read.parquet(path)
        return self.tables


def _matrix(p: dict) -> Matrix:
    return p["matrix"] if isinstance(p.get("matrix"), Matrix) else MATRICES[p.get("matrix", "blosum62")]()


def vocabulary_stages(k: int, threshold: int, matrix: str = "blosum62", kind: str = "blosum", n_test: int = 10, n_protos: int = 1000, increment: int = 100, top: int = 100, seed: int = 0) -> list[Stage]:
    """Given `sequences` (seq_id, residues, classes): split, cluster the training words, keep the largest prototypes, encode, rank, evaluate."""
    m = {"matrix": matrix, "kind": kind, "threshold": threshold}

    def split(t, p):
        return sampling.split_train_test(t["sequences"], p["n_test"], seed=p["seed"])

    def index(t, p):
        return tiling.kmers(t["split"].select("seq_id", "is_test", "residues"), p["k"])

    def clusters(t, p):
        return vocabulary.greedy_clusters(t["index"].where("not is_test"), p["threshold"], _matrix(p), p["kind"], p["increment"], p["seed"])

    def protos(t, p):
        return sampling.largest(vocabulary.prototypes_of(t["clusters"], t["index"].where("not is_test").select("seq_id", "pos", "word")), p["n"])

    def signatures(t, p):
        s = vocabulary.encode_signatures(t["index"], t["protos"], p["threshold"], _matrix(p), p["kind"])
        return s.join(t["split"].select("seq_id", "is_test"), "seq_id")

    def rankings(t, p):
        return ranking.rank_signatures(t["signatures"].where("is_test"), t["signatures"].where("not is_test"), p["top"])

    return [
        Stage("split", split, ["sequences"], {"n_test": n_test, "seed": seed}),
        Stage("index", index, ["split"], {"k": k}),
        Stage("clusters", clusters, ["index"], m | {"increment": increment, "seed": seed}),
        Stage("protos", protos, ["clusters", "index"], {"n": n_protos}),
        Stage("signatures", signatures, ["index", "protos", "split"], m),
        Stage("rankings", rankings, ["signatures"], {"top": top}),
        Stage("evaluation", evaluate, ["rankings", "split"], {}),
    ]


def bag_stages(k: int, n_test: int = 10, mode: str = "d2", top: int = 100, seed: int = 0) -> list[Stage]:
    """Given `sequences`: split, count words, rank by a bag-of-words mode, evaluate."""

    def split(t, p):
        return sampling.split_train_test(t["sequences"], p["n_test"], seed=p["seed"])

    def vectors(t, p):
        return bags.term_vectors(t["split"], p["k"]).join(t["split"].select("seq_id", "is_test"), "seq_id")

    def rankings(t, p):
        v = t["vectors"]
        d = bags.fragment_distances(v.where("is_test").drop("is_test"), v.where("not is_test").drop("is_test"), p["mode"])
        return ranking.top_k(bags.over_fragments(d), p["top"])

    return [Stage("split", split, ["sequences"], {"n_test": n_test, "seed": seed}), Stage("vectors", vectors, ["split"], {"k": k}), Stage("rankings", rankings, ["vectors"], {"mode": mode, "top": top}), Stage("evaluation", evaluate, ["rankings", "split"], {})]


def projection_stages(k: int, matrix: str = "blosum62", kind: str = "blosum", mode: str = "HausdorffAverageAverage", n_test: int = 10, top: int = 100, seed: int = 0) -> list[Stage]:
    """Given `sequences`: split, rank test against training sequences by exact distances, evaluate."""

    def split(t, p):
        return sampling.split_train_test(t["sequences"], p["n_test"], seed=p["seed"])

    def rankings(t, p):
        return ranking.rank_exact(t["split"].where("is_test"), t["split"].where("not is_test"), p["k"], _matrix(p), p["mode"], p["kind"], p["top"])

    return [Stage("split", split, ["sequences"], {"n_test": n_test, "seed": seed}), Stage("rankings", rankings, ["split"], {"k": k, "matrix": matrix, "kind": kind, "mode": mode, "top": top}), Stage("evaluation", evaluate, ["rankings", "split"], {})]


def evaluate(t: dict[str, DataFrame], p: dict) -> DataFrame:
    """Summary of rankings (query_id, subject_id, distance); relevant are training sequences that share a class."""
    c = t["split"].select(F.col("seq_id").cast("string").alias("seq_id"), "is_test", F.explode("classes").alias("class"))
    topics, docs = c.where("is_test").select(F.col("seq_id").alias("topic"), "class"), c.where("not is_test").select(F.col("seq_id").alias("doc"), "class")
    qrels = topics.join(docs, "class").select("topic", "doc", F.lit(1).alias("rel")).distinct()
    r = t["rankings"].select(F.col("query_id").cast("string").alias("topic"), F.col("subject_id").cast("string").alias("doc"), (-F.col("distance")).alias("score"))
    return evaluation.summary(r, qrels, ignore_missing=False)
