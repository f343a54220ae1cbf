"""Domains on sequences (extents, 0-origin, both ends included) and merged edges between them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def by_domain(domains: DataFrame, ids: DataFrame) -> DataFrame:
    """Domains whose pfam_id is listed."""
    return domains.join(ids.select(F.col(ids.columns[0]).alias("pfam_id")), "pfam_id", "left_semi")


def sequences_with(sequences: DataFrame, domains: DataFrame) -> DataFrame:
    return sequences.join(domains.select("seq_id"), "seq_id", "left_semi")


def extents(domains: DataFrame) -> DataFrame:
    return domains.select("pfam_id", "seq_id", F.posexplode("extents").alias("n", "e")).select("pfam_id", "seq_id", "n", "e.begin", "e.end")


def subsequences(sequences: DataFrame, domains: DataFrame) -> DataFrame:
    """seq_id (with _n behind), pfam_id, residues of each extent."""
    met = extents(domains).join(sequences.select("seq_id", "residues"), "seq_id")
    return met.select(F.concat("seq_id", F.lit("_"), "n").alias("seq_id"), "pfam_id", F.substring("residues", F.col("begin") + 1, F.col("end") - F.col("begin") + 1).alias("residues"))


def overlapping(instances: DataFrame, domains: DataFrame, k: int) -> DataFrame:
    """instances (seq_id, pos, ...) with the domains whose extents they meet: an equi-join on the sequence, then the interval."""
    return instances.join(extents(domains), "seq_id").where((F.col("begin") <= F.col("pos") + k - 1) & (F.col("pos") <= F.col("end")))


def coverage(instances: DataFrame, domains: DataFrame, k: int) -> DataFrame:
    """instances (proto_id, seq_id, pos) -> pfam_id, n_seqs, n_protos (with an instance in the domain)."""
    seqs = domains.groupBy("pfam_id").agg(F.count_distinct("seq_id").alias("n_seqs"))
    hit = overlapping(instances, domains, k).groupBy("pfam_id").agg(F.count_distinct("proto_id").alias("n_protos"))
    return seqs.join(hit, "pfam_id", "left").select("pfam_id", "n_seqs", F.coalesce("n_protos", F.lit(0)).alias("n_protos"))


def outside(instances: DataFrame, domains: DataFrame, k: int) -> DataFrame:
    """proto_id of prototypes without any instance in a domain."""
    return instances.select("proto_id").distinct().join(overlapping(instances, domains, k).select("proto_id"), "proto_id", "left_anti")


# edges: id1, start1, stop1, id2, start2, stop2 (1-origin)


def cluster_edges(clusters: DataFrame, index: DataFrame, k: int) -> DataFrame:
    """Edges of instances of different words of a cluster, each pair once, on different sequences or places."""
    rows = clusters.select("proto_id", "word").join(index, "word").select("proto_id", "word", "seq_id", "pos")
    other = rows.select("proto_id", F.col("word").alias("word2"), F.col("seq_id").alias("id2"), F.col("pos").alias("pos2"))
    met = rows.join(other, "proto_id").where((F.col("word") != F.col("word2")) & ((F.col("seq_id") < F.col("id2")) | ((F.col("seq_id") == F.col("id2")) & (F.col("pos") < F.col("pos2")))))
    return met.select(F.col("seq_id").alias("id1"), (F.col("pos") + 1).alias("start1"), (F.col("pos") + k).alias("stop1"), "id2", (F.col("pos2") + 1).alias("start2"), (F.col("pos2") + k).alias("stop2")).distinct()


def merge_consecutive(edges: DataFrame) -> DataFrame:
    """Edges of one diagonal whose starts advance by one become one: islands of start1 - row number."""
    keys = ["id1", "id2", "_diagonal"]
    rows = edges.withColumn("_diagonal", F.col("start1") - F.col("start2"))
    rows = rows.withColumn("_island", F.col("start1") - F.row_number().over(Window.partitionBy(*keys).orderBy("start1")))
    return rows.groupBy(*keys, "_island").agg(F.min("start1").alias("start1"), F.max("stop1").alias("stop1"), F.min("start2").alias("start2"), F.max("stop2").alias("stop2")).select("id1", "start1", "stop1", "id2", "start2", "stop2")


def merge_overlapping(edges: DataFrame) -> DataFrame:
    """Edges of a pair of sequences in order of starts: the next is taken in while both its starts are at most one after the stops so far.
    That depends on the order, so a pair's edges are one group; pairs run apart."""

    def run(table: pa.Table) -> pa.Table:
        columns = {n: table[n].to_numpy() for n in ("start1", "stop1", "start2", "stop2")}
        order = np.lexsort((columns["start2"], columns["start1"]))
        out: list[list[int]] = []
        for a, b, c, d in zip(*(x[order].tolist() for x in columns.values()), strict=True):
            if out and a <= out[-1][1] + 1 and c <= out[-1][3] + 1:
                out[-1][1], out[-1][3] = max(out[-1][1], b), max(out[-1][3], d)
            else:
                out.append([a, b, c, d])
        a, b, c, d = (pa.array(x, pa.int32()) for x in zip(*out, strict=True))
        ids = [pa.array([table[n][0].as_py()] * len(out), pa.string()) for n in ("id1", "id2")]
        return pa.table([ids[0], a, b, ids[1], c, d], names=["id1", "start1", "stop1", "id2", "start2", "stop2"])

    return edges.groupBy("id1", "id2").applyInArrow(run, "id1 string, start1 int, stop1 int, id2 string, start2 int, stop2 int")
