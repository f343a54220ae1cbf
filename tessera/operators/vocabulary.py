"""Vocabularies of prototype words: greedy clustering, encoding, selection, cluster statistics, k-medoids."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.matrices import Matrix
from tessera.operators.kernels import block_distances, numbered, within
from tessera.operators.sampling import number_of, order_of
from tessera.operators.storage import saved, shared_root, superseded

CLUSTERS = "proto_id string, proto_no long, word string, distance int"


def greedy_clusters(words: DataFrame, threshold: int, matrix: Matrix, kind: str = "blosum", increment: int = 1000, seed: int = 0, stop_share: float = 1.0, first: DataFrame | None = None) -> DataFrame:
    """proto_id, proto_no, word, distance: each distinct word under the first prototype of its round within the threshold.

    Words go in order of a hash.  A round takes the next `increment` unallocated words as prototypes (they stay prototypes even if near each
    other) and gives every other unallocated word to the first of them it reaches.  Words farther than the threshold from themselves are left
    out.  It ends when stop_share of the words is allocated; first: prototypes (word) to begin with.  A round costs one pass over what is
    left, and is a part of one table in the shared folder."""
    diag = np.diag(matrix.distances(kind))
    table = F.create_map(*[v for c, d in zip(matrix.symbols, diag, strict=True) for v in (F.lit(c), F.lit(int(d)))])
    own = F.aggregate(F.split("word", ""), F.lit(0), lambda s, c: s + F.coalesce(F.element_at(table, c), F.lit(int(diag[-1]))))
    left = saved(words.select("word").distinct().where(own <= threshold), "words")
    total = left.count()
    spark, taken, made = words.sparkSession, 0, 0
    out, rounds = f"{shared_root(words.sparkSession)}/clusters-{uuid.uuid4().hex}", 0  # a folder of a folder for each round: one table
    while total and taken < total and (not rounds or taken < stop_share * total):
        batch = first.select("word").distinct() if not rounds and first is not None else left.orderBy(order_of("word", seed), "word").limit(increment)
        chosen = [r["word"] for r in batch.orderBy(order_of("word", seed), "word").collect()]
        if not chosen:
            break
        protos = spark.createDataFrame([(f"proto_{made + i + 1}", made + i, w) for i, w in enumerate(chosen)], "proto_id string, proto_no long, word string")
        made += len(chosen)
        self_rows = protos.select("proto_id", "proto_no", "word", F.lit(0).alias("distance"))
        rest = left.join(F.broadcast(protos.select("word")), "word", "left_anti")
        reached = first_within(rest, protos, threshold, matrix, kind)
        self_rows.unionByName(reached.select("proto_id", "proto_no", "word", "distance")).write.parquet(f"{out}/round-{rounds}")
        got = spark.read.schema(CLUSTERS).parquet(f"{out}/round-{rounds}")
        following = saved(left.join(got.select("word"), "word", "left_anti"), "words")
        superseded(left)
        left, rounds = following, rounds + 1
        taken = total - left.count()
    superseded(left)
    return spark.read.schema(CLUSTERS).parquet(f"{out}/*") if rounds else spark.createDataFrame([], CLUSTERS)


def first_within(words: DataFrame, protos: DataFrame, threshold: int, matrix: Matrix, kind: str = "blosum") -> DataFrame:
    """Each word with the first prototype (by proto_no) within the threshold."""
    met = within(words, protos, threshold, matrix, kind)
    return met.groupBy("word").agg(F.min(F.struct("proto_no", "proto_id", "distance")).alias("b")).select("word", "b.proto_id", "b.proto_no", "b.distance")


def recluster(words: DataFrame, protos: DataFrame, threshold: int, matrix: Matrix, kind: str = "blosum", mode: str = "all") -> DataFrame:
    """all: every prototype within the threshold; nearest: the first of the least distance."""
    if mode not in ("all", "nearest"):
        raise ValueError("mode is all or nearest")
    return within(words.select("word").distinct(), protos, threshold, matrix, kind, nearest=mode == "nearest")


def threshold_tree(words: DataFrame, thresholds: list[int], matrix: Matrix, kind: str = "blosum", increment: int = 1, least_size: int = 10, seed: int = 0) -> DataFrame:
    """level, parent, proto_id, word, distance: clusters of the widest threshold, those of least_size words or more clustered again with the
    next one."""
    spark = words.sparkSession
    todo, rows = [("", words.select("word").distinct())], None
    for level, t in enumerate(sorted(thresholds, reverse=True)):
        following = []
        for parent, part in todo:
            found = greedy_clusters(part, t, matrix, kind, increment, seed).withColumn("proto_id", F.concat(F.lit(parent + "/" if parent else ""), "proto_id"))
            found = found.select(F.lit(level).alias("level"), F.lit(parent).alias("parent"), "proto_id", "word", "distance")
            rows = found if rows is None else rows.unionAll(found)
            for r in found.groupBy("proto_id").count().where(F.col("count") >= least_size).orderBy("proto_id").toLocalIterator():
                following.append((r["proto_id"], found.where(F.col("proto_id") == r["proto_id"]).select("word")))
        todo = following
    return rows if rows is not None else spark.createDataFrame([], "level int, parent string, proto_id string, word string, distance int")


class CoverTree:
    """Online insertion: a word goes to the first child that covers it (distance at most the level's threshold), deepest first; below the
    deepest cover a new chain is made."""

    def __init__(self, thresholds: list[int], distance):
        self.thresholds, self.distance, self.root = sorted(thresholds, reverse=True), distance, {"word": None, "children": []}

    def insert(self, word: str) -> list[str]:
        """The words on its path, from the top."""
        node, path = self.root, []
        for t in self.thresholds:
            child = next((c for c in node["children"] if self.distance(c["word"], word) <= t), None)
            if child is None:
                child = {"word": word, "children": []}
                node["children"].append(child)
            path.append(child["word"])
            node = child
        return path


def encode_signatures(words: DataFrame, protos: DataFrame, threshold: int, matrix: Matrix, kind: str = "blosum", nearest: bool = False) -> DataFrame:
    """words (seq_id, word) -> seq_id, features (sorted prototype numbers); distinct words meet prototypes once."""
    met = within(words.select("word").distinct(), protos, threshold, matrix, kind, nearest)
    hits = words.select("seq_id", "word").distinct().join(met.select("word", "proto_no"), "word")
    return hits.groupBy("seq_id").agg(F.array_sort(F.collect_set("proto_no")).alias("features"))


def occurrences(words: DataFrame, protos: DataFrame, threshold: int, matrix: Matrix, kind: str = "blosum") -> DataFrame:
    """words (seq_id, pos, word) -> seq_id, pos, proto_id, distance of every prototype within the threshold."""
    return words.join(within(words.select("word").distinct(), protos, threshold, matrix, kind), "word").select("seq_id", "pos", "proto_id", "distance")


def codebook_subset(words: DataFrame, protos: DataFrame, threshold: int, matrix: Matrix, kind: str = "blosum") -> DataFrame:
    """Prototypes that some word reaches."""
    return protos.join(within(words.select("word").distinct(), protos, threshold, matrix, kind).select("proto_id").distinct(), "proto_id", "left_semi")


def slice_candidates(words: DataFrame, others: DataFrame, slices: int) -> DataFrame:
    """Pairs (word, other) that agree in one of `slices` equal parts: all pairs with fewer mismatches than slices are among them."""
    def cut(df: DataFrame, name: str) -> DataFrame:
        n = F.length(name)
        parts = F.transform(F.sequence(F.lit(0), F.lit(slices - 1)), lambda i: F.substring(F.col(name), (F.floor(i * n / slices) + 1).cast("int"), (F.floor((i + 1) * n / slices) - F.floor(i * n / slices)).cast("int")))
        return df.select(name, n.alias("n"), F.posexplode(parts).alias("slice", "value"))

    one, two = cut(words.select("word").distinct(), "word"), cut(others.select(F.col("word").alias("other")).distinct(), "other")
    return one.join(two, ["n", "slice", "value"]).select("word", "other").distinct()


def hamming_join(words: DataFrame, others: DataFrame, most: int) -> DataFrame:
    """word, other, distance of all pairs with at most `most` mismatches, by slices: no word meets all others."""
    from tessera.functions.scalars import hamming

    return slice_candidates(words, others, most + 1).withColumn("distance", hamming(F.col("word"), F.col("other"))).where(F.col("distance") <= most)


# cluster statistics: clusters (proto_id, word, distance), index (seq_id, pos, word), classes (seq_id, classes)


def cluster_sizes(clusters: DataFrame, index: DataFrame) -> DataFrame:
    """proto_id, n_words, n_instances."""
    n = index.groupBy("word").agg(F.count("*").alias("n"))
    return clusters.join(n, "word", "left").groupBy("proto_id").agg(F.count("*").alias("n_words"), F.sum(F.coalesce("n", F.lit(0))).alias("n_instances"))


def pair_purity(clusters: DataFrame, index: DataFrame, classes: DataFrame) -> DataFrame:
    """proto_id, purity: share of ordered instance pairs (an instance with itself too) whose sequences share a class.

    Pairs are counted by class sets: instances with equal class sets are one row, so the join grows with the kinds of sets, not instances."""
    kinds = clusters.join(index, "word").join(classes, "seq_id").groupBy("proto_id", F.array_sort("classes").alias("classes")).agg(F.count("*").alias("n"))
    other = kinds.select("proto_id", F.col("classes").alias("other"), F.col("n").alias("m"))
    met = kinds.join(other, "proto_id").withColumn("w", F.col("n") * F.col("m"))
    return met.groupBy("proto_id").agg((F.sum(F.when(F.arrays_overlap("classes", "other"), F.col("w")).otherwise(0)) / F.sum("w")).alias("purity"))


def class_counts(clusters: DataFrame, index: DataFrame, classes: DataFrame) -> DataFrame:
    return clusters.join(index, "word").join(classes, "seq_id").select("proto_id", F.explode("classes").alias("class")).groupBy("proto_id", "class").agg(F.count("*").alias("n"))


def majority_purity(counts: DataFrame) -> DataFrame:
    """proto_id, purity (largest class over all), entropy in bits; counts: proto_id, class, n."""
    totals = counts.withColumn("t", F.sum("n").over(Window.partitionBy("proto_id")))
    p = F.col("n") / F.col("t")
    return totals.groupBy("proto_id").agg((F.max("n") / F.max("t")).alias("purity"), (-F.sum(p * F.log2(p))).alias("entropy"))


def distance_bins(clusters: DataFrame, bins: int = 10) -> DataFrame:
    """proto_id, bin (from 1), distance: the element at floor(N * i / bins) of the sorted member distances (1-origin, the first at least)."""
    w = Window.partitionBy("proto_id")
    rows = clusters.withColumn("r", F.row_number().over(w.orderBy("distance", "word"))).withColumn("N", F.count("*").over(w))
    picks = rows.withColumn("bin", F.explode(F.sequence(F.lit(1), F.lit(bins)))).where(F.col("r") == F.greatest(F.floor(F.col("N") * F.col("bin") / bins), F.lit(1)))
    return picks.select("proto_id", "bin", "distance")


def document_frequency(sigs: DataFrame, protos: DataFrame | None = None) -> DataFrame:
    """feature, n: sequences that have it; with protos (proto_no) also those that none has."""
    n = sigs.select(F.explode("features").alias("feature")).groupBy("feature").agg(F.count("*").alias("n"))
    if protos is None:
        return n
    return numbered(protos).select(F.col("proto_no").alias("feature")).join(n, "feature", "left").select("feature", F.coalesce("n", F.lit(0)).alias("n"))


def central_word(pairs: DataFrame) -> DataFrame:
    """pairs (proto_id, word, other, distance) -> proto_id, word, distortion: the word of least mean distance."""
    mean = pairs.groupBy("proto_id", "word").agg(F.avg("distance").alias("distortion"))
    return mean.groupBy("proto_id").agg(F.min(F.struct("distortion", "word")).alias("b")).select("proto_id", "b.word", "b.distortion")


def weight_matrix(clusters: DataFrame) -> DataFrame:
    """proto_id, pos, symbol, p: a position-weight matrix of each cluster."""
    n = clusters.select("proto_id", F.posexplode(F.split("word", "")).alias("pos", "symbol")).groupBy("proto_id", "pos", "symbol").agg(F.count("*").alias("n"))
    return n.select("proto_id", "pos", "symbol", (F.col("n") / F.sum("n").over(Window.partitionBy("proto_id", "pos"))).alias("p"))


def information(weights: DataFrame) -> DataFrame:
    """proto_id, entropy: summed over positions, in bits."""
    return weights.groupBy("proto_id").agg((-F.sum(F.col("p") * F.log2("p"))).alias("entropy"))


def average_linkage(words: list[str], threshold: int, matrix: Matrix, kind: str = "blosum") -> list[int]:
    """One group's clusters: each word to the first cluster whose members' mean distance is at most the threshold, else a new one.  A cluster
    is kept as symbol counts by position, so its mean distance costs no look at its members."""
    d = matrix.distances(kind)
    codes = matrix.code(words)
    counts: list[np.ndarray] = []
    sizes: list[int] = []
    out = []
    for w in codes:
        cost = d[w]
        found = next((c for c, n in enumerate(counts) if (n * cost).sum() <= threshold * sizes[c]), None)
        if found is None:
            found = len(counts)
            counts.append(np.zeros((len(w), len(d))))
            sizes.append(0)
        counts[found][np.arange(len(w)), w] += 1
        sizes[found] += 1
        out.append(found)
    return out


def split_large(clusters: DataFrame, most: int) -> DataFrame:
    """Clusters of over `most` words in parts of about that many, by hash: proto_id, part."""
    n = clusters.groupBy("proto_id").agg(F.ceil(F.count("*") / most).alias("parts"))
    return clusters.join(n, "proto_id").withColumn("part", (number_of("word", 0) % F.col("parts")).cast("int")).drop("parts")


# k-medoids


def medoid(codes: np.ndarray, d: np.ndarray, rng: np.random.Generator | None = None, bandit: bool = False, delta: float = 0.01) -> int:
    """The member of least summed distance; with bandit, by confidence bounds (UCB) on sampled distances, exact where few are left."""
    n = len(codes)
    if not bandit or n < 64:
        return int(block_distances(codes, codes, d).sum(1).argmin())
    rng = rng or np.random.default_rng(0)
    alive, sums, pulls = np.arange(n), np.zeros(n), 0
    scale = float(block_distances(codes[:64], codes[-64:], d).std()) or 1.0
    for j in rng.permutation(n):
        sums[alive] += block_distances(codes[alive], codes[j : j + 1], d)[:, 0]
        pulls += 1
        if pulls % 16 == 0:
            width = scale * np.sqrt(2 * np.log(4 * n * pulls / delta) / pulls)
            means = sums[alive] / pulls
            alive = alive[means - width <= means.min() + width]
            if len(alive) <= 8:
                break
    return int(alive[block_distances(codes[alive], codes, d).sum(1).argmin()])


def k_medoids(words: list[str], seeds: list[str], matrix: Matrix, threshold: int, kind: str = "blosum", iterations: int = 5, greedy: bool = False, bandit: bool = False) -> tuple[list[str], list[int]]:
    """Medoids and each word's medoid (-1: none within the threshold); greedy takes the first within it, else the nearest."""
    d = matrix.distances(kind)
    codes, centres = matrix.code(words), matrix.code(list(dict.fromkeys(seeds)))
    near = np.full(len(words), -1)
    for _ in range(iterations):
        dist = block_distances(codes, centres, d)
        ok = dist <= threshold
        near = np.where(ok.any(1), ok.argmax(1) if greedy else dist.argmin(1), -1)
        keep, new = [], []
        for c in range(len(centres)):
            members = np.flatnonzero(near == c)
            if len(members):
                keep.append(c)
                new.append(codes[members[medoid(codes[members], d, bandit=bandit)]])
        if not new:
            break
        new = np.array(new)
        if new.shape == centres.shape and (new == centres).all():
            break
        centres = new
    dist = block_distances(codes, centres, d)
    ok = dist <= threshold
    near = np.where(ok.any(1), ok.argmax(1) if greedy else dist.argmin(1), -1)
    table = np.array(list(matrix.symbols))
    return ["".join(table[c]) for c in centres], near.tolist()


def group_medoids(df: DataFrame, k: int, matrix: Matrix, threshold: int, kind: str = "blosum", trials: int = 1, seed: int = 0, **options) -> DataFrame:
    """df (group, seq_id, residues) -> group, medoid, word, assigned: k-medoids of each group's words (a domain's sequences), seeded with the
    words of one of its sequences; the trial that assigns most instances stays.  A group is one task and must fit it; others run apart."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        texts = pdf.sort_values("seq_id")["residues"].tolist()
        tiles = [[t[i : i + k] for i in range(len(t) - k + 1)] for t in texts]
        words = sorted({w for t in tiles for w in t})
        usable = [t for t in tiles if t]
        if not words or not usable:
            return pd.DataFrame({"group": [], "medoid": [], "word": [], "assigned": []})
        rng = np.random.default_rng(seed)
        best = None
        for t in range(trials):
            found = k_medoids(words, usable[int(rng.integers(len(usable))) if t else 0], matrix, threshold, kind, **options)
            score = sum(x >= 0 for x in found[1])
            if best is None or score > best[0]:
                best = (score, found)
        centres, near = best[1]
        return pd.DataFrame({"group": pdf["group"].iloc[0], "medoid": [centres[x] if x >= 0 else None for x in near], "word": words, "assigned": [x >= 0 for x in near]})

    return df.select(F.col("group").cast("string"), "seq_id", "residues").groupBy("group").applyInPandas(run, "group string, medoid string, word string, assigned boolean")


def prototypes_of(clusters: DataFrame, index: DataFrame) -> DataFrame:
    """proto_id, word, size: the prototypes (distance 0 members of least number) with their clusters' instances."""
    sizes = cluster_sizes(clusters, index).select("proto_id", F.col("n_instances").alias("size"))
    own = clusters.groupBy("proto_id").agg(F.min(F.struct("distance", "word")).alias("b")).select("proto_id", F.col("b.word").alias("word"))
    return own.join(sizes, "proto_id")
