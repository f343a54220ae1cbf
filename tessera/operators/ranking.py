"""Top-k per query, and rankings through posting lists."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tessera.functions.matrices import Matrix
from tessera.operators import bags, pairwise
from tessera.operators.kernels import within
from tessera.operators.storage import input_bytes
from tessera.operators.tiling import kmers, word_counts


def top_k(pairs: DataFrame, k: int, query: str = "query_id", subject: str = "subject_id", distance: str = "distance", exclude_self: bool = False) -> DataFrame:
    """The k least distances of each query, ties to the smaller subject, with rank from 1.  Spark limits each partition's groups to k before
    the shuffle."""
    if exclude_self:
        pairs = pairs.where(F.col(query) != F.col(subject))
    w = Window.partitionBy(query).orderBy(F.col(distance), F.col(subject))
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def shared_features(queries: DataFrame, subjects: DataFrame) -> DataFrame:
    """(seq_id, features) tables -> query_id, subject_id, shared, query_n, subject_n, for pairs that share a feature: a posting-list join.

    Exploded sides are larger than the optimizer thinks, so this join is never a broadcast one; adaptive execution splits common features."""
    def long(df: DataFrame, p: str) -> DataFrame:
        return df.select(F.col("seq_id").alias(f"{p}_id"), F.size("features").alias(f"{p}_n"), F.explode("features").alias("feature"))

    met = long(queries, "query").join(long(subjects, "subject").hint("merge"), "feature")
    return met.groupBy("query_id", "subject_id").agg(F.count("*").alias("shared"), F.max("query_n").alias("query_n"), F.max("subject_n").alias("subject_n"))


#: Features up to which signatures are compared as bits; bytes of the query bits that are broadcast at once, and of what a task keeps of the
#: nearest subjects of these; rows of either side that are compared at once.
DENSE, QUERY_BYTES, NEAREST_BYTES, TILE = 4096, 16 << 20, 64 << 20, 1024
#: Bytes of subjects a partition.
PART_BYTES = 64 << 20


def _bits(features: list, index: dict, width: int) -> np.ndarray:
    """Rows of features as zeros and ones; features that no query has are left out."""
    out = np.zeros((len(features), width), bool)
    for r, row in enumerate(features):
        out[r, [index[f] for f in row or () if f in index]] = True
    return out


class _Nearest:
    """The k nearest subjects of each query of a block, of subjects that come in ascending order of their ids.

    A subject whose distance equals the last one kept has the greater id, so only smaller distances get in, however many ties there are.  With
    a of n + m - a features shared by the last one kept, a subject that shares b, of m' features, is nearer where b (n + m) - a (n + m') > 0:
    one product of matrices of integers, which floats hold exactly."""

    def __init__(self, bits: np.ndarray, sizes: np.ndarray, k: int):
        self.bits, self.sizes, self.k, n = bits, sizes, k, len(bits)
        self.distance = np.full((n, k), np.inf)
        self.place, self.shared, self.other = (np.zeros((n, k), np.int32) for _ in range(3))
        self.most = 1  # features of a signature so far

    def add(self, bits: np.ndarray, sizes: np.ndarray, first: int, same: np.ndarray) -> None:
        """Subjects from place `first` on; same: pairs (query, subject) that don't count, in order."""
        self.most = max(self.most, int(sizes.max(initial=0)), int(self.sizes.max(initial=0)))
        kind = np.float32 if 2 * self.most * min(self.most, self.bits.shape[1]) < 1 << 24 else np.float64
        right = np.concatenate([bits, np.ones((len(bits), 1)), sizes[:, None]], axis=1).astype(kind)
        for at in range(0, len(self.bits), TILE):
            own, n = self.bits[at : at + TILE], self.sizes[at : at + TILE]
            full = np.isfinite(self.distance[at : at + TILE, -1])
            a = np.where(full, self.shared[at : at + TILE, -1], 0)
            scale = np.where(full, n + self.other[at : at + TILE, -1], 1)
            left = np.concatenate([own * scale[:, None], (-a * n)[:, None], -a[:, None]], axis=1).astype(kind)
            nearer = left @ right.T > 0.5
            x, y = same[:, np.searchsorted(same[0], at) : np.searchsorted(same[0], at + TILE)]
            nearer[x - at, y] = False
            r, c = np.divmod(np.flatnonzero(nearer), len(bits))
            if len(r):
                both = np.concatenate([(own[r[i : i + TILE]] & bits[c[i : i + TILE]]).sum(1) for i in range(0, len(r), TILE)])
                self._merge(at + r, both, sizes[c], first + c)

    def _merge(self, r: np.ndarray, shared: np.ndarray, other: np.ndarray, place: np.ndarray) -> None:
        rows = np.unique(r)
        kept_r, kept_c = np.nonzero(np.isfinite(self.distance[rows]))
        kept = rows[kept_r], kept_c
        d = np.concatenate([self.distance[kept], 1 - shared / (self.sizes[r] + other - shared)])
        columns = [np.concatenate([old[kept], new]) for old, new in ((self.place, place), (self.shared, shared), (self.other, other))]
        r = np.concatenate([kept[0], r])
        order = np.lexsort((columns[0], d, r))
        r = r[order]
        starts = np.flatnonzero(np.concatenate(([True], r[1:] != r[:-1])))
        rank = np.arange(len(r)) - np.repeat(starts, np.diff(np.append(starts, len(r))))
        best = rank < self.k
        to, order = (r[best], rank[best]), order[best]
        self.distance[to] = d[order]
        for old, new in zip((self.place, self.shared, self.other), columns, strict=True):
            old[to] = new[order]


def _near_signatures(queries: DataFrame, subjects: DataFrame, features: list, k: int, exclude_self: bool) -> DataFrame:
    """query_id, subject_id, distance of each query's k nearest of every partition of subjects (ties to the smaller id), by products of bit
    matrices.  Queries are taken in blocks of `QUERY_BYTES`, each against all subjects, in tiles of `TILE` by `TILE`."""
    index, width = {f: i for i, f in enumerate(features)}, len(features)
    if exclude_self:  # as a comparison with null would
        queries, subjects = queries.where("seq_id is not null"), subjects.where("seq_id is not null")
    kinds = {n: dict(t.dtypes)["seq_id"] for n, t in (("query_id", queries), ("subject_id", subjects))}
    id_type = to_arrow_type(queries.schema["seq_id"].dataType)
    block = max(1, min(QUERY_BYTES // (4 * width), NEAREST_BYTES // (20 * k)))
    spark, out = subjects.sparkSession, None
    parts = max(spark.sparkContext.defaultParallelism, input_bytes(subjects) // PART_BYTES + 1)
    ordered = subjects.select("seq_id", "features").repartition(parts, "seq_id").sortWithinPartitions("seq_id")

    def against(ids: list, held: list[np.ndarray], counts: list[int]) -> DataFrame:
        shared = spark.sparkContext.broadcast((pa.array(ids, id_type), np.concatenate([np.empty((0, width), bool), *held]), np.array(counts, np.int64)))

        def run(batches):
            names, bits, sizes = shared.value
            nearest, seen, met = _Nearest(bits, sizes, k), 0, []
            places: dict = {}
            for i, v in enumerate(names.to_pylist() if exclude_self else ()):
                places.setdefault(v, []).append(i)
            for whole in batches:
                at = 0
                while at < whole.num_rows:  # of the first subjects all that share a feature are near: few at once
                    b = whole.slice(at, min(TILE, max(64, seen)))
                    rows = b.column(1).to_pylist()
                    same = np.array(sorted((i, j) for j, v in enumerate(b.column(0).to_pylist()) for i in places.get(v, ())), np.int64).reshape(-1, 2).T
                    nearest.add(_bits(rows, index, width), np.array([len(x or ()) for x in rows], np.int64), seen, same)
                    met.append(b.column(0))
                    at, seen = at + b.num_rows, seen + b.num_rows
            if not seen:
                return
            others = pa.concat_arrays(met)
            for at in range(0, len(names), TILE):
                d = nearest.distance[at : at + TILE]
                r, c = np.nonzero(np.isfinite(d))
                yield pa.RecordBatch.from_arrays([names.take(pa.array(at + r)), others.take(pa.array(nearest.place[at + r, c])), pa.array(d[r, c])], names=["query_id", "subject_id", "distance"])

        return ordered.mapInArrow(run, f"query_id {kinds['query_id']}, subject_id {kinds['subject_id']}, distance double")

    ids, held, rows, counts = [], [], [], []
    for row in queries.select("seq_id", F.coalesce("features", F.array()).alias("features")).toLocalIterator():
        ids.append(row["seq_id"])
        rows.append(row["features"])
        counts.append(len(rows[-1]))
        if len(rows) == TILE or len(ids) == block:
            held.append(_bits(rows, index, width))
            rows = []
        if len(ids) == block:
            out = against(ids, held, counts) if out is None else out.unionAll(against(ids, held, counts))
            ids, held, counts = [], [], []
    if ids or out is None:
        held.append(_bits(rows, index, width))
        out = against(ids, held, counts) if out is None else out.unionAll(against(ids, held, counts))
    return out


def rank_signatures(queries: DataFrame, subjects: DataFrame, k: int = 1000, exclude_self: bool = False, dense: int = DENSE) -> DataFrame:
    """query_id, subject_id, distance = 1 - Jaccard, rank; of pairs that share a feature.

    Where the queries have at most `dense` features in all (counted first), each posting list holds a good part of all rows: signatures then
    are compared as bits.  Otherwise through posting lists."""
    found = [r["f"] for r in queries.select(F.explode("features").alias("f")).where("f is not null").distinct().limit(dense + 1).collect()]
    if found and len(found) <= dense:
        return top_k(_near_signatures(queries, subjects, sorted(found), k, exclude_self), k, exclude_self=exclude_self)
    met = shared_features(queries, subjects)
    d = 1 - F.col("shared") / (F.col("query_n") + F.col("subject_n") - F.col("shared"))
    return top_k(met.select("query_id", "subject_id", d.alias("distance")), k, exclude_self=exclude_self)


#: Distinct query words that are broadcast to find the subjects' words that matter; beyond it the words are joined by a shuffle.
BROADCAST_WORDS = 2_000_000


def rank_words(queries: DataFrame, subjects: DataFrame, k_symbols: int, k: int = 1000, most: int = BROADCAST_WORDS) -> DataFrame:
    """Sequences (seq_id, residues) ranked by 1 - Jaccard of their sets of words: query_id, subject_id, distance, rank.

    The queries' words are counted first.  Up to `most` of them are broadcast, so that of the subjects only words that some query has leave
    the stage that reads them; beyond, all words meet in a shuffle.  The size of each set comes from counts, not from words."""
    q = kmers(queries.select("seq_id", "residues"), k_symbols).where("word is not null and seq_id is not null").select(F.col("seq_id").alias("query_id"), "word").distinct()
    s = kmers(subjects.select("seq_id", "residues"), k_symbols).where("word is not null and seq_id is not null").select(F.col("seq_id").alias("subject_id"), "word")
    asked = q.select("word").distinct()
    if asked.count() <= most:
        s = s.join(F.broadcast(asked), "word", "left_semi")
    met = s.distinct().join(q.hint("merge"), "word").groupBy("query_id", "subject_id").agg(F.count("*").alias("shared"))
    qn, sn = (word_counts(x, k_symbols).select(F.col("seq_id").alias(f"{p}_id"), F.col("n_distinct").alias(f"{p}_n")) for p, x in (("query", queries), ("subject", subjects)))
    met = met.join(qn, "query_id").join(sn, "subject_id")
    return top_k(met.select("query_id", "subject_id", (1 - F.col("shared") / (F.col("query_n") + F.col("subject_n") - F.col("shared"))).alias("distance")), k)


def rank_feature_vectors(queries: DataFrame, subjects: DataFrame, k: int = 1000) -> DataFrame:
    """(seq_id, key, weight) tables -> distance = minus the dot product."""
    q = queries.select(F.col("seq_id").alias("query_id"), "key", F.col("weight").alias("a"))
    s = subjects.select(F.col("seq_id").alias("subject_id"), "key", F.col("weight").alias("b"))
    met = q.join(s.hint("merge"), "key").groupBy("query_id", "subject_id").agg((-F.sum(F.col("a") * F.col("b"))).alias("distance"))
    return top_k(met, k)


def rank_bags(queries: DataFrame, subjects: DataFrame, k: int, mode: str = "d2", fragment: int | None = None, agg: str = "BestOfBest", top: int = 500, background: dict[str, float] | None = None) -> DataFrame:
    """Sequences (seq_id, residues) ranked by a bag-of-words mode."""
    q, s = bags.term_vectors(queries, k, fragment), bags.term_vectors(subjects, k, fragment)
    return top_k(bags.over_fragments(bags.fragment_distances(q, s, mode, background), agg), top)


def rank_exact(queries: DataFrame, subjects: DataFrame, k: int, matrix: Matrix, mode: str = "HausdorffAverageAverage", kind: str = "blosum", top: int = 500, threshold: int | None = None, default: int | None = None) -> DataFrame:
    """All pairs by k-mer minima; queries are taken in blocks against all subjects."""
    return top_k(pairwise.distances(queries, subjects, k, matrix, mode, kind, threshold, default), top)


def rank_fragments(fragments: DataFrame, k: int) -> DataFrame:
    """fragments (query_id, subject_id, qfrag, sfrag, similarity): each pair by its best fragments, then the k best subjects of a query:
    query_id, subject_id, qfrag, sfrag, distance (minus the similarity), rank."""
    best = fragments.groupBy("query_id", "subject_id").agg(F.max_by(F.struct("qfrag", "sfrag"), F.struct("similarity", -F.col("qfrag"), -F.col("sfrag"))).alias("b"), (-F.max("similarity")).alias("distance"))
    return top_k(best, k).select("query_id", "subject_id", "b.qfrag", "b.sfrag", "distance", "rank")


def candidates(queries: DataFrame, subjects: DataFrame) -> DataFrame:
    """Pairs of signatures (seq_id, features) that share any feature."""
    return shared_features(queries, subjects).select("query_id", "subject_id")


def rank_indexed(queries: DataFrame, subjects: DataFrame, query_sigs: DataFrame, subject_sigs: DataFrame, k: int, matrix: Matrix, mode: str = "HausdorffAverageAverage", kind: str = "blosum", top: int = 500) -> DataFrame:
    """Exact distances of the candidates only: both texts join the candidate pairs, and each pair goes to the kernel."""
    pairs = candidates(query_sigs, subject_sigs)
    q = queries.select(F.col("seq_id").cast("string").alias("query_id"), F.col("residues").alias("x"))
    s = subjects.select(F.col("seq_id").cast("string").alias("subject_id"), F.col("residues").alias("y"))
    rows = pairs.join(q, "query_id").join(s, "subject_id").select("query_id", "subject_id", "x", "y")
    d = matrix.distances(kind)

    def run(batches):
        from tessera.operators.kernels import pair_minima

        code = pairwise._coder(matrix)
        for b in batches:
            found = []
            for query, subject, x, y in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                m = pair_minima(code(x), code(y), k, d)
                if m is not None:
                    found.append((query, subject, m[0].tolist(), m[1].tolist()))
            if found:
                c = list(zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c[0]), pa.array(c[1]), pa.array(c[2], pa.list_(pa.int32())), pa.array(c[3], pa.list_(pa.int32()))], names=["query_id", "subject_id", "row_min", "col_min"])

    minima = rows.mapInArrow(run, "query_id string, subject_id string, row_min array<int>, col_min array<int>")
    return top_k(minima.select("query_id", "subject_id", pairwise.combine()[mode].alias("distance")), top)


def rank_codebook(queries: DataFrame, subjects: DataFrame, protos: DataFrame, k: int, matrix: Matrix, threshold: int, default: int, fragment: int, kind: str = "blosum", top: int = 1000) -> DataFrame:
    """Through a codebook: a query word meets the words whose cluster it reaches; true word distances under the default decide.

    The reach is a join on the cluster, so no word meets all others."""
    qw, sw = kmers(queries.select("seq_id", "residues"), k), kmers(subjects.select("seq_id", "residues"), k)
    reach = within(qw.select("word").distinct(), protos, threshold, matrix, kind).select(F.col("word").alias("qword"), "proto_id")
    members = within(sw.select("word").distinct(), protos, threshold, matrix, kind).select(F.col("word").alias("sword"), "proto_id")
    met = reach.join(members, "proto_id").select("qword", "sword").distinct()
    d = matrix.distances(kind)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            x, y = matrix.code(b.column(0).to_pylist()), matrix.code(b.column(1).to_pylist())
            dist = d[x, y].sum(1) if len(x) else np.empty(0, int)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(dist, pa.int32())], names=["qword", "sword", "d"])

    near = met.mapInArrow(run, "qword string, sword string, d int").where(F.col("d") < default)
    q = qw.select(F.col("seq_id").alias("query_id"), F.col("pos").alias("qpos"), F.col("word").alias("qword"))
    s = sw.select(F.col("seq_id").alias("subject_id"), F.col("pos").alias("spos"), F.col("word").alias("sword"))
    hits = near.join(q, "qword").join(s, "sword").select("query_id", "qpos", "subject_id", "spos", "d")
    lengths = queries.select("seq_id", (F.length("residues") - k + 1).alias("n")).unionByName(subjects.select("seq_id", (F.length("residues") - k + 1).alias("n"))).distinct()
    return top_k(pairwise.weighted_average(hits, lengths, fragment, default), top)
