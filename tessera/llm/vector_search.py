"""Exact top-k search by inner product with a pivot-distance index.

Vectors are keyed by their nearest pivot and their distance to it, cut into annuli.  For a query q and an annulus of pivot p with
distances in [lo, hi] and norms up to R, the triangle inequality gives |q - v| >= max(0, |q - p| - hi, lo - |q - p|), hence
q.v = (|q|^2 + |v|^2 - |q - v|^2) / 2 is bounded above.  A query's annuli are sorted by that bound and expanded in two rounds: first the
best until they hold enough vectors, whose k-th score then stops the search at every annulus with a smaller bound.

Pivots, the root of the number of vectors over `EACH` and `MOST_PIVOTS` at most, are fitted on a bounded, documented sample (`SAMPLE` vectors of least
id hash); every vector is indexed and the result is exact whatever the pivots are.  What reaches the driver: the sample and one row of
figures per annulus (`MOST_PIVOTS` * `RINGS` at most).  An annulus with many vectors is dealt over parts of about `PART` vectors by id, so one
very common vector is no hot task.  Queries are dealt over blocks by their nearest pivot, so that a block's queries ask for the same annuli;
a part is sent once to each block that asks for it, and to no other.

Components become floor(64 * x).  Rows with a null id, a null vector, or a null or non-finite component take no part.  Vectors of different
lengths are compared over their shared components (as if padded with zeros); an empty vector scores 0.  Ties go to the smaller id.  An id
that is repeated is several candidates, and as a query it is searched once for each of its vectors, with k rows each; rows of its own id are
never its candidates.  Empty tables give no rows; extra columns are not read.  Scores are exact while |q|^2 + |v|^2 is under 2^53.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, materialise

SAMPLE, RINGS, PART = 16_384, 6, 8192
EACH, LEAST_PIVOTS, MOST_PIVOTS = 8, 64, 1024


def _kmeans(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    centres = x[:k].copy()
    for _ in range(rounds):
        near = ((x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)).argmin(1)
        for c in range(len(centres)):
            if (near == c).any():
                centres[c] = x[near == c].mean(0)
    return centres


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of lists, padded with zeros to dim columns."""
    out = np.zeros((len(column), dim))
    if len(column):
        lengths = np.diff(column.offsets.to_numpy())
        flat = column.flatten().to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(column)), lengths)
        out[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def integer_vectors(embeddings: DataFrame) -> DataFrame:
    """vec_id, v: the rows that take part, components floor(64 * x)."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where("vec_id is not null and embedding is not null").where(finite)
    return rows.select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * 64).cast("double")).alias("v"))


class Index:
    """The keyed vectors (a table in the shared folder) and the figures of their annuli."""

    def __init__(self, vectors: DataFrame):
        spark = vectors.sparkSession
        n, dim = vectors.agg(F.count("*"), F.max(F.size("v"))).first()
        self.dim = dim or 0
        sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").toArrow()["v"].combine_chunks()
        x = _matrix(sample.chunk(0) if isinstance(sample, pa.ChunkedArray) else sample, self.dim) if len(sample) else np.zeros((1, self.dim))
        x = x[np.random.default_rng(0).permutation(len(x))]
        self.pivots = _kmeans(x, min(max(LEAST_PIVOTS, min(MOST_PIVOTS, int(n**0.5) // EACH)), len(x)))
        d = np.sqrt(np.maximum(0, ((x * x).sum(1)[:, None] - 2 * x @ self.pivots.T + (self.pivots**2).sum(1)).min(1)))
        self.edges = np.quantile(d, np.arange(1, RINGS) / RINGS)
        pivots, edges, dim = self.pivots, self.edges, self.dim

        def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                m = _matrix(b.column(1), dim)
                d2 = (m * m).sum(1)[:, None] - 2 * m @ pivots.T + (pivots**2).sum(1)
                near = d2.argmin(1)
                dist = np.sqrt(np.maximum(0, d2[np.arange(len(m)), near]))
                ring = np.searchsorted(edges, dist, side="right")
                yield pa.RecordBatch.from_pydict({
                    "vec_id": b.column(0), "cell": pa.array(near * RINGS + ring, pa.int32()), "dist": dist, "norm2": (m * m).sum(1), "v": pa.array([r.tobytes() for r in m.astype("<f8" if len(m) and np.abs(m).max() >= 2**15 else "<i2")], pa.binary()),
                })

        self.table = materialise(vectors.select("vec_id", "v").mapInArrow(keyed, "vec_id long, cell int, dist double, norm2 double, v binary"), "vectors")
        stats = self.table.groupBy("cell").agg(F.count("*").alias("n"), F.min("dist").alias("lo"), F.max("dist").alias("hi"), F.max("norm2").alias("r2")).orderBy("cell").collect()
        self.cells = np.array([r["cell"] for r in stats], np.int64)
        self.n, self.lo, self.hi, self.r2 = (np.array([r[c] for r in stats], float) for c in ("n", "lo", "hi", "r2"))
        self.parts = np.maximum(1, np.ceil(self.n / PART)).astype(np.int64)
        self.spark = spark

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """Upper bounds of the inner products of each query (rows) with each annulus (columns), rounding included."""
        q2 = (q * q).sum(1)[:, None]
        d = np.sqrt(np.maximum(0, q2 - 2 * q @ self.pivots.T + (self.pivots**2).sum(1)))[:, self.cells // RINGS]
        gap = np.maximum(0, np.maximum(d - self.hi, self.lo - d))
        gap = np.maximum(0, gap - 1e-6 * (1 + d))
        return (q2 + self.r2 - gap * gap) / 2 + 1e-6 * (1 + q2 + self.r2)


def unpack(rows: list[bytes], dim: int) -> np.ndarray:
    kinds = {2 * dim: "<i2", 8 * dim: "<f8"}
    if not dim or not rows:
        return np.zeros((len(rows), dim))
    if len({len(r) for r in rows}) == 1:
        return np.frombuffer(b"".join(rows), kinds[len(rows[0])]).reshape(-1, dim).astype(float)
    return np.stack([np.frombuffer(r, kinds[len(r)]).astype(float) for r in rows])


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, block: int = 4096) -> DataFrame:
    """vectors, queries: (vec_id, v) as of `integer_vectors`.  -> query_id, rank, vec_id, score: each query's k highest."""
    index = Index(vectors)
    if not len(index.cells):
        return index.spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dim, cells, parts = index.dim, index.cells, index.parts
    blocks = max(1, -(-queries.count() // block))
    pivots = len(index.pivots)
    order_n = index.n

    def first_annuli(ub: np.ndarray) -> np.ndarray:
        """Which annuli the first round expands: the best by bound, until they hold 4 k vectors."""
        order = np.argsort(-ub, axis=1, kind="stable")
        held = np.cumsum(order_n[order], axis=1)
        take = np.concatenate([np.ones((len(ub), 1), bool), held[:, :-1] < 4 * k + 1], axis=1)
        out = np.zeros_like(take)
        np.put_along_axis(out, order, take, axis=1)
        return out

    index_spark = index.spark
    bound_state = index_spark.sparkContext.broadcast({"pivots": index.pivots, "cells": cells, "lo": index.lo, "hi": index.hi, "r2": index.r2, "parts": parts, "n": order_n})

    def expanded(second: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = Index.__new__(Index)
            own.__dict__.update(bound_state.value)
            for whole in batches:
                for at in range(0, whole.num_rows, 1024):
                    b = whole.slice(at, 1024)
                    q, tau = _matrix(b.column(1), dim), b.column(2).to_numpy(zero_copy_only=False)
                    ub = bounds_of(own, q)
                    first = first_annuli(ub)
                    wanted = ~first & (ub >= tau[:, None]) if second else first
                    r, c = np.nonzero(wanted)
                    times = own.parts[c]
                    r, c = np.repeat(r, times), np.repeat(c, times)
                    part = np.arange(len(r)) - np.repeat(np.cumsum(times) - times, times)
                    ids, which = b.column(0).to_numpy(), b.column(3).to_numpy()
                    # blocks are stretches of queries in order of their nearest pivots, each pivot's dealt by hash
                    near = ((own.pivots**2).sum(1) - 2 * q @ own.pivots.T).argmin(1)
                    mine = ((near + (which & 0xFFFF) / 65536) * blocks / pivots).astype(np.int64)
                    packed = np.array([x.tobytes() for x in q.astype("<f8")] + [b""], object)[:-1]
                    yield pa.RecordBatch.from_pydict({
                        "cell": pa.array(own.cells[c], pa.int32()), "part": pa.array(part, pa.int32()), "block": pa.array(mine[r], pa.int32()), "query_id": pa.array(ids[r], pa.int64()), "which": pa.array(which[r], pa.int64()), "tau": tau[r], "q": pa.array(list(packed[r]), pa.binary()),
                    })

        return run

    bounds_of = Index.bounds
    data = index.table.select("vec_id", "cell", F.lit(0).alias("part"), "v")
    if (parts > 1).any():  # a row for each annulus: bounded
        of_cell = index.spark.createDataFrame([(int(c), int(n)) for c, n in zip(cells, parts, strict=True)], "cell int, parts long")
        data = index.table.join(F.broadcast(of_cell), "cell").select("vec_id", "cell", F.pmod(F.xxhash64("vec_id"), "parts").cast("int").alias("part"), "v")

    def scored(left: pa.Table, right: pa.Table) -> pa.Table:
        """left: queries of a block; right: vectors of a part."""
        found: dict[str, list] = {"query_id": [], "which": [], "vec_id": [], "score": []}
        if left.num_rows and right.num_rows:
            qid, which, tau = left["query_id"].to_numpy(), left["which"].to_numpy(), left["tau"].to_numpy()
            q, vid, v = unpack(left["q"].to_pylist(), dim), right["vec_id"].to_numpy(), unpack(right["v"].to_pylist(), dim)
            for at in range(0, len(qid), 256):
                s = q[at : at + 256] @ v.T
                s[qid[at : at + 256, None] == vid[None, :]] = -np.inf
                # of each query only scores that may be among its k here: the k-th highest of the part, or what the first round left
                least = tau[at : at + 256, None]
                if s.shape[1] > k:
                    least = np.maximum(least, np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k, None])
                r, c = np.nonzero((s >= least) & (s > -np.inf))
                order = np.lexsort((vid[c], -s[r, c], r))
                r, c = r[order], c[order]
                rank = np.arange(len(r)) - np.searchsorted(r, r)
                r, c = r[rank < k], c[rank < k]
                found["query_id"].append(qid[at : at + 256][r])
                found["which"].append(which[at : at + 256][r])
                found["vec_id"].append(vid[c])
                found["score"].append(s[r, c].astype(np.int64))
        return pa.table({n: pa.array(np.concatenate(x) if x else [], pa.int64()) for n, x in found.items()})

    keys = ("cell", "part", "block")

    own = Scratch(index.spark, "search")

    def round_of(asked: DataFrame, second: bool) -> DataFrame:
        sent = asked.mapInArrow(expanded(second), "cell int, part int, block int, query_id long, which long, tau double, q binary")
        if blocks > 1:
            sent = own.write(sent, "sent")
            wanted = data.join(own.write(sent.select(*keys).distinct(), "keys"), ["cell", "part"])
        else:
            wanted = data.withColumn("block", F.lit(0))
        return sent.groupBy(*keys).cogroup(wanted.select("vec_id", "cell", "part", "v", "block").groupBy(*keys)).applyInArrow(scored, "query_id long, which long, vec_id long, score long")

    best = Window.partitionBy("query_id", "which").orderBy(F.col("score").desc(), F.col("vec_id"))
    asked = queries.select(F.col("vec_id").alias("query_id"), "v", F.xxhash64("v").alias("which")).dropDuplicates(["query_id", "v"])
    one = own.write(round_of(asked.select("query_id", "v", F.lit(float("-inf")).alias("tau"), "which"), False), "first")
    tau = one.withColumn("r", F.row_number().over(best)).where(F.col("r") == k).select("query_id", "which", F.col("score").cast("double").alias("tau"))
    two = round_of(asked.join(tau, ["query_id", "which"], "left").select("query_id", "v", F.coalesce("tau", F.lit(float("-inf"))).alias("tau"), "which"), True)
    ranked = one.unionAll(two).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def top_scores(embeddings: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    """The rows whose id is divisible by `every` as queries against all others."""
    vectors = integer_vectors(embeddings)
    return search(vectors, vectors.where(F.col("vec_id") % every == 0), k)


ORACLE = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)) v from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
q as (select distinct vec_id, v from v where vec_id % 20 = 0),
s as (select q.vec_id query_id, q.v q, c.vec_id, list_inner_product(q.v, c.v)::bigint score from q join v c on q.vec_id <> c.vec_id),
r as (select *, row_number() over (partition by query_id, q order by score desc, vec_id)::int rank from s)
select query_id, rank, vec_id, score from r where rank <= 20
"""
