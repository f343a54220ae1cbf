"""Blocks of word distances in NumPy, and joins of words to prototypes built on them.

Prototypes are broadcast in parts of at most `PART` words, so the broadcast's size is bounded; a larger vocabulary is taken in parts, each a
pass over the words.  Words should be distinct before they come here (see `tiling.distinct_kmers`)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.matrices import Matrix
from tessera.operators.storage import running

PART = 50_000
BLOCK = 256


def block_distances(x: np.ndarray, y: np.ndarray, d: np.ndarray) -> np.ndarray:
    """(n, k) and (m, k) codes -> (n, m) distances: each position's symbol distances added up."""
    out = np.zeros((len(x), len(y)), np.int32)
    for j in range(x.shape[1] if x.ndim == 2 else 0):
        out += d[:, y[:, j]][x[:, j]]
    return out


def _parts(protos: DataFrame, part: int) -> Iterator[list[tuple]]:
    rows: list[tuple] = []
    for r in protos.select("proto_id", "proto_no", "word").toLocalIterator():
        rows.append(tuple(r))
        if len(rows) == part:
            yield rows
            rows = []
    if rows:
        yield rows


def numbered(protos: DataFrame) -> DataFrame:
    """proto_no, where it isn't there: the rank by id, for ties and feature numbers."""
    return protos if "proto_no" in protos.columns else running(protos.withColumn("_one", F.lit(1)), "proto_id", "_one", "_no").withColumn("proto_no", F.col("_no") - 1).drop("_one", "_no")


def within(words: DataFrame, protos: DataFrame, threshold: int, matrix: Matrix, kind: str = "blosum", nearest: bool = False, part: int = PART) -> DataFrame:
    """word, proto_id, proto_no, distance: all prototypes at most threshold away, or with nearest the first of the least distance.

    words: a column word of one length; other columns stay behind.  No shuffle, but for nearest over several parts."""
    d = matrix.distances(kind)
    words = words.select("word")
    out = None
    for rows in _parts(numbered(protos), part):
        rows.sort(key=lambda r: r[1])
        shared = words.sparkSession.sparkContext.broadcast((rows, matrix.code([r[2] for r in rows])))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own, codes = shared.value
            ids, nos = np.array([r[0] for r in own], object), np.array([r[1] for r in own], np.int64)
            for b in batches:
                every = b.column(0).to_pylist()
                for at in range(0, len(every), BLOCK):
                    some = every[at : at + BLOCK]
                    dist = block_distances(matrix.code(some), codes, d)
                    if nearest:
                        j = dist.argmin(1)
                        i = np.arange(len(some))
                        good = dist[i, j] <= threshold
                        i, j = i[good], j[good]
                    else:
                        i, j = np.nonzero(dist <= threshold)
                    yield pa.RecordBatch.from_pydict({
                        "word": pa.array([some[x] for x in i], pa.string()), "proto_id": pa.array(ids[j].tolist(), pa.string()), "proto_no": pa.array(nos[j]), "distance": pa.array(dist[i, j], pa.int32()),
                    })

        one = words.mapInArrow(run, "word string, proto_id string, proto_no long, distance int")
        out = one if out is None else out.unionAll(one)
    if out is None:
        return words.sparkSession.createDataFrame([], "word string, proto_id string, proto_no long, distance int")
    if nearest:
        best = F.min(F.struct("distance", "proto_no", "proto_id")).alias("b")
        out = out.groupBy("word").agg(best).select("word", "b.proto_id", "b.proto_no", "b.distance")
    return out


def pair_minima(q: np.ndarray, s: np.ndarray, k: int, d: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Row and column minima of the k-mer distance matrix of two code sequences; None if either has no k-mer.

    Along a diagonal a k-mer distance is a difference of running sums, so the matrix takes O(mn) whatever k is."""
    if len(q) < k or len(s) < k:
        return None
    cell = d[q][:, s].astype(np.int32)
    run = np.zeros((len(q) + 1, len(s) + 1), np.int32)
    for i in range(len(q)):
        run[i + 1, 1:] = run[i, :-1] + cell[i]
    full = run[k:, k:] - run[:-k, :-k]
    return full.min(1), full.min(0)


def pair_matrix(q: np.ndarray, s: np.ndarray, k: int, d: np.ndarray) -> np.ndarray:
    """The k-mer distance matrix itself."""
    return block_distances(np.lib.stride_tricks.sliding_window_view(q, k), np.lib.stride_tricks.sliding_window_view(s, k), d)


def align(q: np.ndarray, s: np.ndarray, sim: np.ndarray, gap_open: int = -10, gap_extend: int = -1, local: bool = False) -> int:
    """Score of the best global or local alignment with affine gaps: a gap of n costs open + n * extend.  Row by row; within a row the gaps
    in q come from a running maximum."""
    m = len(s)
    far = -(10**9)
    j = np.arange(m + 1)
    h = np.zeros(m + 1, np.int64) if local else np.where(j == 0, 0, gap_open + j * gap_extend).astype(np.int64)
    v = np.full(m + 1, far, np.int64)
    best = 0
    for i in range(1, len(q) + 1):
        v = np.maximum(v + gap_extend, h + gap_open + gap_extend)
        new = np.full(m + 1, far, np.int64)
        new[1:] = h[:-1] + sim[q[i - 1], s]
        new = np.maximum(new, v)
        if local:
            new = np.maximum(new, 0)
            new[0] = 0
        else:
            new[0] = gap_open + i * gap_extend
        # a gap along the row: max over l < j of new[l] + open + (j - l) * extend
        reach = np.maximum.accumulate(new - j * gap_extend)
        gap = np.full(m + 1, far, np.int64)
        gap[1:] = reach[:-1] + gap_open + j[1:] * gap_extend
        h = np.maximum(new, gap)
        if local:
            best = max(best, int(h.max()))
    return best if local else int(h[m])
