"""Distances of sequence pairs from the minima of their k-mer distances.

Two forms give the same numbers: a NumPy kernel under mapInArrow, linear in the cells of a pair whatever k is, and a relational one
(symbols joined along diagonals, running sums) that SQL can check.  Queries go to the kernel in broadcast parts of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.matrices import Matrix
from tessera.operators.bags import over_fragments
from tessera.operators.kernels import align, pair_matrix, pair_minima
from tessera.operators.storage import input_bytes

QUERY_BYTES = 16 << 20
REDUCERS = {"min": np.min, "max": np.max, "mean": np.mean}
_PAIR = "query_id string, subject_id string, "


def _query_parts(queries: DataFrame) -> Iterator[list[tuple[str, str]]]:
    part: list[tuple[str, str]] = []
    size = 0
    for id_, text in queries.select(F.col("seq_id").cast("string"), "residues").toLocalIterator():
        if part and size + len(text) > QUERY_BYTES:
            yield part
            part, size = [], 0
        part.append((id_, text))
        size += len(text)
    if part:
        yield part


def over_pairs(queries: DataFrame, subjects: DataFrame, work, columns: str, code) -> DataFrame:
    """work(query codes, subject codes) -> a list of rows (tuples of `columns`), for every pair of (seq_id, residues) tables."""
    out = None
    schema = _PAIR + columns
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [{"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64()}.get(c.split()[1]) or pa.list_(pa.int32()) for c in schema.split(", ")]
    spark = subjects.sparkSession
    rows = subjects.select(F.col("seq_id").cast("string").alias("seq_id"), "residues")
    # pairs cost far more than moving their subjects: deal these evenly, over all cores at least
    rows = rows.repartition(max(2 * spark.sparkContext.defaultParallelism, input_bytes(rows) >> 23))
    for part in _query_parts(queries):
        shared = spark.sparkContext.broadcast([(i, code(t)) for i, t in part])

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                found: list[tuple] = []
                for subject, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    s = code(text or "")
                    for query, q in shared.value:
                        found += [(query, subject, *r) for r in work(q, s)]
                    if len(found) > 20_000:
                        yield _batch(found, names, kinds)
                        found = []
                if found:
                    yield _batch(found, names, kinds)

        one = rows.mapInArrow(run, schema)
        out = one if out is None else out.unionAll(one)
    return out if out is not None else spark.createDataFrame([], schema)


def _batch(rows: list[tuple], names: list[str], kinds: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def _coder(matrix: Matrix):
    return lambda text: matrix.code([text])[0] if text else np.empty(0, np.uint8)


def minima(queries: DataFrame, subjects: DataFrame, k: int, matrix: Matrix, kind: str = "blosum") -> DataFrame:
    """query_id, subject_id, row_min, col_min (arrays by position); pairs with a sequence shorter than k are left out."""
    d = matrix.distances(kind)

    def work(q, s):
        found = pair_minima(q, s, k, d)
        return [] if found is None else [(found[0].tolist(), found[1].tolist())]

    return over_pairs(queries, subjects, work, "row_min array<int>, col_min array<int>", _coder(matrix))


def matrix_cells(queries: DataFrame, subjects: DataFrame, k: int, matrix: Matrix, kind: str = "blosum") -> DataFrame:
    """query_id, subject_id, i, j, d: the whole matrix of every pair."""
    d = matrix.distances(kind)

    def work(q, s):
        if len(q) < k or len(s) < k:
            return []
        m = pair_matrix(q, s, k, d)
        return [(i, j, int(m[i, j])) for i in range(m.shape[0]) for j in range(m.shape[1])]

    return over_pairs(queries, subjects, work, "i int, j int, d int", _coder(matrix))


def diagonal_cells(queries: DataFrame, subjects: DataFrame, k: int, symbols: DataFrame) -> DataFrame:
    """The same by joins: symbols (a, b, dist).  Running sums along a diagonal, a difference of two of them for each window of k."""
    def spelled(df: DataFrame, prefix: str) -> DataFrame:
        return df.select(F.col("seq_id").alias(f"{prefix}_id"), F.posexplode(F.split("residues", "")).alias(f"{prefix}p", f"{prefix}c"))

    one, two = spelled(queries, "q"), spelled(subjects, "s")
    cells = one.join(symbols, one["qc"] == symbols["a"]).join(two, two["sc"] == symbols["b"]).select("q_id", "s_id", "qp", "sp", "dist")
    w = Window.partitionBy("q_id", "s_id", F.col("sp") - F.col("qp")).orderBy("qp")
    run = F.sum("dist").over(w.rowsBetween(Window.unboundedPreceding, 0))
    summed = cells.withColumn("_run", run).withColumn("_n", F.row_number().over(w))
    d = F.col("_run") - F.coalesce(F.lag("_run", k).over(w), F.lit(0))
    return summed.withColumn("d", d).where(F.col("_n") >= k).select(F.col("q_id").alias("query_id"), F.col("s_id").alias("subject_id"), (F.col("qp") - k + 1).alias("i"), (F.col("sp") - k + 1).alias("j"), F.col("d").cast("int").alias("d"))


def clamp(d: Column, threshold: int | None, default: int | None) -> Column:
    """Distances over the threshold become the default."""
    return d if threshold is None else F.when(d > threshold, F.lit(default)).otherwise(d)


def combine(row_min: str = "row_min", col_min: str = "col_min", threshold: int | None = None, default: int | None = None) -> dict[str, Column]:
    """Distance columns by mode, from the arrays of minima."""
    cut = lambda c: F.transform(c, lambda x: clamp(x, threshold, default))
    r, c = cut(row_min), cut(col_min)
    mean = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda s, v: s + v) / F.size(x)
    return {
        "BestOfBest": clamp(F.array_min(row_min), threshold, default).cast("double"),
        "Hausdorff": F.greatest(F.array_max(r), F.array_max(c)).cast("double"),
        "HausdorffAverage": F.greatest(mean(r), mean(c)),
        "HausdorffAverageAverage": (mean(r) + mean(c)) / 2,
    }


MODES = ("BestOfBest", "Hausdorff", "HausdorffAverage", "HausdorffAverageAverage")


def distances(queries: DataFrame, subjects: DataFrame, k: int, matrix: Matrix, mode: str = "HausdorffAverageAverage", kind: str = "blosum", threshold: int | None = None, default: int | None = None) -> DataFrame:
    """query_id, subject_id, distance."""
    return minima(queries, subjects, k, matrix, kind).select("query_id", "subject_id", combine(threshold=threshold, default=default)[mode].alias("distance"))


def reduced(minima_: DataFrame, reduce: str = "mean", combine_: str = "mean") -> DataFrame:
    """distance: a reducer (min, max, mean) over each array of minima, then a combiner of the two."""
    mean = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda s, v: s + v) / F.size(x)
    one = {"min": F.array_min, "max": F.array_max, "mean": mean}[reduce]
    r, c = one(F.col("row_min")).cast("double"), one(F.col("col_min")).cast("double")
    both = {"min": F.least(r, c), "max": F.greatest(r, c), "mean": (r + c) / 2}[combine_]
    return minima_.select("query_id", "subject_id", both.alias("distance"))


def threshold_jaccard(minima_: DataFrame, threshold: int) -> DataFrame:
    """1 - mean share of row and column minima at or under the threshold."""
    share = lambda x: F.size(F.filter(x, lambda v: v <= threshold)) / F.size(x)
    return minima_.select("query_id", "subject_id", (1 - (share("row_min") + share("col_min")) / 2).alias("distance"))


def two_level(cells: DataFrame, k: int, fragment: int, kmer_mode: str = "Hausdorff", frag_mode: str = "HausdorffAverage", lengths: DataFrame | None = None) -> DataFrame:
    """cells (query_id, subject_id, i, j, d) -> distance: kmer_mode within each pair of fragments of `fragment` k-mers, averages rounded to
    whole numbers, then frag_mode over the fragment distances."""
    rows = cells.withColumn("fq", F.floor(F.col("i") / fragment)).withColumn("fs", F.floor(F.col("j") / fragment))

    def level(df: DataFrame, keys: list[str], x: str, y: str, d: str, mode: str, rounded: bool) -> DataFrame:
        mins = df.groupBy(*keys, x).agg(F.min(d).alias("m")).groupBy(*keys).agg(F.max("m").alias("rmax"), F.avg("m").alias("ravg"), F.min("m").alias("best"))
        cols = df.groupBy(*keys, y).agg(F.min(d).alias("m")).groupBy(*keys).agg(F.max("m").alias("cmax"), F.avg("m").alias("cavg"))
        value = {"BestOfBest": F.col("best"), "Hausdorff": F.greatest("rmax", "cmax"), "HausdorffAverage": F.greatest("ravg", "cavg"), "HausdorffAverageAverage": (F.col("ravg") + F.col("cavg")) / 2}[mode]
        return mins.join(cols, keys).select(*keys, (F.round(value) if rounded else value).cast("double").alias("fd"))

    inner = level(rows, ["query_id", "subject_id", "fq", "fs"], "i", "j", "d", kmer_mode, True)
    return level(inner, ["query_id", "subject_id"], "fq", "fs", "fd", frag_mode, False).withColumnRenamed("fd", "distance")


def fragment_minima(hits: DataFrame, fragment: int) -> DataFrame:
    """hits (query_id, qpos, subject_id, spos, d) -> per pair of sequences and fragment pair: least distance and number of hits."""
    return hits.groupBy("query_id", "subject_id", F.floor(F.col("qpos") / fragment).alias("qfrag"), F.floor(F.col("spos") / fragment).alias("sfrag")).agg(F.min("d").alias("d"), F.count("*").alias("hits"))


def weighted_average(hits: DataFrame, kmers_of: DataFrame, fragment: int, default: int, skip: int = 1) -> DataFrame:
    """Codebook distance: means of row and column fragment minima weighted by the fragments' k-mers, unseen fragments at the default.

    hits (query_id, qpos, subject_id, spos, d), kmers_of (seq_id, n).  Every fragment of either sequence counts: full ranges are made for the
    pairs that have any hit."""
    def side(own: str, pos: str, other: str) -> DataFrame:
        mins = hits.where(F.col(pos) % skip == 0).groupBy(own, other, F.floor(F.col(pos) / fragment).alias("frag")).agg(F.min("d").alias("d"))
        sums = mins.join(kmers_of.select(F.col("seq_id").alias(own), "n"), own)
        width = F.least(F.lit(fragment), F.col("n") - F.col("frag") * fragment)
        seen = sums.groupBy(own, other).agg(F.sum(F.col("d") * width).alias("s"), F.sum(width).alias("w"), F.max("n").alias("n"))
        return seen.select(own, other, ((F.col("s") + (F.col("n") - F.col("w")) * default) / F.col("n")).alias("v"))

    rows, cols = side("query_id", "qpos", "subject_id").withColumnRenamed("v", "r"), side("subject_id", "spos", "query_id").withColumnRenamed("v", "c")
    return rows.join(cols, ["query_id", "subject_id"]).select("query_id", "subject_id", ((F.col("r") + F.col("c")) / 2).alias("distance"))


def sliced_minima(queries: DataFrame, subjects: DataFrame, k: int, matrix: Matrix, interval: int, kind: str = "blosum") -> DataFrame:
    """Approximate minima: two anti-diagonals are computed at every `interval` columns, and the diagonal through the best of their cells is
    followed whole.  Positions that no followed diagonal meets keep their sampled least, else null."""
    d = matrix.distances(kind)

    def work(q, s):
        m, n = len(q) - k + 1, len(s) - k + 1
        if m < 1 or n < 1:
            return []
        row, col = np.full(m, -1), np.full(n, -1)

        def put(i, j):
            v = int(d[q[i : i + k], s[j : j + k]].sum())
            row[i] = v if row[i] < 0 else min(row[i], v)
            col[j] = v if col[j] < 0 else min(col[j], v)
            return v

        for start in range(0, n, interval):
            cells = [(i, start + a - i) for a in (0, 1) for i in range(m) if 0 <= start + a - i < n]
            if cells:
                i, j = min(cells, key=lambda c: (put(*c), c))
                back = min(i, j)
                for t in range(min(m - (i - back), n - (j - back))):
                    put(i - back + t, j - back + t)
        return [([int(x) if x >= 0 else None for x in row], [int(x) if x >= 0 else None for x in col])]

    return over_pairs(queries, subjects, work, "row_min array<int>, col_min array<int>", _coder(matrix))


#: The slices of a pair of fragments: along its falling diagonal or down its middle column; followed along the best cell's diagonal or not.
SLICES = {"Slice": (False, True), "SliceVertical": (True, True), "SliceNoFollow": (False, False), "SliceVerticalNoFollow": (True, False)}
#: Names of the modes by which fragments' distances are made or gathered.
NAMED = (*MODES, *SLICES, "Projector", "ProjectorAMP", "ProjectorBitEmbedding", "ProjectorSlice")


def slice_cells(rows: int, columns: int, vertical: bool) -> tuple[np.ndarray, np.ndarray]:
    """The cells of a slice of a block, in order: of each row the middle one, or the one on the falling diagonal and the one before it."""
    i = np.arange(rows)
    if vertical:
        return i, np.full(rows, columns // 2)
    j = columns - 1 - i * columns // rows
    i, j = np.repeat(i, 2), np.stack([j, j - 1], axis=1).ravel()
    return i[j >= 0], j[j >= 0]


def slice_distances(queries: DataFrame, subjects: DataFrame, k: int, matrix: Matrix, fragment: int, mode: str = "Slice", kind: str = "blosum", threshold: int | None = None, default: int | None = None) -> DataFrame:
    """query_id, subject_id, qfrag, sfrag, distance of all pairs of fragments of `fragment` k-mers: the least distance on the block's slice and,
    in modes that follow, on the diagonal through the first of its least cells.  Approximate: other cells aren't looked at."""
    vertical, follow = SLICES[mode]
    d = matrix.distances(kind)

    def work(q, s):
        if len(q) < k or len(s) < k:
            return []
        m = pair_matrix(q, s, k, d).astype(np.int64)
        if threshold is not None:
            m = np.where(m > threshold, default, m)
        out = []
        for a in range(0, m.shape[0], fragment):
            for b in range(0, m.shape[1], fragment):
                block = m[a : a + fragment, b : b + fragment]
                i, j = slice_cells(*block.shape, vertical)
                at = int(block[i, j].argmin())
                best = block[i[at], j[at]]
                if follow:
                    best = min(best, block.diagonal(int(j[at] - i[at])).min())
                out.append((a // fragment, b // fragment, int(best)))
        return out

    return over_pairs(queries, subjects, work, "qfrag int, sfrag int, distance int", _coder(matrix))


def named_distance(queries: DataFrame, subjects: DataFrame, k: int, matrix: Matrix, mode: str, fragment: int = 1, kind: str = "blosum", gather: str = "HausdorffAverageAverage") -> DataFrame:
    """query_id, subject_id, distance by the mode's name: the four Hausdorff forms over all k-mers; slices of fragments, gathered by `gather`; and
    projectors, which gather the minima of the whole matrix (ProjectorSlice: of sampled anti-diagonals).  A projector's name says where its
    matrix is worked out, which here is one kernel."""
    if mode not in NAMED:
        raise ValueError(f"unknown mode {mode!r}; known are {', '.join(NAMED)}")
    if mode in MODES:
        return distances(queries, subjects, k, matrix, mode, kind)
    if mode in SLICES:
        return over_fragments(slice_distances(queries, subjects, k, matrix, fragment, mode, kind), gather)
    if mode == "ProjectorSlice":
        known = lambda c: F.filter(c, lambda x: x.isNotNull())
        m = sliced_minima(queries, subjects, k, matrix, fragment, kind).select("query_id", "subject_id", known("row_min").alias("row_min"), known("col_min").alias("col_min"))
        return m.select("query_id", "subject_id", combine()[gather].alias("distance"))
    return distances(queries, subjects, k, matrix, gather, kind)


def alignments(queries: DataFrame, subjects: DataFrame, matrix: Matrix, local: bool = False, gap_open: int = -10, gap_extend: int = -1) -> DataFrame:
    """query_id, subject_id, score: of the best global (or local) alignment."""
    sim = matrix.sim.astype(np.int64)
    return over_pairs(queries, subjects, lambda q, s: [(align(q, s, sim, gap_open, gap_extend, local),)], "score long", _coder(matrix))
