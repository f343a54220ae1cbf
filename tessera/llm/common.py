"""What the operators of this package share: shared-folder tables, word hashing, connected components."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.storage import input_bytes

#: Odd multiplier that chains bytes into word hashes, and these into shingle hashes.
CHAIN = np.uint64(0x9E3779B97F4A7C15)
#: ASCII white space; a value for each other byte, the same for A-Z as for a-z.
BLANK = re.compile(rb"[ \t-\r]")
BYTES = np.random.default_rng(64).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BYTES[65:91] = BYTES[97:123]
BYTES[[9, 10, 11, 12, 13, 32]] = 0
#: Bytes of a text whose words are hashed at once (more if a word is longer).
BLOCK = 1 << 18
_POWERS = [np.empty(0, np.uint64), np.empty(0, np.uint64)]


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or what the context was given; set here only in local mode, as in
    tests, for a folder of one machine is of no use to a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    context = spark.sparkContext
    own = context._jsc.sc().getCheckpointDir()
    if own.isEmpty():
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-"))
        own = context._jsc.sc().getCheckpointDir()
    return own.get().rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class Scratch:
    """The tables of one run, in a folder of their own in the shared one.

    A table cuts lineage: a lost executor costs nothing before it.  What a later table has superseded is dropped, and with it, as soon as the
    driver's garbage is collected, the shuffle files of the jobs that made it."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.tables = spark, fresh_path(spark, name), {}

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}-{len(self.tables)}"
        df.write.parquet(path)
        table = self.spark.read.schema(df.schema).parquet(path)
        self.tables[path] = table
        return table

    def drop(self, *gone: DataFrame | None) -> None:
        for path, table in self.tables.items():
            if any(table is x for x in gone):
                delete(self.spark, path)
                self.tables[path] = None
        self.spark._jvm.System.gc()  # Spark's cleaner frees shuffle files of what the driver has forgotten

    def keep(self, *kept: DataFrame) -> None:
        """Drop all other tables."""
        self.drop(*(t for t in self.tables.values() if t is not None and not any(t is x for x in kept)))


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a stage's rows to the shared folder and read them back, where no later step can drop them."""
    return Scratch(df.sparkSession, name).write(df, name)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def input_partitions(df: DataFrame, bytes_each: int) -> int:
    """A number of buckets that follows the input's size."""
    return max(12, input_bytes(df) // bytes_each + 1)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit integers that spreads every bit (arrays only)."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of CHAIN and of its inverse; what fits a few blocks is remembered."""
    if len(_POWERS[0]) >= n:
        return _POWERS[0][:n], _POWERS[1][:n]
    made = []
    for base in (int(CHAIN), pow(int(CHAIN), -1, 1 << 64)):
        steps = np.full(n, base, np.uint64)
        steps[:1] = 1
        made.append(np.multiply.accumulate(steps))
    if n <= 4 * BLOCK:
        _POWERS[:] = made
    return made[0], made[1]


def range_hashes(x: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial hashes of the ranges [start, end) of x, from one running sum."""
    p, q = powers(len(x))
    sums = np.concatenate(([np.uint64(0)], np.cumsum(x * p)))
    return mix((sums[ends] - sums[starts]) * q[np.minimum(starts, len(x) - 1)]) if len(starts) else np.empty(0, np.uint64)


def words_of_bytes(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of a text, split at ASCII white space: 64-bit hashes (A-Z as a-z), first bytes, ends."""
    parts = [(np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64))]
    at = 0
    while at < len(raw):
        end = min(len(raw), at + BLOCK)
        if end < len(raw):
            end = max(raw.rfind(c, at, end) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
            if end <= at:
                found = BLANK.search(raw, at + BLOCK)
                end = found.start() if found else len(raw)
        x = BYTES[np.frombuffer(raw, np.uint8, end - at, at)]
        there = np.concatenate(([False], x != 0, [False]))
        edges = np.flatnonzero(there[1:] != there[:-1])
        starts, ends = edges[::2], edges[1::2]
        parts.append((range_hashes(x, starts, ends), starts + at, ends + at))
        at = end
    return tuple(np.concatenate(c) for c in zip(*parts, strict=True))


def shingles(text: str | bytes | None, width: int = 5) -> np.ndarray:
    """Distinct hashes of `width`-word shingles: A-Z lower-cased, words split at ASCII white space; shorter texts are one shingle, none without words."""
    if not text:
        return np.empty(0, np.uint64)
    w = words_of_bytes(text.encode() if isinstance(text, str) else text)[0]
    n = len(w)
    if not n:
        return np.empty(0, np.uint64)
    if n < width:
        h = np.array([n], np.uint64)
        for x in w:
            h = h * CHAIN + x
        return mix(h)
    h = w[: n - width + 1].copy()
    for j in range(1, width):
        h *= CHAIN
        h += w[j : n - width + 1 + j]
    return np.unique(mix(h))


def jaccard_at_least(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """a, b: sorted distinct hashes.  100 * intersection >= percent * union, in integers."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if not len(small) or 100 * len(small) < percent * len(large):
        return False
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    both = int((large[at] == small).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def pack_columns(columns: list[np.ndarray]) -> bytes:
    """Equally long columns in one compressed binary, byte plane by byte plane."""
    import zstandard

    head = np.array([len(columns[0])], np.int64).tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(np.frombuffer(c.tobytes(), np.uint8).reshape(-1, c.itemsize).T.tobytes() for c in columns))


def unpack_columns(blob: bytes, kinds: list) -> list[np.ndarray]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, at, out = int(np.frombuffer(raw[:8], np.int64)[0]), 8, []
    for kind in map(np.dtype, kinds):
        size = n * kind.itemsize
        out.append(np.frombuffer(np.frombuffer(raw[at : at + size], np.uint8).reshape(kind.itemsize, n).T.tobytes(), kind))
        at += size
    return out


def zipped(rows: DataFrame, text: str, packed: str = "packed") -> DataFrame:
    """rows with a column of texts (string or binary; null: empty) replaced by a compressed one, for a shuffle."""
    others = [n for n in rows.columns if n != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press = zstandard.ZstdCompressor(level=3).compress
        for b in slices(batches):
            made = [press(t.encode() if isinstance(t, str) else t or b"") for t in b.column(len(others)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(others))), pa.array(made, pa.binary())], names=[*others, packed])

    kinds = dict(rows.dtypes)
    return rows.select(*others, text).mapInArrow(run, ", ".join([*(f"`{n}` {kinds[n]}" for n in others), f"{packed} binary"]))


def trim() -> None:
    """Give freed memory back to the system: Python workers live on between stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], chars: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds about `chars` bytes at most (or one row)."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        step = max(1, int(n * min(1.0, chars / max(1, batch.nbytes))))
        for at in range(0, n, step):
            yield batch.slice(at, step)
    trim()


def components(links: DataFrame, own: Scratch) -> DataFrame:
    """(node, component) for every node of links(a, b): the smallest node reachable; a table of own.

    Alternates large-star and small-star (Kiveris et al., 2014) over links that point from the larger node to the smaller, until each node
    points at one that points nowhere; the sum of what nodes point at falls in every round, so this ends.  A hub is reduced by partial
    aggregation before the shuffle; what its rows add up to is a table before they meet it, so adaptive execution may split that join.  Each
    round is a table and drops the one before.  Links never reach the driver.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = own.write(edges, "edges")
    while True:
        pointing = edges.select("a", F.lit(1).alias("out"), F.lit(0).alias("into")).unionAll(edges.select(F.col("b").alias("a"), F.lit(0).alias("out"), F.lit(1).alias("into")))
        if pointing.groupBy("a").agg(F.sum("out").alias("out"), F.max("into").alias("into")).where("out > 1 or (out = 1 and into = 1)").isEmpty():
            break
        # large-star: a link's end points no further than to the least that its start points at; small-star: all that a node points at
        # points at the least of it
        least = own.write(edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), "m"), "least")
        large = edges.join(least, edges["b"] == least["n"], "left").select("a", F.coalesce("m", "b").alias("b"))
        lower = own.write(large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), "m"), "lower")
        small = large.join(lower, large["a"] == lower["n"]).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        following = own.write(small.unionAll(lower.select(F.col("n").alias("a"), F.col("m").alias("b"))).distinct(), "edges")
        own.drop(edges, least, lower)
        edges = following
    labels = edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
    labels = own.write(labels, "labels")
    own.drop(edges)
    return labels
