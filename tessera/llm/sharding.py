"""Sharding by size-tiered compaction: arrivals become runs of small immutable shards; runs whose shards are of similar size are merged, tier
by tier, into files of about the target size; a versioned manifest names the live runs and is committed atomically.  A run is a folder: the
manifest holds its number of shards and bytes, so what reaches the driver grows with the arrivals and merges, not with files or rows.

DataFrame operations only.  A merge is a read whose scan packs whole small files into partitions of the target size and a write of each
partition as one file: no shuffle, so a hot source or key means nothing to it.  All files lie under the store's root, in the shared
folder; old runs stay until `vacuum`, so readers of an earlier version go on.  A failed task is run again by Spark's commit protocol, a
failed compaction leaves only files that no manifest names.

Nulls, empty texts, repeated rows and extra columns are carried as they are (a column named shard_file stays, the shards' names then
come as shard_file_); an empty arrival adds no run; an empty store reads as an empty table of its schema.
"""

from __future__ import annotations

import json
import math
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import fresh_path


class ShardStore:
    """A directory of Parquet shards under versioned manifests: <root>/runs/<run>/part-*.parquet and <root>/manifest/<version>.json."""

    def __init__(self, spark: SparkSession, root: str, target_bytes: int = 256 << 20, fan_in: int = 4):
        self.spark, self.root, self.target, self.fan_in = spark, root.rstrip("/"), target_bytes, fan_in
        self._fs_conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, p: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(p)

    def _fs(self):
        return self._path(self.root).getFileSystem(self._fs_conf)

    def versions(self) -> list[int]:
        at = self._path(f"{self.root}/manifest")
        fs = self._fs()
        if not fs.exists(at):
            return []
        return sorted(int(s.getPath().getName()[:-5]) for s in fs.listStatus(at) if s.getPath().getName().endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """{"version", "schema", "runs": [{"run", "shards", "bytes", "tier"}]}; version None: the latest; 0: the empty store."""
        version = version if version is not None else (self.versions() or [0])[-1]
        if version == 0:
            return {"version": 0, "schema": None, "runs": []}
        stream = self._fs().open(self._path(f"{self.root}/manifest/{version:08d}.json"))
        try:
            return json.loads(bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
        finally:
            stream.close()

    def _commit(self, base: dict, schema: str, runs: list[dict]) -> dict:
        """Write beside, then rename without overwriting: of two writers of one version, one fails and has to start again from the new one."""
        made = {"version": base["version"] + 1, "schema": schema, "runs": runs}
        temp, final = self._path(f"{self.root}/manifest/.{uuid.uuid4().hex}"), self._path(f"{self.root}/manifest/{made['version']:08d}.json")
        out = self._fs().create(temp, False)
        out.write(json.dumps(made).encode())
        out.close()
        fs_jvm = self.spark._jvm.org.apache.hadoop.fs
        context = fs_jvm.FileContext.getFileContext(temp.toUri() if temp.toUri().getScheme() else self._fs().getUri(), self._fs_conf)
        none = getattr(self.spark._jvm, "org.apache.hadoop.fs.Options$Rename").NONE
        options = self.spark.sparkContext._gateway.new_array(getattr(self.spark._jvm, "org.apache.hadoop.fs.Options$Rename"), 1)
        options[0] = none
        context.rename(temp, final, options)
        return made

    def tier(self, size: int) -> int:
        """0 for the smallest; one more for each factor of fan_in; files of about the target or more are in the last tier and stay."""
        last = 1 + int(math.log(max(2.0, self.target / 65536), self.fan_in))
        return last if size >= 0.6 * self.target else min(last - 1, int(math.log(max(1.0, size / 65536), self.fan_in)))

    def _stored(self, run: str) -> list[dict]:
        """A written run, none if it is empty; its tier is that of its shards' mean size."""
        names = self.spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{self.root}/runs/{run}")
        shards, size = names.select("length").where("length > 0").agg(F.count("*"), F.sum("length")).first()
        return [{"run": run, "shards": shards, "bytes": size, "tier": self.tier(size // shards)}] if shards else []

    def append(self, arrivals: DataFrame, rows_each: int = 2000) -> dict:
        """Add arrivals as a run of shards of at most rows_each rows, as the scan's partitions deal them; no shuffle."""
        base, run = self.manifest(), f"a-{uuid.uuid4().hex}"
        arrivals.write.option("maxRecordsPerFile", rows_each).parquet(f"{self.root}/runs/{run}")
        return self._commit(base, base["schema"] or arrivals.schema.json(), base["runs"] + self._stored(run))

    def compact(self) -> dict:
        """Merge the runs of every tier that holds at least fan_in shards, each tier by itself; one manifest for all merges of a pass."""
        base = self.manifest()
        tiers: dict[int, list[dict]] = {}
        for r in base["runs"]:
            tiers.setdefault(r["tier"], []).append(r)
        last = self.tier(self.target)
        due = {t for t, runs in tiers.items() if t != last and sum(r["shards"] for r in runs) >= self.fan_in}
        if not due:
            return base
        session = self.spark.newSession()
        session.conf.set("spark.sql.files.maxPartitionBytes", str(self.target))
        session.conf.set("spark.sql.files.openCostInBytes", "0")
        session.conf.set("spark.sql.files.minPartitionNum", "1")
        schema = T.StructType.fromJson(json.loads(base["schema"]))
        runs = [r for t, found in tiers.items() if t not in due for r in found]
        for t in sorted(due):
            run = f"c-{uuid.uuid4().hex}"
            session.read.schema(schema).parquet(*[f"{self.root}/runs/{r['run']}" for r in tiers[t]]).write.parquet(f"{self.root}/runs/{run}")
            runs += self._stored(run)
        return self._commit(base, base["schema"], runs)

    def vacuum(self, grace_s: float = 86_400) -> int:
        """Delete runs that the latest manifest doesn't name and that have been there for grace_s seconds; returns how many.  The grace is for
        appends and merges that are being written, and for readers of earlier versions."""
        live, fs, gone = {r["run"] for r in self.manifest()["runs"]}, self._fs(), 0
        for s in fs.listStatus(self._path(f"{self.root}/runs")):
            if s.getPath().getName() not in live and time.time() - s.getModificationTime() / 1000 >= grace_s:
                gone += bool(fs.delete(s.getPath(), True))
        return gone

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version with their shard's name in `shard_file` (the first such name that the rows leave free)."""
        m = self.manifest(version)
        schema = T.StructType.fromJson(json.loads(m["schema"])) if m["schema"] else T.StructType([])
        name = "shard_file"
        while name in schema.fieldNames():
            name += "_"
        if not m["runs"]:
            return self.spark.createDataFrame([], schema).withColumn(name, F.lit(None).cast("string"))
        rows = self.spark.read.schema(schema).parquet(*[f"{self.root}/runs/{r['run']}" for r in m["runs"]])
        return rows.withColumn(name, F.element_at(F.split(F.input_file_name(), "/"), -1))


def shard_documents(docs: DataFrame, target_bytes: int = 64 << 20, rows_each: int = 2000) -> DataFrame:
    """Append docs to a new store, compact it, and read every row back from the latest manifest's shards: doc_id, n_bytes and text_sha256 of
    the text (null: empty)."""
    spark = docs.sparkSession
    store = ShardStore(spark, fresh_path(spark, "shards"), target_bytes)
    store.append(docs, rows_each)
    store.compact()
    store.vacuum(0)  # no one else knows this store
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return store.read().select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("text_sha256"))


#: What compaction must not change.
ORACLE = "select doc_id, octet_length(encode(coalesce(text, ''))) n_bytes, sha256(encode(coalesce(text, ''))) text_sha256 from documents"
