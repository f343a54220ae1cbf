"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Spark gives a leaf whose size it doesn't know spark.sql.defaultSizeInBytes: the greatest long.
UNKNOWN = 1 << 60
_PATHS: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def shared_root(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, or what the context was given; set here only in local mode, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        context = spark.sparkContext
        found = context._jsc.sc().getCheckpointDir()
        if found.isEmpty():
            if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
                raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-"))
            found = context._jsc.sc().getCheckpointDir()
        root = found.get()
    return root.rstrip("/")


def saved(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage with a table in the shared folder."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    _PATHS[table] = path
    return table


def superseded(*tables: DataFrame) -> None:
    """Delete tables of `saved` that nothing reads any more."""
    for table in tables:
        if path := _PATHS.pop(table, None):
            at = table.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def input_bytes(df: DataFrame) -> int:
    """Bytes of the tables that df reads: of files by their sizes, whatever joins and filters above them are thought to make of them; where a
    leaf's size is unknown (rows from the driver), df's own rows are measured."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    if sum(sizes) < UNKNOWN:
        return sum(sizes)
    return df.agg(F.sum(F.length(F.to_json(F.struct(*[F.col(f"`{n}`").alias(f"c{i}") for i, n in enumerate(df.columns)]))))).first()[0] or 0


def running(df: DataFrame, x: str, n: str, out: str, how: str = "sum") -> DataFrame:
    """df with the sum (or max) of n over all rows up to x, without one task for all rows: values are dealt by range, taken within each range,
    and the ranges' totals, as many as there are partitions, are added.  Rows of one x count in any order."""
    ranged = saved(df.repartitionByRange(F.col(x)).withColumn("_range", F.spark_partition_id()), "running")
    agg = {"sum": F.sum, "max": F.max}[how]
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("_range").agg(agg(n).alias("_t")).select("_range", agg("_t").over(before).alias("_before"))
    own = agg(n).over(Window.partitionBy("_range").orderBy(x).rowsBetween(Window.unboundedPreceding, 0))
    both = F.coalesce(F.col("_own"), F.lit(0)) + F.coalesce(F.col("_before"), F.lit(0)) if how == "sum" else F.greatest("_own", "_before")
    return ranged.withColumn("_own", own).join(F.broadcast(totals), "_range").withColumn(out, both).drop("_own", "_before", "_range")


def running_sum(df: DataFrame, x: str, n: str, out: str) -> DataFrame:
    return running(df, x, n, out)


def previous(df: DataFrame, x: str, column: str, out: str) -> DataFrame:
    """df with the column's value in the row before, by x (distinct values); dealt by range like `running`."""
    ranged = saved(df.repartitionByRange(F.col(x)).withColumn("_range", F.spark_partition_id()), "previous")
    lasts = ranged.groupBy("_range").agg(F.max_by(column, x).alias("_last"))
    lasts = lasts.select("_range", F.lag("_last").over(Window.orderBy("_range")).alias("_before"))
    first = F.row_number().over(Window.partitionBy("_range").orderBy(x)) == 1
    own = F.lag(column).over(Window.partitionBy("_range").orderBy(x))
    return ranged.withColumn("_own", own).withColumn("_first", first).join(F.broadcast(lasts), "_range").withColumn(out, F.when(F.col("_first"), F.col("_before")).otherwise(F.col("_own"))).drop("_own", "_before", "_first", "_range")
