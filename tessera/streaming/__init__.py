"""Rankings of arriving queries against a fixed table: stream-static joins without state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.ranking import rank_signatures


def scored(queries: DataFrame, subjects: DataFrame) -> DataFrame:
    """A stream of (seq_id, features) against static signatures: query_id, subject_id, shared features of one arriving row each."""
    q = queries.select(F.col("seq_id").alias("query_id"), F.explode("features").alias("feature"))
    s = subjects.select(F.col("seq_id").alias("subject_id"), F.explode("features").alias("feature"))
    return q.join(s, "feature").select("query_id", "subject_id", "feature")


def rank_stream(queries: DataFrame, subjects: DataFrame, path: str, checkpoint: str, k: int = 100):
    """Start a query that ranks each micro-batch and appends it to Parquet; each batch has a folder of its own, so a repeated one is
    overwritten, not doubled."""

    def batch(rows: DataFrame, number: int) -> None:
        rank_signatures(rows, subjects, k).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return queries.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
