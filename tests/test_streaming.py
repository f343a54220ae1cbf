from tessera.streaming import rank_stream, scored


def test_stream_equals_batch(spark, tmp_path):
    q = spark.createDataFrame([("q1", [1, 2, 3]), ("q2", [7])], "seq_id string, features array<int>")
    s = spark.createDataFrame([("s1", [2, 3, 4]), ("s2", [7, 8])], "seq_id string, features array<int>")
    q.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(q.schema).parquet(str(tmp_path / "in"))
    rank_stream(stream, s, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    got = {(r["query_id"], r["subject_id"], r["distance"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {("q1", "s1", 0.5), ("q2", "s2", 0.5)}
    assert scored(q, s).count() == 3
