import hashlib

import pytest

from tessera.llm.sharding import ShardStore, shard_documents


def rows(df):
    return sorted((tuple(r)[:2] for r in df.select("doc_id", "text").collect()), key=repr)


def test_append_compact_and_read(spark, documents, corpus, tmp_path):
    store = ShardStore(spark, str(tmp_path), target_bytes=1 << 20)
    assert store.compact()["version"] == 0 and store.versions() == []
    half = len(corpus) // 2
    store.append(documents(corpus[:half]), rows_each=5)
    store.append(documents(corpus[half:]), rows_each=5)
    before = store.manifest()
    assert before["version"] == 2 and rows(store.read()) == sorted(corpus, key=repr)
    after = store.compact()
    assert after["version"] == 3 and sum(r["shards"] for r in after["runs"]) < sum(r["shards"] for r in before["runs"]) / 3
    assert rows(store.read()) == rows(store.read(2)) == sorted(corpus, key=repr) and rows(store.read(1)) == sorted(corpus[:half], key=repr)
    assert store.read().columns == [*documents(corpus).columns, "shard_file"]
    assert store.vacuum() == 0 and store.vacuum(0) == 2 and rows(store.read()) == sorted(corpus, key=repr)


def test_only_similar_sizes_merge(spark, documents, tmp_path):
    store = ShardStore(spark, str(tmp_path), target_bytes=1 << 30)
    assert store.tier(1) == 0 and store.tier(65536 * 4) == 1 and store.tier(1 << 30) > store.tier(1 << 28)
    store.append(documents([(i, "x") for i in range(9)]).coalesce(1), rows_each=3)
    assert [r["shards"] for r in store.manifest()["runs"]] == [3] and store.compact()["version"] == 1
    store.append(documents([(9, "x")]).coalesce(1))
    assert [r["shards"] for r in store.compact()["runs"]] == [1]


def test_tiers_merge_apart(spark, tmp_path):
    store = ShardStore(spark, str(tmp_path), target_bytes=1 << 30)
    df = spark.range(8000).selectExpr("id doc_id", "concat_ws('', transform(sequence(0, 9), x -> sha2(concat(id, ':', x), 256))) text").coalesce(1)
    for rows_each in (10, 2000):
        store.append(df, rows_each=rows_each)
    small, large = store.manifest()["runs"]
    assert small["tier"] < large["tier"] and small["shards"] == 800 and large["shards"] == 4
    made = store.compact()["runs"]
    assert [r["shards"] for r in made] == [1, 1] and store.read().count() == 16_000


def test_a_column_named_like_the_shards(spark, tmp_path):
    store = ShardStore(spark, str(tmp_path))
    store.append(spark.createDataFrame([(1, "a", "mine")], "doc_id long, text string, shard_file string"))
    r = store.read().first()
    assert r["shard_file"] == "mine" and r["shard_file_"].startswith("part-")


def test_a_version_is_committed_once(spark, documents, tmp_path):
    store = ShardStore(spark, str(tmp_path))
    base = store.manifest()
    store.append(documents([(1, "a")]))
    with pytest.raises(Exception, match="(?i)exist"):
        store._commit(base, "{}", [])
    assert store.versions() == [1] and rows(store.read()) == [(1, "a")]


def test_target_size(spark, tmp_path):
    df = spark.range(60_000).selectExpr("id doc_id", "repeat(sha2(cast(id as string), 256), 3) text").repartition(24)
    store = ShardStore(spark, str(tmp_path), target_bytes=2 << 20)
    store.append(df, rows_each=1000)
    (run,) = store.compact()["runs"]
    sizes = [f.stat().st_size for f in (tmp_path / "runs" / run["run"]).glob("part-*")]
    assert len(sizes) == run["shards"] and sum(sizes) == run["bytes"]
    assert len(sizes) > 1 and max(sizes) < 1.3 * (2 << 20) and sorted(sizes)[1] > 0.5 * (2 << 20)


def test_query_returns_every_row(spark, documents, corpus):
    got = shard_documents(documents([*corpus, corpus[0], (None, "no id")]))
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    assert sorted((r["doc_id"] or -1, r["n_bytes"], r["text_sha256"]) for r in got.collect()) == sorted((i, len((t or "").encode()), sha(t)) for i, t in [*corpus, corpus[0], (-1, "no id")])
    assert shard_documents(documents([(1, "x")]).limit(0)).count() == 0
