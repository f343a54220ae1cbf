"""Every query against its SQL on the smallest tables; those without SQL have to run and give rows."""

import decimal

import duckdb
import pytest

from tessera import plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, (float, decimal.Decimal)):
        return float(f"{float(v):.9g}")
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_query_equals_sql(spark, sf_dir, duck, name):
    df = plans.QUERIES[name](spark, sf_dir)
    found = duck.sql(plans.ORACLES[name])
    assert sorted(df.columns) == sorted(found.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(found.columns, found.fetchall())


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLES)))
def test_query_without_sql_gives_rows(spark, sf_dir, name):
    assert plans.QUERIES[name](spark, sf_dir).count() > 0


def test_every_word_reaches_the_codebook(spark, sf_dir, monkeypatch):
    from tessera.operators import ranking, tiling
    from tessera.operators.kernels import within
    from tessera.plans.common import items
    from tessera.plans.ranking import LETTERS

    monkeypatch.setattr(ranking, "rank_codebook", lambda queries, subjects, protos, *_: protos)
    protos = plans.QUERIES["rank_codebook"](spark, sf_dir)
    words = tiling.kmers(items(spark, sf_dir), 6).select("word").distinct()
    reached = within(words, protos, 2, LETTERS, "edit").select("word").distinct()
    assert words.join(reached, "word", "left_anti").count() == 0
