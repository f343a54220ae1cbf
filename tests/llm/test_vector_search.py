import math

import numpy as np
import pytest

from tessera.llm import vector_search as v


def brute(rows, every=20, k=20):
    ok = [(i, [math.floor(64 * float(np.float32(x))) for x in e]) for i, e in rows if i is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    out = []
    for q, a in {(i, tuple(x)) for i, x in ok if i % every == 0}:
        found = sorted((-sum(x * y for x, y in zip(a, b, strict=False)), i) for i, b in ok if i != q)[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found)]
    return sorted(out)


def search(spark, rows, **options):
    df = spark.createDataFrame([(i, e, 1, 2.0) for i, e in rows], "vec_id long, embedding array<float>, cell int, dist double")
    return sorted(map(tuple, v.top_scores(df.repartition(3), **options).collect()))


def test_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(0, 0.3, (6, 8))
    rows = [(i, (centres[i % 6] + rng.normal(0, 0.05, 8)).tolist()) for i in range(400)]
    assert search(spark, rows) == brute(rows)


def test_ties_bad_rows_and_lengths(spark):
    rows = [(i, [0.5, 0.25]) for i in range(60)] + [(100, None), (120, [float("nan"), 1.0]), (140, [None, 1.0]), (160, [float("inf"), 0.0]), (None, [1.0, 1.0]), (180, []), (200, [0.5]), (220, [0.1, 0.2, 0.3]), (61, [-9.0, 4.0])]
    assert search(spark, rows) == brute(rows)


@pytest.mark.parametrize("part", [3, 40])
def test_hot_cells_are_dealt_in_parts(spark, monkeypatch, part):
    monkeypatch.setattr(v, "PART", part)
    rows = [(i, [0.5, 0.5]) for i in range(90)] + [(i, [i / 300, -0.2]) for i in range(90, 140)]
    assert search(spark, rows) == brute(rows)


def test_queries_in_blocks(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(0, 1, 4).tolist()) for i in range(200)]
    df = v.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    for block in (1, 4):
        assert sorted(map(tuple, v.search(df, df.where("vec_id % 20 = 0"), block=block).collect())) == brute(rows)


def test_an_id_with_several_vectors(spark):
    rows = [(20, [1.0, 0.0]), (20, [0.0, 1.0]), (20, [0.0, 1.0]), *((i, [i / 50, 1 - i / 50]) for i in range(21, 60))]
    got = search(spark, rows)
    assert got == brute(rows) and len([x for x in got if x[0] == 20]) == 40


def test_large_components(spark):
    rows = [(i, [float(1000 * (i % 7)), float(-i)]) for i in range(45)]
    assert search(spark, rows) == brute(rows)


def test_few_and_no_rows(spark):
    rows = [(0, [0.5]), (3, [0.1]), (20, [0.2])]
    assert search(spark, rows) == brute(rows)
    assert search(spark, [(0, [1.0])]) == [] and search(spark, [(1, [1.0]), (2, [1.0])]) == []
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert v.top_scores(empty).count() == 0


def test_bounds_hold(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(0, 1, 5).tolist()) for i in range(300)]
    vectors = v.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    index = v.Index(vectors)
    t = index.table.toPandas()
    m = v.unpack(t["v"].tolist(), index.dim)
    ub = index.bounds(m[:20])
    for c, cell in enumerate(index.cells):
        inside = m[(t["cell"] == cell).to_numpy()]
        assert (m[:20] @ inside.T).max(1).max() <= ub[:, c].max() and ((m[:20] @ inside.T).max(1) <= ub[:, c]).all()
