import zlib

import numpy as np
import pytest

from tessera.llm import toxicity as t


@pytest.fixture(scope="module")
def labelled(spark):
    import random

    rng = random.Random(3)
    plain = ["".join(rng.choice("abcdefg") for _ in range(4)) for _ in range(300)]
    rows, labels = [], []
    for i in range(900):
        words = [rng.choice(plain) for _ in range(rng.randint(5, 80))]
        toxic = i % 8 == 0
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(["Grumble!", "snarl", "scoff."])
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_held_out_accuracy(spark, documents, labelled):
    rows, labels = labelled
    got = {r["doc_id"]: r for r in t.score(documents(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    held = [(got[i]["predicted"], y) for i, _, y in labels if got[i]["held_out"]]
    hits = sum(p and y for p, y in held)
    assert hits / sum(y for _, y in held) > 0.9 and hits / max(1, sum(p for p, _ in held)) > 0.9
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got.values())


def test_held_out_labels_are_never_read(spark, documents, labelled):
    rows, labels = labelled
    flipped = [(i, q, 1 - y if zlib.crc32(str(i).encode()) % 3 == 1 else y) for i, q, y in labels]
    one, two = ({r["doc_id"]: r["score"] for r in t.score(documents(rows), spark.createDataFrame(x, "doc_id long, quality int, toxic int")).collect()} for x in (labels, flipped))
    assert one == two


def test_odd_rows(spark, documents, labelled):
    rows, labels = labelled
    docs = documents([*rows, (5000, None), (5001, ""), (None, "snarl"), (5002, "snarl " * 50_000), rows[3], rows[3]])
    labels = spark.createDataFrame([*labels, (None, 1, 1), (3, 1, None), (5001, None, 0), (0, 1, 1)], "doc_id long, quality int, toxic int")
    got = t.score(docs, labels).collect()
    assert len(got) == len(rows) + 6
    by = {r["doc_id"]: r for r in got}
    assert by[5000]["score"] == by[5001]["score"] < 0.5 < by[5002]["score"] and by[None]["held_out"] is False
    kept = t.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in got if not r["predicted"]}


def test_without_positives_or_rows(spark, documents):
    none = spark.createDataFrame([(1, 1, 0), (2, 1, 0)], "doc_id long, quality int, toxic int")
    docs = documents([(1, "a"), (2, "b")])
    assert {(r["predicted"], r["score"]) for r in t.score(docs, none).collect()} == {(0, 0.0)}
    every = spark.createDataFrame([(1, 1, 1), (2, 1, 1)], "doc_id long, quality int, toxic int")
    assert {r["predicted"] for r in t.score(docs, every).collect()} == {0}  # nothing tells them apart
    assert t.score(docs, none.limit(0)).count() == 2 and t.score(docs.limit(0), none).count() == 0


def bags(x):
    return t.Bags([np.flatnonzero(r).tolist() for r in x], x.shape[1])


def test_risk_uses_the_prior():
    rng = np.random.default_rng(0)
    y = rng.random(2000) < 0.2
    x = (rng.random((2000, 2)) < np.where(y[:, None], [0.9, 0.5], [0.05, 0.5])).astype(np.float32)
    seen = y & (rng.random(2000) < 0.5)  # half of the positives are confirmed, the rest hide among the unlabelled
    w, b = t.nnpu(bags(x[seen]), bags(x), 0.2)
    z = x @ w + b
    assert w[0] > 2 > w[1] >= 0 and ((z > 0) == (x[:, 0] > 0)).mean() > 0.99


def test_risk_and_its_slope_equal_plain_loops():
    rng = np.random.default_rng(3)
    x, u = (rng.random((n, 4)) < 0.4 for n in (30, 50))
    w, b, prior = rng.normal(size=4), 0.3, 0.25
    log = lambda z: float(np.log1p(np.exp(z)))

    def plain(w, b):
        zs = lambda rows: [b + sum(c for c, there in zip(w, r, strict=True) if there) for r in rows]
        plus = prior * sum(log(-z) for z in zs(x)) / len(x)
        return plus, sum(log(z) for z in zs(u)) / len(u) - prior * sum(log(z) for z in zs(x)) / len(x)

    p, q = bags(x), bags(u)
    assert np.allclose(t.risk(p.logits(w, b), q.logits(w, b), prior), plain(w, b))
    sp, su = (1 / (1 + np.exp(-m.logits(w, b))) for m in (p, q))
    slope = p.gradient(prior * (sp - 1) / p.n) + q.gradient(su / q.n) - p.gradient(prior * sp / p.n)
    for k in range(5):
        d = np.eye(5)[k] * 1e-6
        assert abs((sum(plain(w + d[:4], b + d[4])) - sum(plain(w - d[:4], b - d[4]))) / 2e-6 - slope[k]) < 1e-6


def test_the_prior_is_found_without_negatives():
    rng = np.random.default_rng(4)
    y = rng.random(20_000) < 0.12
    x = rng.random((20_000, 6)) < np.where(y[:, None], 0.4, 0.002)
    texts = [np.flatnonzero(r).tolist() for r in x]
    pos = [f for f, toxic in zip(texts, y, strict=True) if toxic][:500]
    assert 0.11 < t.class_prior(pos, texts, 6) < 0.145  # 0.12 and a standard error


def test_few_positives_teach(spark, documents, labelled):
    rows, labels = labelled
    few = [i for i, _, y in labels if y and zlib.crc32(str(i).encode()) % 3 != 1 and "snarl" in dict(rows)[i]][:6]
    docs = documents(rows)
    kept = {r["doc_id"] for r in t.drop_toxic(docs, spark.createDataFrame([(i, 1, 1) for i in few], "doc_id long, quality int, toxic int")).collect()}
    gone = {i for i, _ in rows} - kept
    assert gone and all("snarl" in dict(rows)[i] for i in gone)


def test_tail_equals_sums():
    from math import comb

    for n, rate in ((6, 0.03), (40, 0.2), (300, 0.01)):
        p = np.arange(int(n * rate) + 1, n + 1)
        want = [sum(comb(n, j) * rate**j * (1 - rate) ** (n - j) for j in range(k, n + 1)) for k in p.tolist()]
        assert np.allclose(t.tail(p, n, np.full(len(p), rate)), want, rtol=1e-8)


def test_labels_of_clean_rows_are_not_used(spark, documents, labelled):
    rows, labels = labelled
    only = [x for x in labels if x[2] == 1]
    one, two = ({r["doc_id"]: r["score"] for r in t.score(documents(rows), spark.createDataFrame(x, "doc_id long, quality int, toxic int")).collect()} for x in (labels, only))
    assert one == two
