import random

import numpy as np
import pytest

from tessera.llm import suffix_dedup as s


def result(df):
    return {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in df.collect()}


def test_equals_brute_force(spark, documents, corpus):
    rows = [(i, t) for i, t in corpus if t is None or len(t) < 20_000]
    assert result(s.report(documents(rows).repartition(5))) == s.brute_force(rows)


@pytest.mark.parametrize("size", [200, 2000, 8_000_000])
def test_slices_do_not_matter(spark, documents, monkeypatch, size):
    rng = random.Random(size)
    base = "".join(rng.choice("abcd ") for _ in range(900))
    rows = [(100 - i, base[rng.randrange(300) : 600 + rng.randrange(300)] + str(i) + base[: rng.randrange(400)]) for i in range(25)]
    rows += [(200, "ab" * 100), (201, "ab" * 80), (199, "a" * 49), (198, "a" * 50), (202, "a" * 120), (203, base[:50]), (204, base[:49])]
    monkeypatch.setattr(s, "SLICE_BYTES", size)
    assert result(s.report(documents(rows).repartition(3))) == s.brute_force(rows)


def test_stretches_do_not_matter(spark, documents, monkeypatch):
    rng = random.Random(9)
    base = "".join(rng.choice("abcd ") for _ in range(700))
    rows = [(i, base[rng.randrange(200) : 500 + rng.randrange(200)] + str(i)) for i in range(12)] + [(20, "ab" * 200), (21, base)]
    whole = s.find_occurrences([t.encode() for _, t in rows])
    monkeypatch.setattr(s, "STRETCH", 128)
    cut = s.find_occurrences([t.encode() for _, t in rows])
    windows = lambda o: {(t, w, a, k) for t, first, last, a, k, _ in zip(*(c.tolist() for c in o), strict=True) for w in range(first, last + 1)}
    assert windows(whole) == windows(cut) and len(cut[0]) > len(whole[0])


def test_repeated_null_and_tied_ids(spark, documents):
    text = "The same long text stands in several rows, longer than fifty bytes."
    got = sorted((r["doc_id"], r["n_bytes"], r["n_removed"]) for r in s.report(documents([(5, text), (5, text), (5, text + " More."), (7, text), (8, None)])).collect())
    n = len(text)
    assert got == [(5, n, 0), (5, n, 0), (5, n + 6, 0), (7, n, n), (8, 0, 0)]
    assert [(r["doc_id"], r["n_removed"]) for r in s.report(documents([(None, text), (1, text)])).orderBy("doc_id").collect()] == [(None, 0), (1, 0)]


def test_empty_table(spark, documents):
    assert s.report(documents([(1, "x")]).limit(0)).count() == 0


def test_longest_previous_needs_a_smaller_document():
    w = np.frombuffer(b"".join(bytes([c]) * s.SPAN for c in b"abab" + b"c"), np.uint8).reshape(5, s.SPAN)
    assert (s.longest_previous(w, np.array([3, 1, 2, 1, 0])) >= s.SPAN).tolist() == [True, False, False, False, False]


@pytest.mark.parametrize("n", [0, 1, 40, 400])
def test_longest_previous_equals_brute_force(n):
    rng = np.random.default_rng(n)
    bases = rng.integers(97, 99, (5, s.SPAN), dtype=np.uint8)
    w = bases[rng.integers(0, 5, n)].copy()
    cut = rng.integers(20, 2 * s.SPAN, n)
    for i in range(n):
        w[i, cut[i] :] ^= 3
    docs = rng.integers(0, 30, n)
    order, lcp = s.suffix_order(w)
    rows = [bytes(x) for x in w]
    same = lambda x, y: next((k for k in range(s.SPAN) if x[k] != y[k]), s.SPAN)
    assert [rows[i] for i in order] == sorted(rows) and lcp[1:].tolist() == [same(rows[order[k]], rows[order[k - 1]]) for k in range(1, n)]
    want = [max((same(x, y) for y, e in zip(rows, docs, strict=True) if e < d), default=0) for x, d in zip(rows, docs, strict=True)]
    got = s.longest_previous(w, docs).tolist()
    assert [g >= s.SPAN for g in got] == [x >= s.SPAN for x in want]


def test_every_window_has_the_anchor_of_its_content():
    rng = np.random.default_rng(1)
    text = bytes(rng.integers(97, 100, 400, dtype=np.uint8))
    one = s.find_occurrences([text])
    two = s.find_occurrences([b"zz" * 30 + text])
    place = lambda o, shift: {(first + k - shift, a - shift) for _, first, last, a, *_ in zip(*o, strict=True) for k in range(last - first + 1)}
    assert place(one, 0) <= place(two, 60)
