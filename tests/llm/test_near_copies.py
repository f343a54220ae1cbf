import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from tessera.llm import ngram_join, pairs, paragraphs
from tessera.llm.common import Scratch, components, jaccard_at_least, shingles


def brute(rows):
    """doc_id -> (n_shingles, component) of distinct doc_ids, by shared shingles."""
    sets = {}
    for i, t in rows:
        raw = (t or "").encode()
        w = bytes(c + 32 if 65 <= c <= 90 else c for c in raw).split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = defaultdict(list)
    for i, s in sets.items():
        for j, c in Counter(j for g in s for j in where[g]).items():
            if 100 * c >= 75 * (len(s) + len(sets[j]) - c):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
        for g in s:
            where[g].append(i)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def result(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


def test_corpus_equals_brute_force(spark, documents, corpus):
    assert result(ngram_join.join_documents(documents(corpus).repartition(4))) == brute(corpus)


def family(n, words, edits, seed):
    """Texts that differ from one base by runs of edits, so that pairs lie on both sides of the threshold."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    rows = []
    for i in range(n):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(words)] = f"e{rng.randrange(10**6)}"
        rows.append((i * 2 + seed * 1000, " ".join(w)))
    return rows


@pytest.mark.parametrize("words,edits", [(8, 2), (30, 3), (70, 6), (400, 25)])
def test_families_around_the_threshold(spark, documents, words, edits):
    rows = family(60, words, edits, 1) + family(25, words, edits, 2) + [(i + 5, t[: int(len(t) * 0.8)]) for i, t in family(25, words, edits, 2)]
    rows = list(dict(rows).items())
    random.Random(0).shuffle(rows)
    assert result(ngram_join.join_documents(documents(rows).repartition(3))) == brute(rows)


def test_large_families_by_key(spark, documents, monkeypatch):
    monkeypatch.setattr(pairs, "FAMILY", 5)
    rows = family(50, 60, 5, 3)
    assert result(ngram_join.join_documents(documents(rows))) == brute(rows)


def test_threshold_is_exact(spark, documents):
    w = [f"w{i}" for i in range(40)]
    rows = [(1, " ".join(w[:10])), (2, " ".join(w[:12])), (3, " ".join(w[:13])), (4, " ".join(w[20:27])), (5, " ".join(w[20:28]))]
    assert result(ngram_join.join_documents(documents(rows))) == brute(rows)  # 6 of 8, 6 of 9 and 8 of 9, 3 of 4 shingles


def test_odd_rows(spark, documents):
    rows = [(1, "a b"), (2, "A  b\t"), (3, None), (4, ""), (5, " \x0b"), (6, "a b c d e"), (7, "x\u00a0y"), (7, "x\u00a0y"), (None, "a b"), (8, "a b")]
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.join_documents(documents(rows)).collect()), key=repr)
    assert got == sorted([(1, 1, 1), (2, 1, 1), (3, 0, 3), (4, 0, 4), (5, 0, 5), (6, 1, 6), (7, 1, 7), (7, 1, 7), (None, 1, None), (8, 1, 1)], key=repr)
    assert ngram_join.join_documents(documents(rows).limit(0)).count() == 0
    kept = ngram_join.keep_first(documents(rows))
    assert kept.columns == documents(rows).columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 3, 4, 5, 6, 7, 7]


def test_hot_shingles_change_no_link():
    rng = np.random.default_rng(0)
    for n in (3, 7, 20, 85, 300):
        for _ in range(20):
            base = np.unique(rng.integers(0, 2**64, n + 40, dtype=np.uint64))
            a = base[:n]
            drop = int(rng.integers(0, n // 4 + 1))
            b = np.sort(np.concatenate([a[drop:], base[n : n + int(rng.integers(0, max(1, n // 8)))]]))
            if not jaccard_at_least(a, b, 75):
                continue
            for hot in (np.empty(0, np.uint64), np.sort(rng.choice(base, len(base) // 2, replace=False)), base):
                assert np.array_equal(a, b) or np.intersect1d(ngram_join.segment_keys(a, hot), ngram_join.segment_keys(b, hot)).size


def test_sketches_bound_the_difference():
    rng = np.random.default_rng(1)
    base = np.unique(rng.integers(0, 2**64, 900, dtype=np.uint64))
    for n, m, shift in ((30, 32, 5), (300, 310, 40), (500, 500, 499), (4, 900, 0)):
        a, b = base[:n], base[shift : shift + m]
        x, y = pairs.parity_sketch(a), pairs.parity_sketch(b)
        f = pairs._folded([x, y], min(len(x), len(y)))
        assert np.bitwise_count(f[0] ^ f[1]).sum() <= len(np.setxor1d(a, b))


def test_components(spark):
    links = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 1), (20, 21), (5, 5), (30, 31), (31, 30)] + [(100, i) for i in range(101, 140)] + [(i, i + 1) for i in range(200, 230)]
    own = Scratch(spark, "test")
    found = components(spark.createDataFrame(links, "a long, b long"), own)
    got = {r["node"]: r["component"] for r in found.collect()}
    assert {n: c for n, c in got.items() if n < 40} == {1: 1, 2: 1, 3: 1, 7: 1, 8: 1, 9: 1, 20: 20, 21: 20, 30: 30, 31: 30}
    assert all(got[i] == 100 for i in range(100, 140)) and all(got[i] == 200 for i in range(200, 231)) and len(got) == found.count()
    assert sum(t is not None for t in own.tables.values()) == 1  # superseded rounds are gone
    assert components(spark.createDataFrame([], "a long, b long"), own).count() == 0


def test_further_links_join_components(spark):
    own = Scratch(spark, "test")
    labels = components(spark.createDataFrame([(1, 2), (2, 3), (7, 8), (20, 21)], "a long, b long"), own)
    more = pairs.relabelled(labels, spark.createDataFrame([(3, 8), (30, 31), (2, 1), (31, 21)], "a long, b long"), own)
    assert sorted((r["node"], r["component"]) for r in more.collect()) == [(1, 1), (2, 1), (3, 1), (7, 1), (8, 1), (20, 20), (21, 20), (30, 20), (31, 20)]


def brute_paragraphs(rows, least):
    """doc_id -> (runs cut, words cut) of distinct doc_ids."""
    return {i: (int((np.diff(np.append(0, g.astype(int))) == 1).sum()), int(g.sum())) for i, g in words_to_cut(rows, least).items()}


def words_to_cut(rows, least):
    """doc_id -> which of its words go, by comparing all lines and all runs of words."""
    words = {i: bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode()).split() for i, t in rows}
    found = []
    for i, t in sorted(rows):
        at = 0
        for line in (t or "").encode().split(b"\n"):
            n = len(line.split())
            if n >= least:
                found.append((i, at, at + n, shingles(line)))
            at += n
    parent = list(range(len(found)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(found)):
        for b in range(a):
            if jaccard_at_least(found[a][3], found[b][3], 75):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    gone = {i: np.zeros(len(w), bool) for i, w in words.items()}
    for a, (i, x, y, _) in enumerate(found):
        if found[find(a)][0] != i:
            gone[i][x:y] = True
    places = defaultdict(list)
    for i in sorted(words):
        for k in range(len(words[i]) - least + 1):
            run = tuple(words[i][k : k + least])
            if not gone[i][k : k + least].any() and len(set(run)) > 1:
                places[run].append((i, k))
    more = {i: g.copy() for i, g in gone.items()}
    for (i, k), *later in places.values():
        for j, m in later:
            if j != i:
                more[j][m : m + least] = True
    return more


@pytest.mark.parametrize("least", [10, 25, 50])
def test_paragraphs_equal_brute_force(spark, documents, corpus, least):
    rng = random.Random(least)
    vocabulary = [f"v{k}" for k in range(5000)]
    passage = "\n".join(" ".join(rng.choice(vocabulary) for _ in range(n)) for n in (12, 26, 17))
    rows = [x for x in corpus if x[0] != 505]
    for k in range(12):  # a passage over line breaks, inside of lines
        w = [rng.choice(vocabulary) for _ in range(30 + 7 * k)]
        at = rng.randrange(len(w))
        rows.append((600 + k, " ".join(w[:at]) + " " + passage + " " + " ".join(w[at:])))
    got = {r["doc_id"]: (r["n_removed"], r["removed_words"]) for r in paragraphs.report(documents(rows).repartition(4), least).collect()}
    assert got == brute_paragraphs(rows, least)
    assert least < 50 or all(got[600 + k][1] >= 55 for k in range(1, 12))


@pytest.mark.parametrize("stretch", [64, 1 << 20])
def test_stretches_do_not_matter(monkeypatch, stretch):
    monkeypatch.setattr(paragraphs, "STRETCH", stretch)
    w = np.random.default_rng(2).integers(0, 2**63, 1000, dtype=np.uint64)
    at, low, anchor, own = paragraphs.sliding(w, [1000], 50, 8)
    assert at.tolist() == list(range(951)) and len(set(own.tolist())) == 951 and ((anchor >= at) & (anchor <= at + 42)).all()
    inner = paragraphs.sliding(w[100:400], [300], 50, 8)
    assert inner[1].tolist() == low[100:351].tolist() and (inner[2] + 100).tolist() == anchor[100:351].tolist() and inner[3].tolist() == own[100:351].tolist()
    runs = paragraphs.sliding(w, [20, 100, 49, 50, 781], 50, 8)
    assert runs[0].tolist() == [*range(20, 71), 169, *range(219, 951)] and runs[3].tolist() == own[runs[0]].tolist()


def test_bands_follow_the_recall():
    rng = np.random.default_rng(0)
    assert paragraphs.BANDS == paragraphs.bands_for(0.75, 4, 0.999) == 19
    met = 0
    for _ in range(400):  # pairs at three quarters
        base = rng.integers(0, 2**64, 70, dtype=np.uint64)
        both = [base[:60], np.concatenate([base[:51], base[61:69]])]
        keys = paragraphs.band_keys(np.concatenate(both), np.array([0, 60]))
        met += bool((keys[0] == keys[1]).any())
    assert met / 400 >= 0.99


def test_cut_keeps_firsts_columns_and_short_lines(spark, documents):
    line = "one two three four five six seven eight nine ten eleven"
    rows = [(2, f"short\n{line} twelve\nshort"), (1, f"{line} twelve"), (3, line.upper() + " TWELVE"), (4, None), (5, ""), (None, f"{line} twelve"), (6, f"{line} twelve\n{line} twelve")]
    docs = documents(rows)
    out = paragraphs.cut(docs, 10)
    assert out.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"], r["n_chars"]) for r in out.collect()), key=repr) == sorted([(2, "short\nshort", 11), (1, f"{line} twelve", 62), (3, "", 0), (4, None, None), (5, "", 0), (None, f"{line} twelve", 62), (6, "", 0)], key=repr)
    assert paragraphs.cut(docs.limit(0)).count() == 0 and paragraphs.report(docs.limit(0)).count() == 0
    assert {r["text"] for r in paragraphs.cut(docs).collect()} == {r["text"] for r in docs.collect()}  # passages are of fifty words or more


def test_passages_of_fifty_words_are_found(spark, documents):
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(10**5)}"
    passage = " ".join(word() for _ in range(55))
    rows = [(i, f"{word()} {word()}\n{passage}\n" + " ".join(word() for _ in range(30))) for i in range(40)]
    got = {r["doc_id"]: (r["n_removed"], r["removed_words"]) for r in paragraphs.report(documents(rows)).collect()}
    assert got == {i: (1, 55) if i else (0, 0) for i in range(40)}


def test_passages_inside_longer_lines_are_cut(spark, documents):
    rng = random.Random(6)
    prose = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    passage, loop = prose(60), " ".join(["x y"] * 60)
    parts = {i: (prose(20 + 31 * i), prose(200 - 17 * i)) for i in range(1, 9)}
    rows = [(i, f"{a} {passage} {b}") for i, (a, b) in parts.items()] + [(20, prose(70) + "\n" + passage.upper()), (21, f"{prose(90)} {' '.join(passage.split()[:49])} {prose(9)}"), (22, loop), (23, "as " * 300), (24, "as " * 300 + "end")]
    found = {r["doc_id"]: (r["n_removed"], r["removed_words"]) for r in paragraphs.report(documents(rows).repartition(3)).collect()}
    assert found == {1: (0, 0), **{i: (1, 60) for i in range(2, 9)}, 20: (1, 60), 21: (0, 0), 22: (0, 0), 23: (0, 0), 24: (0, 0)}
    texts = {r["doc_id"]: r["text"] for r in paragraphs.cut(documents(rows)).collect()}
    assert all(texts[i] == f"{a} {b}" for i, (a, b) in parts.items() if i > 1) and texts[1] == rows[0][1] and texts[22] == loop


@pytest.mark.parametrize("family", [pairs.FAMILY, 1])
def test_colliding_pairs_are_linked_at_every_family_size(spark, monkeypatch, family):
    import zstandard

    monkeypatch.setattr(pairs, "FAMILY", family)
    w = [f"w{i}" for i in range(300)]
    # 1, 2 and 4 are near each other; 3 is of their size, but not near.  4 shares a key with 3 alone, 1 and 2 share one with 3.
    texts = {1: w[:60], 2: w[1:61], 3: w[100:160], 4: w[2:62]}
    made = {i: shingles(" ".join(t)) for i, t in texts.items()}
    keyed = [(7, 3), (7, 1), (7, 2), (8, 3), (8, 4)]
    batches = list(pairs.pack(np.array([k for k, _ in keyed], np.uint64), np.array([i for _, i in keyed]), np.array([len(made[i]) for _, i in keyed]), 4))
    packed = spark.createDataFrame([(r["bucket"], bytearray(r["pairs"])) for b in batches for r in b.to_pylist()], pairs.PACKED)
    rows = [(i, len(made[i]), bytearray(pairs.parity_sketch(made[i])), bytearray(zstandard.compress(" ".join(t).encode()))) for i, t in texts.items()]
    table = spark.createDataFrame(rows, pairs.TEXTS)
    found = pairs.linked(packed, lambda items: table.join(items, "item", "left_semi"), 75, Scratch(spark, "colliding"), colliding=True)
    assert {r["node"]: r["component"] for r in found.collect()} == {1: 1, 2: 1}


def test_pairs_of_many_buckets_leave_once(spark):
    """Near copies that share 40 keys: a pair is in up to 40 buckets, but is one row; packed, the buckets' rows don't follow the pairs."""
    keys, items = np.meshgrid(np.arange(40, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), np.arange(1, 301), indexing="ij")
    packed = pairs.pack(keys.ravel(), items.ravel(), np.full(keys.size, 50), 64)
    table = spark.createDataFrame([(r["bucket"], bytearray(r["pairs"])) for b in packed for r in b.to_pylist()], pairs.PACKED)
    buckets = table.select("bucket").distinct().count()
    found = pairs.candidates(table, 75, parts=3)
    assert buckets > 20 and found.count() <= 4 * buckets
    assert sorted(map(tuple, pairs.distinct_pairs(found).collect())) == [(1, i) for i in range(2, 301)]
    assert pairs.unpacked_groups(found).count() == keys.size
