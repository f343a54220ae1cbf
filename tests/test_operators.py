import itertools
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions.matrices import blosum62, match_matrix
from tessera.operators import bags, distributions, domains, evaluation, kernels, mixtures, pairwise, ranking, sampling, tiling, vocabulary

AC = match_matrix("acgt")


def sequences(spark, *texts):
    return spark.createDataFrame([(f"s{i}", t) for i, t in enumerate(texts)], "seq_id string, residues string")


def rows(df):
    return sorted(map(tuple, df.collect()))


def hamming(a, b):
    return sum(x != y for x, y in zip(a, b, strict=True))


@pytest.mark.parametrize("text", ["", "ac", "acg", "acgtacgt", "acgt" * 60])
@pytest.mark.parametrize("skip", [1, 3])
def test_kmers(spark, text, skip):
    want = [("s0", i, text[i : i + 3]) for i in range(0, max(0, len(text) - 2)) if i % skip == 0]
    assert rows(tiling.kmers(sequences(spark, text), 3, skip=skip)) == sorted(want)


def test_long_text_is_cut_in_chunks(spark):
    rng = np.random.default_rng(1)
    text = "".join(rng.choice(list("acgté"), 20_000))
    got = tiling.kmers(sequences(spark, text), 7).orderBy("pos").collect()
    assert [r["word"] for r in got] == [text[i : i + 7] for i in range(len(text) - 6)]


def test_sampling(spark):
    df = spark.range(1000).withColumnRenamed("id", "seq_id")
    assert sampling.sample(df, 70).count() == 70
    assert rows(sampling.sample(df, 70, seed=1)) == rows(sampling.sample(df.repartition(7), 70, seed=1))
    split = sampling.split_train_test(df, 30)
    assert split.where("is_test").count() == 30 and split.count() == 1000
    assert sampling.split_train_test(df, 0).where("is_test").count() == 0
    assert {r["part"] for r in sampling.folds(df, 5).select("part").distinct().collect()} == {1, 2, 3, 4, 5}
    assert sampling.query_subset(df, df.limit(3)).count() == 3 and sampling.query_subset(df, n=4).count() == 4 and sampling.query_subset(df).count() == 1000


def test_minima_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    texts = ["".join(rng.choice(list("acgt"), n)) for n in (3, 5, 12, 2)]
    df = sequences(spark, *texts)
    got = {(r["query_id"], r["subject_id"]): (r["row_min"], r["col_min"]) for r in pairwise.minima(df, df, 3, AC, "edit").collect()}
    for (i, a), (j, b) in itertools.product(enumerate(texts), repeat=2):
        if len(a) < 3 or len(b) < 3:
            assert (f"s{i}", f"s{j}") not in got
            continue
        m = [[hamming(a[x : x + 3], b[y : y + 3]) for y in range(len(b) - 2)] for x in range(len(a) - 2)]
        assert got[f"s{i}", f"s{j}"] == (list(map(min, m)), [min(c) for c in zip(*m, strict=True)])


def test_distance_order(spark):
    df = sequences(spark, "acgtacgtta", "ttgacgacca", "acgtacg")
    d = {m: {tuple(r)[:2]: r["distance"] for r in pairwise.distances(df, df, 4, AC, m, "edit").collect()} for m in pairwise.MODES}
    for pair in d["Hausdorff"]:
        assert d["BestOfBest"][pair] <= d["HausdorffAverageAverage"][pair] <= d["HausdorffAverage"][pair] <= d["Hausdorff"][pair]
        assert d["Hausdorff"][pair] == d["Hausdorff"][pair[::-1]]


def test_queries_in_parts(spark, monkeypatch):
    df = sequences(spark, "acgta", "ccgta", "acgtt")
    want = rows(pairwise.distances(df, df, 3, AC, kind="edit"))
    monkeypatch.setattr(pairwise, "QUERY_BYTES", 6)
    assert rows(pairwise.distances(df, df, 3, AC, kind="edit")) == want


def brute_align(q, s, sim, go, ge, local):
    from functools import cache

    @cache
    def best(i, j, state):
        if i == 0 and j == 0:
            return 0 if state == "m" else -(10**6)
        out = [0] if local and state == "m" else []
        if state == "m":
            if i and j:
                out.append(max(best(i - 1, j - 1, t) for t in "mxy") + sim[q[i - 1], s[j - 1]])
        elif state == "x" and i:
            out.append(max(best(i - 1, j, "x") + ge, max(best(i - 1, j, t) for t in "my") + go + ge))
        elif state == "y" and j:
            out.append(max(best(i, j - 1, "y") + ge, max(best(i, j - 1, t) for t in "mx") + go + ge))
        return max(out, default=-(10**6))

    if local:
        return max(best(i, j, "m") for i in range(len(q) + 1) for j in range(len(s) + 1))
    return max(best(len(q), len(s), t) for t in "mxy")


@pytest.mark.parametrize("local", [False, True])
def test_alignment_equals_brute_force(local):
    rng = np.random.default_rng(3)
    sim = match_matrix("acgt", 4, -3).sim.astype(int)
    for _ in range(25):
        q, s = rng.integers(0, 4, rng.integers(1, 8)), rng.integers(0, 4, rng.integers(1, 8))
        assert kernels.align(q, s, sim, -3, -1, local) == brute_align(tuple(q), tuple(s), sim, -3, -1, local)


@pytest.mark.parametrize("part", [2, 1000])
def test_within_equals_brute_force(spark, part):
    words = ["".join(w) for w in itertools.product("acg", repeat=3)]
    protos = words[::4]
    w = spark.createDataFrame([(x,) for x in words], "word string")
    p = spark.createDataFrame([(f"p{i:02}", x) for i, x in enumerate(protos)], "proto_id string, word string")
    want = sorted((x, f"p{i:02}", i, hamming(x, y)) for x in words for i, y in enumerate(protos) if hamming(x, y) <= 1)
    assert rows(kernels.within(w, p, 1, AC, "edit", part=part)) == want
    near = rows(kernels.within(w, p, 1, AC, "edit", nearest=True, part=part))
    best = {}
    for x, i, n, d in want:
        best[x] = min(best.get(x, (9, 9, "")), (d, n, i))
    assert near == sorted((x, i, n, d) for x, (d, n, i) in best.items())


def test_greedy_clusters(spark):
    words = ["".join(w) for w in itertools.product("acgt", repeat=3)]
    df = spark.createDataFrame([(x,) for x in words], "word string")
    got = vocabulary.greedy_clusters(df, 1, AC, "edit", increment=4, seed=2)
    order = [r["word"] for r in df.orderBy(sampling.order_of("word", 2), "word").collect()]
    left, want, made = list(order), {}, 0
    while left:
        batch = left[:4]
        for i, p in enumerate(batch):
            want[p] = (made + i, 0)
        for x in left[4:]:
            near = next(((made + i, hamming(x, p)) for i, p in enumerate(batch) if hamming(x, p) <= 1), None)
            if near:
                want[x] = near
        made += len(batch)
        left = [x for x in left if x not in want]
    assert {r["word"]: (r["proto_no"], r["distance"]) for r in got.collect()} == want


def test_words_far_from_themselves_are_left_out(spark):
    df = spark.createDataFrame([("ww",), ("aa",)], "word string")
    assert {r["word"] for r in vocabulary.greedy_clusters(df, 6, blosum62()).collect()} == {"ww"}


def test_medoids():
    words = ["aaaa", "aaac", "aacc", "gggg", "gggt"]
    centres, near = vocabulary.k_medoids(words, ["aaac", "gggg"], AC, 2, "edit")
    assert near == [0, 0, 0, 1, 1] and centres[0] == "aaac"
    codes = AC.code(["".join(x) for x in itertools.product("acgt", repeat=4)] + ["aaaa"] * 40)
    d = AC.distances("edit")
    exact, bandit = vocabulary.medoid(codes, d), vocabulary.medoid(codes, d, bandit=True)
    total = kernels.block_distances(codes, codes, d).sum(1)
    assert total[bandit] <= total[exact] * 1.05


def test_average_linkage_and_tree():
    assert vocabulary.average_linkage(["aaaa", "aaac", "tttt", "aaag"], 1, AC, "edit") == [0, 0, 1, 0]
    tree = vocabulary.CoverTree([3, 1], hamming)
    assert tree.insert("aaaa") == ["aaaa", "aaaa"] and tree.insert("aacc") == ["aaaa", "aacc"] and tree.insert("tttt") == ["tttt", "tttt"]


def test_topic_without_relevant_documents(spark):
    r = spark.createDataFrame([("a", "x", 2.0), ("a", "y", 2.0), ("b", "x", 1.0)], "topic string, doc string, score double")
    q = spark.createDataFrame([("a", "y", 1), ("a", "z", 1), ("c", "x", 1), ("a", "x", 0)], "topic string, doc string, rel int")
    assert rows(evaluation.summary(r, q, ignore_missing=False)) == [("a", 2, 1, 2, 0.25), ("b", 0, 0, 1, 0.0), ("c", 1, 0, 0, 0.0)]
    assert {(x["topic"], x["rank"], x["rec"]) for x in evaluation.judged(r, q).collect()} == {("a", 1, 0.0), ("a", 2, 0.5), ("b", 1, 1.0)}


def test_relevance_by_class_equals_its_pairs(spark):
    classes = [("a", 1), ("a", 1), ("b", 1), ("c", 1), ("c", 2), ("d", 2), ("e", 3), ("f", None), (None, 1), ("g", 4), ("h", 4)]
    pairs = {(x, y, 1) for x, p in classes for y, q in classes if x and y and x != y and p is not None and p == q}
    r = spark.createDataFrame([(x, y, float(i * 7 % 5)) for i, (x, y) in enumerate((x, y) for x in "abcdefxg" for y in "abcdefx" if (x, y) != ("g", "g"))], "topic string, doc string, score double")
    r = r.where("topic <> 'g'")  # without results
    q = spark.createDataFrame(sorted(pairs), "topic string, doc string, rel int")
    by_class = evaluation.SameClass(spark.createDataFrame(classes, "doc string, class int"))
    assert rows(evaluation.judged(r, by_class)) == rows(evaluation.judged(r, q))
    for ignore in (True, False):
        assert rows(evaluation.summary(r, by_class, ignore)) == rows(evaluation.summary(r, q, ignore))
    for measure in (evaluation.interpolated, evaluation.stepped, lambda r, q: evaluation.precision_at(r, q, [1, 3, 9])):
        assert rows(measure(r, by_class)) == rows(measure(r, q))


def test_judging_by_class_makes_no_pairs(spark, tmp_path):
    """12,000 docs of one class: 144 million pairs of it, of which one is ranked."""
    docs = spark.range(12_000).select(F.col("id").alias("doc"), F.lit(0).alias("class"))
    spark.createDataFrame([(1, 2, 1.0), (1, 1, 0.5)], "topic long, doc long, score double").write.parquet(f"{tmp_path}/r")
    j = evaluation.judged(spark.read.parquet(f"{tmp_path}/r"), evaluation.SameClass(docs))
    assert rows(j.select("topic", "doc", "rel", "relevant")) == [(1, 1, 0, 11_999), (1, 2, 1, 11_999)]


@pytest.mark.parametrize("exclude_self", [False, True])
def test_nearest_signatures_equal_brute_force(spark, monkeypatch, exclude_self):
    rng = np.random.default_rng(11)
    made = [(int(i), sorted(set(rng.choice(9, rng.integers(0, 9)).tolist()))) for i in rng.permutation(150)] + [(150, None), (200, [0, 1]), (201, [0, 1])]
    made += [(i, [2, 3]) for i in range(300, 340)]  # copies: ties of every query
    df = spark.createDataFrame(made, "seq_id long, features array<int>")
    d = lambda x, y: 1 - len(x & y) / len(x | y)
    sets = {i: set(f or ()) for i, f in made}
    want = {q: sorted((d(x, y), s) for s, y in sets.items() if x & y and not (exclude_self and s == q))[:4] for q, x in sets.items()}
    monkeypatch.setattr(ranking, "TILE", 16)
    monkeypatch.setattr(ranking, "QUERY_BYTES", 4 * 9 * 70)  # several blocks
    got = {q: [] for q in sets}
    for r in sorted(ranking.rank_signatures(df, df, 4, exclude_self).collect(), key=lambda r: (r["query_id"], r["rank"])):
        got[r["query_id"]].append((r["distance"], r["subject_id"]))
    assert got == want


def test_nearest_signatures_in_bounded_memory():
    """A block of queries against a batch of subjects: what is held follows the tiles, not the whole matrix."""
    import tracemalloc

    rng = np.random.default_rng(5)
    own, other = rng.random((20_000, 64)) < 0.5, rng.random((1_024, 64)) < 0.5
    tracemalloc.start()
    nearest = ranking._Nearest(own, own.sum(1), 10)
    for at in range(0, 1_024, 64):
        nearest.add(other[at : at + 64], other[at : at + 64].sum(1), at, np.empty((2, 0), np.int64))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 << 20 and np.isfinite(nearest.distance).all()


def test_bootstrap_holds_the_mean(spark):
    df = spark.createDataFrame([(str(i), float(i)) for i in range(50)], "topic string, m double")
    x = evaluation.bootstrap(df, ["m"]).first()
    assert x["lower"] < x["mean"] == 24.5 < x["upper"]
    assert evaluation.bootstrap(df.limit(0), ["m"]).count() == 0


def test_bootstrap_works_its_rows_out_once(spark):
    made = spark.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    # as of a ranking, a shuffle lies between what makes the rows and the bootstrap
    df = spark.range(60).mapInArrow(run, "id long").groupBy("id").agg(F.max("id").cast("double").alias("m"))
    assert evaluation.bootstrap(df, ["m"], "id").first()["mean"] == 29.5
    assert made.value == 60


def test_distributions(spark):
    die = spark.createDataFrame([(i, 1 / 6) for i in range(1, 7)], "x long, p double")
    two = {r["x"]: r["p"] for r in distributions.kmer_distances(die, 2).collect()}
    assert two[7] == pytest.approx(6 / 36) and sum(two.values()) == pytest.approx(1)
    assert distributions.equal(distributions.convolve(die, die), distributions.kmer_distances(die, 2))
    assert distributions.threshold_for(distributions.with_cdf(die), 0.5) == 3
    assert distributions.p_value_for(distributions.with_cdf(die), 4) == pytest.approx(4 / 6)
    least = {r["x"]: r["p"] for r in distributions.minimum_of(die, 2).collect()}
    assert least[1] == pytest.approx(11 / 36)
    assert distributions.normal_cdf(distributions.normal_inverse(0.3, 2, 5), 2, 5) == pytest.approx(0.3)
    assert distributions.weibull_cdf(distributions.weibull_inverse(0.3, 2, 5), 2, 5) == pytest.approx(0.3)
    assert distributions.weibull_moments(1, 3) == pytest.approx((3, 3))
    assert distributions.mean_of_minima_error({i: 1 / 6 for i in range(1, 7)}, 2, 64) < distributions.mean_of_minima_error({i: 1 / 6 for i in range(1, 7)}, 2, 2)
    assert [r["F"] for r in distributions.interpolate(distributions.with_cdf(die), 6).orderBy("x").collect()] == pytest.approx([i / 6 for i in range(1, 7)])


def test_mixture_recovers_two_parts(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(0, 1, 600), rng.normal(8, 2, 400)])
    models = mixtures.sweep(spark.createDataFrame([(float(v),) for v in x], "x double"), "x", 3)
    assert min(range(3), key=lambda k: models[k].aicc()) >= 1
    two = models[1]
    assert two.mu == pytest.approx([0, 8], abs=0.5) and two.alpha == pytest.approx([0.6, 0.4], abs=0.05)
    assert two.cdf(two.inverse(0.7)) == pytest.approx(0.7) and two.mean() == pytest.approx(x.mean(), abs=1e-3) and two.sd() == pytest.approx(x.std(), abs=1e-2)


def test_mixture_sums_do_not_depend_on_where_they_are_taken(spark):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(float(v),) for v in np.concatenate([rng.normal(0, 1, 80), rng.normal(9, 1, 60)]).round(1)] + [(None,)], "x double")
    here, there = (mixtures.fit(mixtures.Histogram(df, "x", most), 2, epochs=8) for most in (1000, 3))
    assert here.mu == pytest.approx(there.mu) and here.sigma == pytest.approx(there.sigma) and here.log_likelihood == pytest.approx(there.log_likelihood) and here.n == there.n == 140


def test_named_modes(spark):
    q, s = sequences(spark, "acgtacgttagcatg", "ttgacg"), sequences(spark, "ttgacgaccag", "acg")
    got = {m: {(r["query_id"], r["subject_id"]): r["distance"] for r in pairwise.named_distance(q, s, 3, AC, m, 4, "edit").collect()} for m in pairwise.NAMED}
    assert len(pairwise.NAMED) == 12 and all(len(d) == 4 for d in got.values())
    assert got["Projector"] == got["ProjectorAMP"] == got["ProjectorBitEmbedding"] == got["HausdorffAverageAverage"]
    assert all(got["Slice"][p] <= got["SliceNoFollow"][p] and got["SliceVertical"][p] <= got["SliceVerticalNoFollow"][p] and got["BestOfBest"][p] <= got["Slice"][p] for p in got["Slice"])
    with pytest.raises(ValueError):
        pairwise.named_distance(q, s, 3, AC, "Other")


def test_sliced_minima_by_hand(spark):
    """The two anti-diagonals at column 0, then the whole diagonal through the best of their cells."""
    (r,) = pairwise.sliced_minima(sequences(spark, "aacg"), sequences(spark, "acgt"), 2, AC, 10, "edit").collect()
    # words aa ac cg by ac cg gt: cells (0, 0) = 1, (0, 1) = 2, (1, 0) = 0; the diagonal through (1, 0) goes on to (2, 1) = 0
    assert (r["row_min"], r["col_min"]) == ([1, 0, 0], [0, 0, None])


def test_alignments_equal_plain_recursion(spark):
    from functools import cache

    def best(x, y, local):
        sim = lambda a, b: 2 if a == b else -1

        @cache
        def go(i, j, state):
            """Best score of an alignment of x[:i], y[:j] that ends in a match (0), or a gap in y (1) or in x (2)."""
            floor = 0 if local and state == 0 else -(10**6)
            if i == j == 0:
                return 0 if state == 0 else -(10**6)
            if state == 0:
                return max(floor, max(go(i - 1, j - 1, s) for s in range(3)) + sim(x[i - 1], y[j - 1])) if i and j else floor
            a, b = (i - 1, j) if state == 1 else (i, j - 1)
            if min(a, b) < 0:
                return -(10**6)
            return max(max(go(a, b, s) for s in range(3) if s != state) - 4, go(a, b, state) - 1)

        ends = [(i, j) for i in range(len(x) + 1) for j in range(len(y) + 1)] if local else [(len(x), len(y))]
        return max(go(i, j, s) for i, j in ends for s in range(3))

    texts = ["acgtac", "cgta", "ttacg", "a"]
    m = match_matrix("acgt", 2, -1)
    for local in (False, True):
        got = {(r["query_id"], r["subject_id"]): r["score"] for r in pairwise.alignments(sequences(spark, *texts), sequences(spark, *texts), m, local, -3, -1).collect()}
        assert got == {(f"s{a}", f"s{b}"): best(x, y, local) for a, x in enumerate(texts) for b, y in enumerate(texts)}


def test_edges(spark):
    e = spark.createDataFrame([("a", s, s + 3, "b", t, t + 3) for s, t in [(1, 5), (2, 6), (3, 7), (2, 9), (6, 10)]], "id1 string, start1 int, stop1 int, id2 string, start2 int, stop2 int")
    assert rows(domains.merge_consecutive(e)) == [("a", 1, 6, "b", 5, 10), ("a", 2, 5, "b", 9, 12), ("a", 6, 9, "b", 10, 13)]
    assert rows(domains.merge_overlapping(e)) == [("a", 1, 9, "b", 5, 13)]


def test_indexed_ranking_is_part_of_exact(spark):
    df = sequences(spark, "acgtacgtta", "ttgacgacca", "acgtacgttt", "gggggggggg")
    sigs = tiling.kmers(df, 4).groupBy("seq_id").agg(F.collect_set("word").alias("features"))
    exact = {(r["query_id"], r["subject_id"]): r["distance"] for r in ranking.rank_exact(df, df, 4, AC, kind="edit").collect()}
    some = ranking.rank_indexed(df, df, sigs, sigs, 4, AC, kind="edit").collect()
    assert some and all(exact[r["query_id"], r["subject_id"]] == r["distance"] for r in some)


def test_bag_modes_of_equal_texts(spark):
    v = bags.term_vectors(sequences(spark, "acgtacg", "acgtacg"), 2)
    for mode, want in (("e", 0), ("jaccard", 0), ("cosine", -1), ("min_norm_avg", -1)):
        d = {(r["query_id"], r["subject_id"]): r["distance"] for r in bags.fragment_distances(v, v, mode).collect()}
        assert d["s0", "s1"] == pytest.approx(want)
    with pytest.raises(ValueError):
        bags.fragment_distances(v, v, "other")
    with pytest.raises(ValueError):
        bags.fragment_distances(v, v, "d2s")


def test_standardised_modes_equal_loops(spark):
    """Words and background by hand: sums over the words of either sequence, and what words of neither add."""
    one, two = "aacgaac", "acttacgaacc"
    p = {"a": 0.4, "c": 0.3, "g": 0.2, "t": 0.1}
    count = lambda t: Counter(t[i : i + 2] for i in range(len(t) - 1))
    a, b = count(one), count(two)
    m, n = sum(a.values()), sum(b.values())
    prob = {w: p[w[0]] * p[w[1]] for w in a | b}
    s = {w: (a[w] - m * prob[w]) * (b[w] - n * prob[w]) / ((a[w] - m * prob[w]) ** 2 + (b[w] - n * prob[w]) ** 2) ** 0.5 for w in a | b}
    star = {w: (a[w] - m * prob[w]) * (b[w] - n * prob[w]) / (prob[w] * (m * n) ** 0.5) for w in a | b}
    unseen, both = 1 - sum(prob.values()), a.keys() & b.keys()
    want = {
        "d2s": -(sum(s.values()) + m * n * unseen / (m * m + n * n) ** 0.5), "d2s_observed": -sum(s.values()), "d2s_missing": -sum(s[w] for w in both),
        "d2star": -(sum(star.values()) + (m * n) ** 0.5 * unseen), "d2star_missing": -sum(star[w] for w in both),
    }
    q, r = (bags.term_vectors(sequences(spark, t), 2) for t in (one, two))
    got = bags.fragment_measures(q, r, tuple(want), p).first()
    assert all(got[k] == pytest.approx(v) for k, v in want.items())


def test_best_fragments(spark):
    f = spark.createDataFrame([("q", "a", 0, 1, 0.5), ("q", "a", 1, 0, 0.9), ("q", "a", 2, 2, 0.9), ("q", "b", 0, 0, 0.7)], "query_id string, subject_id string, qfrag int, sfrag int, similarity double")
    assert rows(ranking.rank_fragments(f, 1)) == [("q", "a", 1, 0, -0.9, 1)]
