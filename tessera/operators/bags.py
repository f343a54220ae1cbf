"""Bag-of-words similarities of fragments, joined through the words that they share.

A pair of fragments that shares no word isn't made: it is at its mode's far end (the standardised modes that look at words of one fragment
give it a finite value, but never a near one).  All modes need one equi-join on the word and sums of it; norms and totals join as small
per-fragment tables.  Very common words make that join heavy; adaptive execution splits their partitions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.tiling import fragment_of, kmers

#: Smaller is nearer in every mode; products are negated.
MODES = ("d2", "cosine", "e", "e_norm", "min", "min_norm_min", "min_norm_max", "min_norm_avg", "jaccard", "d2s", "d2s_observed", "d2s_missing", "d2star", "d2star_missing")


def term_vectors(df: DataFrame, k: int, fragment: int | None = None, text: str = "residues") -> DataFrame:
    """seq_id, frag, word, tf.  Without a fragment length each sequence is one fragment."""
    words = kmers(df.select("seq_id", text, (F.length(text) - k + 1).alias("_n")), k, text)
    frag = fragment_of(F.col("pos"), F.col("_n"), fragment) if fragment else F.lit(0)
    return words.groupBy("seq_id", frag.alias("frag"), "word").agg(F.count("*").cast("double").alias("tf"))


def normalised(vectors: DataFrame) -> DataFrame:
    """tf over the fragment's Euclidean norm."""
    w = Window.partitionBy("seq_id", "frag")
    return vectors.withColumn("tf", F.col("tf") / F.sqrt(F.sum(F.col("tf") * F.col("tf")).over(w)))


def word_probability(word: Column, background: dict[str, float]) -> Column:
    """Product of the symbols' probabilities."""
    table = F.create_map(*[v for c, p in sorted(background.items()) for v in (F.lit(c), F.lit(math.log(p) if p > 0 else -1e300))])
    return F.exp(F.aggregate(F.split(word, ""), F.lit(0.0), lambda s, c: s + F.coalesce(F.element_at(table, c), F.lit(-1e300))))


def _totals(v: DataFrame, p: str) -> DataFrame:
    return v.groupBy("seq_id", "frag").agg(F.sum("tf").alias(f"{p}_len"), F.sum(F.col("tf") * F.col("tf")).alias(f"{p}_sq"), F.count("*").alias(f"{p}_n")).select(F.col("seq_id").alias(f"{p}_id"), F.col("frag").alias(f"{p}_frag"), f"{p}_len", f"{p}_sq", f"{p}_n")


def _standard(x: Column, y: Column) -> Column:
    """x y / sqrt(x^2 + y^2); 0 where both are 0."""
    return F.coalesce(x * y / F.nullif(F.sqrt(x * x + y * y), F.lit(0.0)), F.lit(0.0))


def _one_sided(vectors: DataFrame, pairs: DataFrame, own: str, other: str, background: dict[str, float]) -> DataFrame:
    """Of each fragment and each length of a partner: the sum of `_standard` over the fragment's words as if the partner held none of them."""
    p = word_probability(F.col("word"), background)
    v = vectors.groupBy("seq_id", "frag").agg(F.collect_list(F.struct("tf", p.alias("p"))).alias("v"), F.sum("tf").alias("n"))
    v = v.select(F.col("seq_id").alias(f"{own}_id"), F.col("frag").alias(f"{own}_frag"), "v", "n")
    wanted = pairs.select(f"{own}_id", f"{own}_frag", f"{other}_len").distinct()
    total = F.aggregate("v", F.lit(0.0), lambda t, w: t + _standard(w["tf"] - F.col("n") * w["p"], -F.col(f"{other}_len") * w["p"]))
    return wanted.join(v, [f"{own}_id", f"{own}_frag"]).select(f"{own}_id", f"{own}_frag", f"{other}_len", total.alias(f"{own}_alone"))


def fragment_measures(queries: DataFrame, subjects: DataFrame, modes: tuple[str, ...], background: dict[str, float] | None = None) -> DataFrame:
    """Term vectors -> query_id, qfrag, subject_id, sfrag and a column of distances for each mode, of all fragment pairs that share a word.

    One join and one aggregation for all modes.  With M, N the fragments' words, p a word's probability, x = tf - M p and y = tf - N p:
    d2s_observed sums x y / sqrt(x^2 + y^2) over the words of either fragment, d2s adds M N (1 - their probability) / sqrt(M^2 + N^2) for words
    of neither, d2s_missing sums over shared words alone; d2star and d2star_missing do so with x y / (p sqrt(M N)), and sqrt(M N)
    (1 - probability).  Over the words of either fragment and of neither, x y / p adds up to the shared words' tf tf / p, less M N."""
    for mode in modes:
        if mode not in MODES:
            raise ValueError(f"unknown mode {mode!r}; known are {', '.join(MODES)}")
    standard = [m for m in modes if m.startswith("d2s")]
    if standard and not background:
        raise ValueError(f"{standard[0]} needs background symbol probabilities")
    q = queries.select("word", F.col("seq_id").alias("q_id"), F.col("frag").alias("q_frag"), F.col("tf").alias("a"))
    s = subjects.select("word", F.col("seq_id").alias("s_id"), F.col("frag").alias("s_frag"), F.col("tf").alias("b"))
    met, keys = q.join(s.hint("merge"), "word"), ["q_id", "q_frag", "s_id", "s_frag"]  # term vectors: no broadcast by a guessed size
    sums = {"dot": F.sum(F.col("a") * F.col("b")), "least": F.sum(F.least("a", "b")), "shared": F.count("*")}
    tq, ts = _totals(queries, "q"), _totals(subjects, "s")
    if standard:
        tq, ts = (t.join(v.groupBy(F.col("seq_id").alias(f"{p}_id"), F.col("frag").alias(f"{p}_frag")).agg(F.sum(word_probability(F.col("word"), background)).alias(f"{p}_p")), [f"{p}_id", f"{p}_frag"]) for p, t, v in (("q", tq, queries), ("s", ts, subjects)))
        met = met.join(tq, ["q_id", "q_frag"]).join(ts, ["s_id", "s_frag"]).withColumn("p", word_probability(F.col("word"), background))
        x, y = F.col("a") - F.col("q_len") * F.col("p"), F.col("b") - F.col("s_len") * F.col("p")
        both = _standard(x, y)
        sums |= {"standard": F.sum(both), "star": F.sum(x * y / F.col("p")), "over": F.sum(F.col("a") * F.col("b") / F.col("p")), "met_p": F.sum("p")}
        sums["beyond"] = F.sum(both - _standard(x, -F.col("s_len") * F.col("p")) - _standard(-F.col("q_len") * F.col("p"), y))
    out = met.groupBy(*keys).agg(*[v.alias(n) for n, v in sums.items()])
    out = out.join(tq, ["q_id", "q_frag"]).join(ts, ["s_id", "s_frag"])
    m, n, dot = F.col("q_len"), F.col("s_len"), F.col("dot")
    if {"d2s", "d2s_observed"} & set(modes):
        for own, other, v in (("q", "s", queries), ("s", "q", subjects)):
            out = out.join(_one_sided(v, out, own, other, background), [f"{own}_id", f"{own}_frag", f"{other}_len"])
        observed = F.col("beyond") + F.col("q_alone") + F.col("s_alone")
    cosine = dot / F.sqrt(F.col("q_sq") * F.col("s_sq"))

    def distance(mode: str) -> Column:
        if mode == "d2s":
            return -(observed + m * n * (1 - (F.col("q_p") + F.col("s_p") - F.col("met_p"))) / F.sqrt(m * m + n * n))
        if mode == "d2s_observed":
            return -observed
        if mode == "d2s_missing":
            return -F.col("standard")
        if mode == "d2star":
            return -(F.col("over") - m * n) / F.sqrt(m * n)
        if mode == "d2star_missing":
            return -F.col("star") / F.sqrt(m * n)
        return {
            "d2": -dot, "cosine": -cosine, "e": F.col("q_sq") + F.col("s_sq") - 2 * dot, "e_norm": 2 - 2 * cosine, "min": -F.col("least"),
            "min_norm_min": -F.col("least") / F.least(m, n), "min_norm_max": -F.col("least") / F.greatest(m, n), "min_norm_avg": -F.col("least") / ((m + n) / 2),
            "jaccard": 1 - F.col("shared") / (F.col("q_n") + F.col("s_n") - F.col("shared")),
        }[mode]

    return out.select(F.col("q_id").alias("query_id"), F.col("q_frag").alias("qfrag"), F.col("s_id").alias("subject_id"), F.col("s_frag").alias("sfrag"), *[distance(x).alias(x) for x in modes])


def fragment_distances(queries: DataFrame, subjects: DataFrame, mode: str = "d2", background: dict[str, float] | None = None) -> DataFrame:
    """Term vectors -> query_id, qfrag, subject_id, sfrag, distance of all fragment pairs that share a word."""
    return fragment_measures(queries, subjects, (mode,), background).withColumnRenamed(mode, "distance")


def over_fragments(fragments: DataFrame, mode: str = "BestOfBest") -> DataFrame:
    """Fragment distances (query_id, qfrag, subject_id, sfrag, distance) -> query_id, subject_id, distance by row and column minima."""
    keys = ["query_id", "subject_id"]
    if mode == "BestOfBest":
        return fragments.groupBy(*keys).agg(F.min("distance").alias("distance"))
    rows = fragments.groupBy(*keys, "qfrag").agg(F.min("distance").alias("m")).groupBy(*keys).agg(F.max("m").alias("rmax"), F.avg("m").alias("ravg"))
    cols = fragments.groupBy(*keys, "sfrag").agg(F.min("distance").alias("m")).groupBy(*keys).agg(F.max("m").alias("cmax"), F.avg("m").alias("cavg"))
    d = {"Hausdorff": F.greatest("rmax", "cmax"), "HausdorffAverage": F.greatest("ravg", "cavg"), "HausdorffAverageAverage": (F.col("ravg") + F.col("cavg")) / 2}[mode]
    return rows.join(cols, keys).select(*keys, d.alias("distance"))


def vector_distance(x: Column, y: Column) -> Column:
    """Euclidean distance of two maps key -> weight; a key that one lacks weighs 0 there."""
    both = F.map_zip_with(x, y, lambda k, a, b: F.coalesce(a, F.lit(0.0)) - F.coalesce(b, F.lit(0.0)))
    return F.sqrt(F.aggregate(F.map_values(both), F.lit(0.0), lambda s, d: s + d * d))


def vector_dot(x: Column, y: Column) -> Column:
    both = F.map_zip_with(x, y, lambda k, a, b: F.coalesce(a, F.lit(0.0)) * F.coalesce(b, F.lit(0.0)))
    return F.aggregate(F.map_values(both), F.lit(0.0), lambda s, d: s + d)
