"""Toxicity by non-negative positive-unlabelled learning (Kiryo et al., 2017).

Positives are the texts that `labels` confirms as toxic: at most `MOST_POSITIVE`, those of least id hash.  The unlabelled set is a sample of all
`documents`, whether labelled or not, without regard to any label: at most `MOST_UNLABELLED`, those of least id hash.  Both bounds are
documented parameters; equal texts of a set count once.  Labels of 0 are never used.

A text is the set of its words.  Telling words are those that so many positives would hold by chance, at the unlabelled set's rate, with a
probability under one in all words of the positives (the binomial tail): less than one word is expected to be taken for telling wrongly.
There may be any number of them.  The class prior is estimated from the two sets alone:
over the nested sets S_k of the k most telling words, texts holding one of S_k are at least prior * P(S_k) of the unlabelled, so the least
U(S_k) / P(S_k) bounds the prior from above, and meets it where no clean text holds one.  It is taken to be `MOST_PRIOR` at most.  A linear model over
telling words is trained by full-batch Adam on the corrected risk prior * R+(pos) + max(0, R-(unl) - prior * R-(pos)); its logit is the log
odds of being toxic.

Held out: rows whose crc32(doc_id as text) mod 3 is 1; neither their labels nor their texts are learnt from.  The score sees the text alone.  A
null or empty text gets the model's score of no words; nulls in doc_id are not held out, and not learnt from; null labels are left out; a row
labelled twice is toxic if one label says so; repeated rows come back repeated, with one score for one text.  Without any confirmed text every
score is 0; without telling words every score is the prior, `MOST_PRIOR`, under the threshold.  Extra columns are not read, but `drop_toxic`
keeps those of docs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, slices

MOST_POSITIVE = MOST_UNLABELLED = 20_000
#: A telling word is in so many positive texts at least.
LEAST_DOCS = 3
MOST_PRIOR = 0.5
THRESHOLD = 0.7
#: ASCII marks end a word, as do blanks.
BREAK = {c: 32 for c in range(128) if not chr(c).isalnum()}


def words_of(text: str | None) -> set[str]:
    return set((text or "").lower().translate(BREAK).split())


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


class Model:
    """Weights of words and a bias; without a bias, the score is 0."""

    def __init__(self, weights: dict[str, float], bias: float | None):
        self.weights, self.bias, self.vocabulary = weights, bias, frozenset(weights)

    def score(self, text: str | None) -> float:
        if self.bias is None:
            return 0.0
        z = self.bias + sum(self.weights[w] for w in sorted(self.vocabulary & words_of(text)))
        return 1.0 / (1.0 + float(np.exp(-min(60.0, max(-60.0, z)))))


class Bags:
    """Texts as sets of feature numbers, flat."""

    def __init__(self, texts: list[list[int]], features: int):
        self.n, self.features = len(texts), features
        self.row = np.repeat(np.arange(len(texts)), list(map(len, texts)))
        self.column = np.array([f for t in texts for f in t], np.int64)

    def logits(self, w: np.ndarray, b: float) -> np.ndarray:
        return np.bincount(self.row, w[self.column], self.n) + b

    def gradient(self, slope: np.ndarray) -> np.ndarray:
        """Of the sum of slope * logit: by weight, and by the bias."""
        return np.append(np.bincount(self.column, slope[self.row], self.features), slope.sum())


def risk(zp: np.ndarray, zu: np.ndarray, prior: float) -> tuple[float, float]:
    """The two parts of the corrected logistic risk: prior * R+(pos), and R-(unl) - prior * R-(pos), which must not go below zero."""
    return prior * float(np.logaddexp(0, -zp).mean()), float(np.logaddexp(0, zu).mean()) - prior * float(np.logaddexp(0, zp).mean())


def nnpu(pos: Bags, unl: Bags, prior: float, steps: int = 600, rate: float = 0.1, decay: float = 1e-5) -> tuple[np.ndarray, float]:
    """Weights and bias of the logistic loss's non-negative PU risk; weights are kept from going below zero, for a telling word only raises
    the odds."""
    w, b = np.zeros(pos.features), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(pos.features + 1), np.zeros(pos.features + 1)
    for t in range(1, steps + 1):
        zp, zu = pos.logits(w, b), unl.logits(w, b)
        sp, su = 1 / (1 + np.exp(-zp)), 1 / (1 + np.exp(-zu))
        # logistic losses: l(z, +1) = log(1 + e^-z), slope s - 1; l(z, -1) = log(1 + e^z), slope s
        kept = unl.gradient(su / unl.n) - pos.gradient(prior * sp / pos.n)
        if risk(zp, zu, prior)[1] >= 0:
            g = pos.gradient(prior * (sp - 1) / pos.n) + kept
        else:  # the corrected part has gone below zero: step back along it
            g = -kept
        g[:-1] += decay * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        w, b = np.maximum(0.0, w - step[:-1]), b - float(step[-1])
    return w, b


def tail(p: np.ndarray, n: int, rate: np.ndarray) -> np.ndarray:
    """The probability of p or more hits in n draws at a rate under p / n: its terms fall from the first on."""
    logs = np.concatenate(([0.0], np.cumsum(np.log(np.arange(1, n + 1)))))
    term = np.exp(logs[n] - logs[p] - logs[n - p] + p * np.log(rate) + (n - p) * np.log1p(-rate))
    total, j = np.zeros(len(p)), p.astype(np.float64)
    while (term > 1e-12 * (total + 1e-300)).any():
        total += term
        term = term * (n - j) / (j + 1) * rate / (1 - rate)
        j += 1
    return total


def telling(p: np.ndarray, u: np.ndarray, positives: int, unlabelled: int, words: int) -> np.ndarray:
    """Which words are telling, those of the least chance first; p, u: how many texts of either set hold each; words: of all positives."""
    rate = (u + 1) / (unlabelled + 2)
    more = np.flatnonzero(p / positives > rate)
    chance = tail(p[more], positives, rate[more])
    good = chance < 1 / max(1, words)
    return more[good][np.lexsort((more[good], chance[good], -(p / rate)[more[good]] * (chance[good] == 0)))]


def class_prior(pos: list[list[int]], unl: list[list[int]], words: int) -> float:
    """An upper bound of U(S_k) / P(S_k) at the largest set S_k of the k first words where it may still be the least; texts are sets of word
    numbers.  Bounds are one standard error away: too low a prior would teach that telling words don't tell."""
    def holding(texts: list[list[int]]) -> np.ndarray:
        first = np.array([min(t) for t in texts if t], np.int64)
        return np.cumsum(np.bincount(first, minlength=words))

    p, u = holding(pos), holding(unl) + 1
    u, p = u[p > 0], p[p > 0]
    if not len(p):
        return MOST_PRIOR
    ratio, error = (u / (len(unl) + 2)) / (p / len(pos)), np.sqrt(1 / u + 1 / p)
    upper = ratio * (1 + error)
    return float(min(MOST_PRIOR, upper[np.flatnonzero(ratio * (1 - error) <= upper.min())[-1]]))


def fit(docs: DataFrame, labels: DataFrame, most_positive: int = MOST_POSITIVE, most_unlabelled: int = MOST_UNLABELLED) -> Model:
    """Train on confirmed rows of docs and a sample of all its rows, none of them held out.  Sampled ids are broadcast: at most both bounds."""
    confirmed = labels.where((F.col("toxic") == 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id").distinct()
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    confirmed = confirmed.orderBy(*order).limit(most_positive)
    sample = docs.select("doc_id").where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).orderBy(*order).limit(most_unlabelled).distinct()
    chosen = confirmed.select("doc_id", F.lit(1).alias("p"), F.lit(0).alias("u")).unionAll(sample.select("doc_id", F.lit(0).alias("p"), F.lit(1).alias("u")))
    chosen = chosen.groupBy("doc_id").agg(F.max("p").alias("p"), F.max("u").alias("u"))
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "p", "u")

    def featurised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            words = ["\n".join(sorted(words_of(t))) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_pydict({"words": pa.array(words, pa.string()), "p": b.column(1), "u": b.column(2)})

    spark = docs.sparkSession
    own = Scratch(spark, "toxicity")
    bags = rows.mapInArrow(featurised, "words string, p int, u int").groupBy("words").agg(F.max("p").alias("p"), F.max("u").alias("u"))
    bags = own.write(bags, "bags")
    positives, unlabelled = bags.agg(F.sum("p"), F.sum("u")).first()
    if not positives:
        own.keep()
        return Model({}, None)
    counts = bags.select(F.explode(F.split("words", "\n")).alias("word"), "p", "u").where("word <> ''").groupBy("word").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
    counts = own.write(counts.where("p > 0"), "counts")
    table = counts.where(F.col("p") >= LEAST_DOCS).orderBy("word").toArrow()  # words of the bounded sample of positives
    best = telling(table["p"].to_numpy(), table["u"].to_numpy(), positives, unlabelled, counts.count())
    words = table["word"].take(pa.array(best)).to_pylist()
    index = {w: i for i, w in enumerate(words)}
    shared = spark.sparkContext.broadcast(index)

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in batches:
            found = [sorted({own[w] for w in t.split("\n") if w in own}) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_pydict({"f": pa.array(found, pa.list_(pa.int32())), "p": b.column(1), "u": b.column(2)})

    table = bags.mapInArrow(indexed, "f array<int>, p int, u int").toArrow()
    own.keep()
    texts = sorted(zip(table["f"].to_pylist(), table["p"].to_pylist(), table["u"].to_pylist(), strict=True))  # sums don't depend on the rows' order
    pos, unl = [f for f, p, _ in texts if p], [f for f, _, u in texts if u]
    prior = class_prior(pos, unl, len(words))
    if not words or not unl:
        return Model({}, float(np.log(prior / (1 - prior))))
    w, bias = nnpu(Bags(pos, len(words)), Bags(unl, len(words)), prior)
    return Model(dict(zip(words, map(float, w), strict=True)), bias)


def _scored(docs: DataFrame, model: Model, keep: bool) -> DataFrame:
    names, at = docs.columns, docs.columns.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in slices(batches):
            scores = np.array([own.score(t) for t in b.column(at).to_pylist()])
            if keep:
                yield b.filter(pa.array(scores < THRESHOLD))
            else:
                yield pa.RecordBatch.from_arrays([b.column(names.index("doc_id")), pa.array(scores)], names=["doc_id", "score"])

    return docs.mapInArrow(run, docs.schema if keep else f"doc_id {dict(docs.dtypes)['doc_id']}, score double")


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    docs = docs.select("doc_id", "text")
    out = _scored(docs, fit(docs, labels), keep=False)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those that score THRESHOLD or more."""
    return _scored(docs, fit(docs, labels), keep=True)
