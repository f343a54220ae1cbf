"""Histograms and distributions as tables (x, p) or (x, p, F), and what is computed from them."""

from __future__ import annotations

import math
from functools import reduce
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.scalars import at_least_one_of
from tessera.operators.storage import previous, running, running_sum

#: Points of a CDF that `interpolate` broadcasts.
MOST_POINTS = 1_000_000


def histogram(df: DataFrame, x: str, weight: str | None = None) -> DataFrame:
    """x, n: counts, or sums of weights."""
    return df.where(F.col(x).isNotNull()).groupBy(F.col(x).alias("x")).agg((F.sum(weight) if weight else F.count("*")).alias("n"))


def normalise(hist: DataFrame, n: str = "n") -> DataFrame:
    """x, p: shares of the total."""
    total = hist.agg(F.sum(n).alias("_t"))
    return hist.join(F.broadcast(total)).select("x", (F.col(n) / F.col("_t")).alias("p"))


def cleaned(hist: DataFrame, keep: str) -> DataFrame:
    return hist.where(keep)


def equal(one: DataFrame, two: DataFrame, tolerance: float = 1e-10) -> bool:
    gap = one.select("x", F.col("p").alias("a")).join(two.select("x", F.col("p").alias("b")), "x", "full").where(F.abs(F.coalesce("a", F.lit(0.0)) - F.coalesce("b", F.lit(0.0))) > tolerance)
    return gap.isEmpty()


def with_cdf(pmf: DataFrame) -> DataFrame:
    """x, p, F."""
    return running(pmf.select("x", "p"), "x", "p", "F")


def ecdf(df: DataFrame, x: str) -> DataFrame:
    """x, F of a sample: its histogram comes first; the running sum over distinct values is dealt by range (there may be very many), and
    counts are summed before they are divided."""
    h = histogram(df, x)
    summed = running_sum(h, "x", "n", "_n")
    total = h.agg(F.sum("n").alias("_t"))
    return summed.select("x", "_n").join(F.broadcast(total)).select("x", (F.col("_n") / F.col("_t")).alias("F"))


def moments(pmf: DataFrame) -> DataFrame:
    """mean, sd."""
    m = F.sum(F.col("x") * F.col("p")) / F.sum("p")
    return pmf.agg(m.alias("mean"), F.sqrt(F.greatest(F.lit(0.0), F.sum(F.col("x") * F.col("x") * F.col("p")) / F.sum("p") - m * m)).alias("sd"))


def inverse_step(cdf: DataFrame, targets: list[float]) -> DataFrame:
    """t, x: the least x whose F is t or more (the greatest x beyond).  One aggregation for all targets."""
    top = F.max("x")
    found = [F.struct(F.lit(float(t)).alias("t"), F.coalesce(F.min(F.when(F.col("F") >= t - 1e-12, F.col("x"))), top).alias("x")) for t in targets]
    return cdf.agg(F.array(*found).alias("found")).select(F.inline("found"))


def inverse_linear(cdf: DataFrame, targets: list[float]) -> DataFrame:
    """t, x: linear between neighbouring points of the CDF, its ends outside.  One aggregation for all targets."""
    point = F.struct(F.col("x").cast("double").alias("x"), "F")

    def at(t: float) -> Column:
        return F.struct(F.lit(float(t)).alias("t"), F.max(F.when(F.col("F") < t, point)).alias("a"), F.min(F.when(F.col("F") >= t, point)).alias("b"))

    ends = cdf.agg(F.array(*[at(t) for t in targets]).alias("found")).select(F.inline("found"))
    x0, f0, x1, f1 = F.col("a.x"), F.col("a.F"), F.col("b.x"), F.col("b.F")
    return ends.select("t", F.when(F.col("a").isNull(), x1).when(F.col("b").isNull(), x0).otherwise(x0 + (F.col("t") - f0) * (x1 - x0) / (f1 - f0)).alias("x"))


def interpolate(cdf: DataFrame, n: int) -> DataFrame:
    """x, F at n equally spaced places from the least x to the greatest."""
    lo, hi, size = cdf.agg(F.min("x"), F.max("x"), F.count("*")).first()
    if size > MOST_POINTS:
        raise ValueError(f"a CDF of {size} points; up to {MOST_POINTS} are broadcast: take a histogram of it first")
    grid = cdf.sparkSession.range(n).select((F.lit(float(lo)) + F.col("id") * ((float(hi) - float(lo)) / max(1, n - 1))).alias("g"))
    w = Window.orderBy("x")
    seg = cdf.select("x", "F", F.coalesce(F.lead("x").over(w), F.col("x")).alias("x1"), F.coalesce(F.lead("F").over(w), F.col("F")).alias("f1"), F.lead("x").over(w).isNull().alias("last"))
    met = grid.join(F.broadcast(seg), (F.col("g") >= F.col("x")) & ((F.col("g") < F.col("x1")) | F.col("last")))
    f = F.when(F.col("last") | (F.col("x1") == F.col("x")), F.col("F")).otherwise(F.col("F") + (F.col("g") - F.col("x")) * (F.col("f1") - F.col("F")) / (F.col("x1") - F.col("x")))
    return met.select(F.col("g").alias("x"), f.alias("F"))


def conditional(pmf: DataFrame, predicate: str) -> DataFrame:
    """x, p of the part where predicate (over x, p, F) holds."""
    return normalise(with_cdf(pmf).where(predicate), "p")


def convolve(one: DataFrame, two: DataFrame) -> DataFrame:
    """The distribution of the sum; both are distributions of whole numbers, small by nature, the second is broadcast."""
    b = two.select(F.col("x").alias("y"), F.col("p").alias("q"))
    return one.join(F.broadcast(b)).groupBy((F.col("x") + F.col("y")).alias("x")).agg(F.sum(F.col("p") * F.col("q")).alias("p"))


def convolve_rows(one: dict[int, float], two: dict[int, float]) -> dict[int, float]:
    out: dict[int, float] = {}
    for x, p in one.items():
        for y, q in two.items():
            out[x + y] = out.get(x + y, 0.0) + p * q
    return out


def pair_distances(symbols: DataFrame, background: DataFrame | None = None) -> DataFrame:
    """symbols (a, b, dist), background (symbol, p) or uniform -> x, p of the distance of two random symbols."""
    if background is None:
        return normalise(histogram(symbols, "dist"))
    one, two = background.select(F.col("symbol").alias("a"), F.col("p").alias("pa")), background.select(F.col("symbol").alias("b"), F.col("p").alias("pb"))
    met = symbols.join(F.broadcast(one), "a").join(F.broadcast(two), "b")
    return normalise(met.groupBy(F.col("dist").alias("x")).agg(F.sum(F.col("pa") * F.col("pb")).alias("n")))


def kmer_distances(one: DataFrame, k: int) -> DataFrame:
    """The distance of two random words of k: k-fold convolution by doubling, on the driver; the table has at most k * (range + 1) rows."""
    base = {int(r["x"]): float(r["p"]) for r in one.collect()}
    out: dict[int, float] | None = None
    n = k
    while n:
        if n & 1:
            out = base if out is None else convolve_rows(out, base)
        n >>= 1
        if n:
            base = convolve_rows(base, base)
    return one.sparkSession.createDataFrame(sorted(out.items()), "x long, p double")


def minimum_of(pmf: DataFrame, n: int) -> DataFrame:
    """x, p, F of the least of n draws: 1 - (1 - F)^n without cancellation."""
    f = with_cdf(pmf).select("x", at_least_one_of(F.least(F.col("F"), F.lit(1.0)), n).alias("F"))
    return _from_cdf(f)


def maximum_of(pmf: DataFrame, n: int) -> DataFrame:
    f = with_cdf(pmf).select("x", F.pow(F.least(F.col("F"), F.lit(1.0)), n).alias("F"))
    return _from_cdf(f)


def _from_cdf(cdf: DataFrame) -> DataFrame:
    f = F.when(F.isnan("F") | F.col("F").isNull(), 1.0).otherwise(F.col("F"))
    rows = previous(cdf.select("x", f.alias("F")), "x", "F", "_f")
    return rows.select("x", (F.col("F") - F.coalesce("_f", F.lit(0.0))).alias("p"), "F")


def fragment_average(one: DataFrame, k: int, query_kmers: int, fragment: int) -> DataFrame:
    """Of a Hausdorff-average distance of fragments: word distances, the least over query_kmers, the mean of `fragment` of those, the greater of
    two sides."""
    least = minimum_of(kmer_distances(one, k), query_kmers).select("x", "p").where("p > 0")
    total = kmer_distances(least, fragment)
    mean = total.select((F.col("x") / fragment).alias("x"), "p")
    return maximum_of(mean, 2)


def threshold_for(cdf: DataFrame, p_value: float) -> float:
    """The least x with F(x) >= p_value."""
    return inverse_step(cdf, [p_value]).first()["x"]


def p_value_for(cdf: DataFrame, threshold: float) -> float:
    return cdf.where(F.col("x") <= threshold).agg(F.coalesce(F.max("F"), F.lit(0.0))).first()[0]


def quantile_table(model: DataFrame, sample: DataFrame) -> DataFrame:
    """Q-Q at eleven fixed shares: share, model, sample."""
    shares = [0.01, 0.05, 0.1, 0.25, 0.4, 0.5, 0.6, 0.75, 0.9, 0.95, 0.99]
    one, two = inverse_linear(model, shares).withColumnRenamed("x", "model"), inverse_linear(sample, shares).withColumnRenamed("x", "sample")
    return one.join(two, "t").select(F.col("t").alias("share"), "model", "sample")


def goodness_of_fit(model: DataFrame, sample: DataFrame) -> DataFrame:
    """greatest (of |F_model - F_sample| at the sample's places) and mean_square."""
    both = sample.select("x", F.col("F").alias("s")).join(model.select("x", F.col("F").alias("m")), "x", "full")
    filled = running(both, "x", "m", "so_far", "max").select("s", F.coalesce("so_far", F.lit(0.0)).alias("m")).where("s is not null")  # a CDF doesn't fall
    return filled.agg(F.max(F.abs(F.col("s") - F.col("m"))).alias("greatest"), F.avg(F.pow(F.col("s") - F.col("m"), 2)).alias("mean_square"))


# normal and Weibull


def normal_cdf(t: float, mu: float, sigma: float) -> float:
    return (1 + math.erf((t - mu) / (sigma * math.sqrt(2)))) / 2


def normal_pdf(t: float, mu: float, sigma: float) -> float:
    return math.exp(-(((t - mu) / sigma) ** 2) / 2) / (sigma * math.sqrt(2 * math.pi))


def normal_inverse(p: float, mu: float = 0.0, sigma: float = 1.0) -> float:
    return NormalDist(mu, sigma).inv_cdf(p)


def weibull_fit(cdf: DataFrame) -> DataFrame:
    """shape, scale by least squares of ln(-ln(1 - F)) on ln x, where x > 0 and 0.01 <= F <= 0.99."""
    rows = cdf.where("x > 0 and F >= 0.01 and F <= 0.99").select(F.log("x").alias("u"), F.log(-F.log(1 - F.col("F"))).alias("v"))
    a, b = F.regr_slope("v", "u"), F.regr_intercept("v", "u")
    return rows.agg(a.alias("shape"), F.exp(-b / a).alias("scale"))


def weibull_cdf(x: float, shape: float, scale: float) -> float:
    return 0.0 if x <= 0 else -math.expm1(-((x / scale) ** shape))


def weibull_pdf(x: float, shape: float, scale: float) -> float:
    return 0.0 if x <= 0 else shape / scale * (x / scale) ** (shape - 1) * math.exp(-((x / scale) ** shape))


def weibull_inverse(p: float, shape: float, scale: float) -> float:
    return scale * (-math.log1p(-p)) ** (1 / shape)


def weibull_moments(shape: float, scale: float) -> tuple[float, float]:
    m = scale * math.gamma(1 + 1 / shape)
    return m, math.sqrt(max(0.0, scale**2 * math.gamma(1 + 2 / shape) - m * m))


def mean_of_minima_error(pmf: dict[int, float], n: int, m: int, steps: int = 200) -> float:
    """Greatest gap between the CDF of the mean of m minima of n draws and its normal approximation, on a grid of `steps`."""
    xs = sorted(pmf)
    acc, least, before = 0.0, {}, 0.0
    for x in xs:
        acc = min(1.0, acc + pmf[x])
        f = 1.0 if acc >= 1 else -math.expm1(n * math.log1p(-acc))
        least[x], before = f - before, f
    mean = sum(x * p for x, p in least.items())
    sd = math.sqrt(max(1e-300, sum(x * x * p for x, p in least.items()) - mean * mean))
    total = reduce(convolve_rows, [least] * m)
    lo, hi = min(total), max(total)
    worst, acc, it = 0.0, 0.0, iter(sorted(total.items()))
    nxt = next(it, None)
    for s in range(steps + 1):
        t = lo + (hi - lo) * s / steps
        while nxt and nxt[0] <= t:
            acc += nxt[1]
            nxt = next(it, None)
        worst = max(worst, abs(acc - normal_cdf(t / m, mean, sd / math.sqrt(m))))
    return worst


def fragment_statistics(distances: DataFrame) -> DataFrame:
    """distances (query_id, subject_id, qfrag, sfrag, d) -> per query fragment: self_match (least), mean, sd."""
    return distances.groupBy("query_id", "qfrag").agg(F.min("d").alias("self_match"), F.avg("d").alias("mean"), F.stddev_pop("d").alias("sd"))


def random_kmer_distances(words: DataFrame, n: int, matrix, kind: str = "blosum", seed: int = 0) -> DataFrame:
    """word, other, distance of n pairs out of 2n sampled words, paired by place in hash order."""
    import pyarrow as pa

    from tessera.operators.sampling import order_of

    drawn = words.select("word", order_of(F.concat_ws("|", *[F.col(c).cast("string") for c in words.columns]), seed).alias("h")).orderBy("h", "word").limit(2 * n)
    no = drawn.withColumn("r", F.row_number().over(Window.orderBy("h", "word")) - 1)
    pairs = no.groupBy(F.floor(F.col("r") / 2).alias("pair")).agg(F.min_by("word", "r").alias("word"), F.max_by("word", "r").alias("other"), F.count("*").alias("n")).where("n = 2")
    d = matrix.distances(kind)

    def run(batches):
        for b in batches:
            x, y = matrix.code(b.column(0).to_pylist()), matrix.code(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(d[x, y].sum(1) if len(x) else [], pa.int32())], names=["word", "other", "distance"])

    return pairs.select("word", "other").mapInArrow(run, "word string, other string, distance int")


def regression(df: DataFrame, x: str, y: str) -> DataFrame:
    """a, b of y = a x + b."""
    return df.agg(F.regr_slope(y, x).alias("a"), F.regr_intercept(y, x).alias("b"))
