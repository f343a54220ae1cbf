"""One-dimensional Gaussian mixtures by EM on the exact histogram of a sample.

Up to `VALUES` distinct values are fitted on the driver; of more, each step's sums are taken where the values are and a row for each partition
reaches the driver.  Both take the same sums."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.distributions import ecdf
from tessera.operators.sampling import number_of
from tessera.operators.storage import saved

VALUES = 200_000
FLOOR = 1e-10


@dataclass
class Mixture:
    alpha: np.ndarray
    mu: np.ndarray
    sigma: np.ndarray
    log_likelihood: float = math.nan
    n: float = 0.0

    def pdf(self, x) -> np.ndarray:
        z = (np.asarray(x, float)[..., None] - self.mu) / self.sigma
        return (self.alpha * np.exp(-z * z / 2) / (self.sigma * math.sqrt(2 * math.pi))).sum(-1)

    def cdf(self, x) -> np.ndarray:
        z = (np.asarray(x, float)[..., None] - self.mu) / (self.sigma * math.sqrt(2))
        return (self.alpha * (1 + np.vectorize(math.erf)(z)) / 2).sum(-1)

    def inverse(self, p: float) -> float:
        lo, hi = float((self.mu - 40 * self.sigma).min()), float((self.mu + 40 * self.sigma).max())
        for _ in range(200):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if self.cdf(mid) < p else (lo, mid)
        return hi

    def mean(self) -> float:
        return float(self.alpha @ self.mu)

    def sd(self) -> float:
        return math.sqrt(float(self.alpha @ (self.sigma**2 + self.mu**2)) - self.mean() ** 2)

    def aicc(self) -> float:
        """With three parameters a part."""
        k = 3 * len(self.mu)
        return 2 * k - 2 * self.log_likelihood + (2 * k * (k + 1) / (self.n - k - 1) if self.n > k + 1 else math.inf)


class Histogram:
    """Distinct values (x) and their counts (n): on the driver up to `most`, else a table in the shared folder."""

    def __init__(self, df: DataFrame, x: str, most: int = VALUES):
        rows = df.where(F.col(x).isNotNull()).groupBy(F.col(x).cast("double").alias("x")).agg(F.count("*").alias("n"))
        self.table = saved(rows, "histogram")
        self.size, self.total, mean = self.table.agg(F.count("*"), F.sum("n"), F.sum(F.col("x") * F.col("n")) / F.sum("n")).first()
        self.spread = math.sqrt(max(1e-12, self.table.agg(F.sum(F.col("n") * F.pow(F.col("x") - (mean or 0.0), 2))).first()[0] / self.total)) if self.size else 0.0
        self.arrays = None
        if self.size <= most:
            found = self.table.orderBy("x").toArrow()
            self.arrays = found["x"].to_numpy(), found["n"].to_numpy().astype(float)

    def starts(self, parts: int, seed: int) -> np.ndarray:
        """Values drawn without replacement, by their counts: those of the least -log(u) / n, u from the value's hash."""
        u = (number_of("x", seed) + 0.5) / float(1 << 32)
        found = [r["x"] for r in self.table.orderBy(-F.log(u) / F.col("n"), "x").limit(parts).collect()]
        return np.resize(np.array(found, float), parts)

    def sums(self, m: Mixture) -> np.ndarray:
        """By part, of the responsibilities: their sum, and those of them times the distance, and its square, to the part's mean; and a row of
        the log-likelihood."""

        def of(x: np.ndarray, n: np.ndarray) -> np.ndarray:
            d = x[:, None] - m.mu
            r = np.maximum(FLOOR, m.alpha * np.exp(-((d / m.sigma) ** 2) / 2) / m.sigma)
            r *= (n / r.sum(1))[:, None]
            seen = (n * np.log(np.maximum(1e-300, m.pdf(x)))).sum()
            return np.stack([r.sum(0), (r * d).sum(0), (r * d * d).sum(0), np.full(len(m.mu), seen)])

        if self.arrays is not None:
            return of(*self.arrays)

        def run(batches):
            total = np.zeros((4, len(m.mu)))
            for b in batches:
                total += of(b.column(0).to_numpy(), b.column(1).to_numpy().astype(float))
            yield pa.RecordBatch.from_pydict({"s": pa.array([total.ravel().tolist()], pa.list_(pa.float64()))})

        rows = self.table.select("x", "n").mapInArrow(run, "s array<double>").collect()
        return np.sum([r["s"] for r in rows], axis=0).reshape(4, -1)


def fit(h: Histogram, parts: int, seed: int = 0, epochs: int = 1000, tolerance: float = 1e-10) -> Mixture:
    """EM from random data points; responsibilities have a floor; ends when the parameters' squared step is under the tolerance."""
    m = Mixture(np.full(parts, 1 / parts), h.starts(parts, seed) + np.arange(parts) * 1e-9 * h.spread, np.full(parts, h.spread / parts))
    for _ in range(epochs):
        w, first, second, _ = h.sums(m)
        mu, sigma = m.mu + first / w, np.sqrt(np.maximum(1e-12, second / w - (first / w) ** 2))
        alpha = w / h.total
        step = ((alpha - m.alpha) ** 2).sum() + ((mu - m.mu) ** 2).sum() + ((sigma - m.sigma) ** 2).sum()
        m = Mixture(alpha, mu, sigma)
        if step < tolerance:
            break
    order = np.argsort(m.mu)
    m = Mixture(m.alpha[order], m.mu[order], m.sigma[order])
    m.log_likelihood, m.n = float(h.sums(m)[3, 0]), float(h.total)
    return m


def sweep(df: DataFrame, x: str, most: int = 10, seed: int = 0) -> list[Mixture]:
    """Mixtures of 1 to `most` parts."""
    h = Histogram(df, x)
    return [fit(h, k, seed) for k in range(1, most + 1)] if h.size else []


def model_table(df: DataFrame, models: list[Mixture]) -> DataFrame:
    """model, aicc, alpha, mu, sigma."""
    rows = [(k + 1, m.aicc(), float(a), float(u), float(s)) for k, m in enumerate(models) for a, u, s in zip(m.alpha, m.mu, m.sigma, strict=True)]
    return df.sparkSession.createDataFrame(rows, "model int, aicc double, alpha double, mu double, sigma double")


def curves(df: DataFrame, x: str, models: list[Mixture]) -> DataFrame:
    """x, F (of the sample), model, cdf, pdf at the sample's distinct values."""
    def run(batches):
        for b in batches:
            v, f = b.column(0).to_numpy(), b.column(1)
            for k, m in enumerate(models):
                yield pa.RecordBatch.from_arrays([b.column(0), f, pa.array(np.full(len(v), k + 1, np.int32)), pa.array(m.cdf(v)), pa.array(m.pdf(v))], names=["x", "F", "model", "cdf", "pdf"])

    values = ecdf(df.select(F.col(x).cast("double").alias("x")), "x").select("x", "F")
    return values.mapInArrow(run, "x double, F double, model int, cdf double, pdf double")
