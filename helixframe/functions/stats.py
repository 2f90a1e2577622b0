"""Special functions and tests, as plain functions over arrays and as vectorised column functions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

_TINY = 1e-300


def log_gamma(x: float) -> float:
    return math.lgamma(x)


def erfc(x: float) -> float:
    return math.erfc(x)


def gamma_p(s: float, x: float) -> float:
    """Regularised lower incomplete gamma function: the series below s + 1, else the continued fraction."""
    if x <= 0:
        return 0.0
    if x > s + 1:
        return 1.0 - gamma_q(s, x)
    term = total = 1.0 / s
    n = s
    while abs(term) > abs(total) * 1e-16:
        n += 1
        term *= x / n
        total += term
    return total * math.exp(-x + s * math.log(x) - math.lgamma(s))


def gamma_q(s: float, x: float) -> float:
    """Regularised upper incomplete gamma function."""
    if x <= s + 1:
        return 1.0 - gamma_p(s, x)
    b = x + 1 - s
    c, d = 1 / _TINY, 1 / b
    h = d
    for i in range(1, 1000):
        a = -i * (i - s)
        b += 2
        d = 1 / (a * d + b or _TINY)
        c = b + a / c or _TINY
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return math.exp(-x + s * math.log(x) - math.lgamma(s)) * h


def beta_i(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1.0 - beta_i(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d or _TINY)
    h = d
    for m in range(1, 1000):
        for n in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + n * d or _TINY)
            c = 1 + n / c or _TINY
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def log_binomial(n: int, k: int) -> float:
    return 0.0 if k in (0, n) else math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)


def hypergeometric(n11: int, row: int, column: int, n: int) -> float:
    """Probability of ``n11`` in a table of these margins."""
    return math.exp(log_binomial(row, n11) + log_binomial(n - row, column - n11) - log_binomial(n, column))


def fisher(n11: int, n12: int, n21: int, n22: int) -> tuple[float, float, float]:
    """Left, right and two-tailed p of a two-by-two table."""
    row, column, n = n11 + n12, n11 + n21, n11 + n12 + n21 + n22
    low, high = max(0, row + column - n), min(row, column)
    if low == high:
        return 1.0, 1.0, 1.0
    p = np.array([hypergeometric(i, row, column, n) for i in range(low, high + 1)])
    own = p[n11 - low]
    left, right = p[: n11 - low + 1].sum(), p[n11 - low :].sum()
    two = p[p <= own * (1 + 1e-8)].sum()
    return min(left, 1.0), min(right, 1.0), min(two, 1.0)


def fisher_exact(n11, n12, n21, n22):
    """``struct<left, right, two>`` of four columns; null if one is null."""

    @F.pandas_udf("left double, right double, two double")
    def run(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.DataFrame:
        rows = [(None,) * 3 if pd.isna([w, x, y, z]).any() else fisher(int(w), int(x), int(y), int(z)) for w, x, y, z in zip(a, b, c, d)]
        return pd.DataFrame(rows, columns=["left", "right", "two"], dtype=float)

    return run(n11, n12, n21, n22)


def special(name: str, *columns):
    """One of the functions here over columns of doubles."""
    of = {"log_gamma": log_gamma, "erfc": erfc, "gamma_p": gamma_p, "gamma_q": gamma_q, "beta_i": beta_i}[name]

    @F.pandas_udf("double")
    def one(a: pd.Series) -> pd.Series:
        return a.map(of, na_action="ignore").astype(float)

    @F.pandas_udf("double")
    def two(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(x) or pd.isna(y) else of(x, y) for x, y in zip(a, b)], index=a.index, dtype=float)

    @F.pandas_udf("double")
    def three(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna([x, y, z]).any() else of(x, y, z) for x, y, z in zip(a, b, c)], index=a.index, dtype=float)

    return (one, two, three)[len(columns) - 1](*columns)


class ErrorModel:
    """Genotype likelihoods under dependent errors.

    The k-th error of a kind and strand at one site counts for less: its log-likelihood is scaled by
    ``(1 - eta) * dependence ** k + eta``. Depth is capped, for which bases are taken in a fixed order.
    """

    def __init__(self, dependence: float = 0.83, eta: float = 0.03, depth: int = 255):
        self.depth = depth
        self.fall = (1 - eta) * dependence ** np.arange(depth + 1) + eta

    def likelihoods(self, bases: np.ndarray, quals: np.ndarray, reverse: np.ndarray, alleles: int = 4) -> np.ndarray:
        """``alleles`` by ``alleles`` matrix of -10 log10 likelihoods; qualities are clamped to 4..63, best first."""
        order = np.lexsort((reverse, bases, -quals))[: self.depth]
        b, q, s = bases[order], np.clip(quals[order], 4, 63), reverse[order].astype(int)
        seen: dict[tuple[int, int], int] = {}
        weight = np.zeros(len(b))
        for i, key in enumerate(zip(b.tolist(), s.tolist())):
            weight[i] = self.fall[seen.get(key, 0)]
            seen[key] = seen.get(key, 0) + 1
        cost = q * weight
        out = np.zeros((alleles, alleles))
        counts = np.bincount(b, minlength=alleles)[:alleles]
        for i in range(alleles):
            for j in range(i, alleles):
                wrong = cost[(b != i) & (b != j)].sum()
                halves = 10 * math.log10(2) * (counts[i] + counts[j]) if i != j else 0.0  # either allele is read half the time
                out[i, j] = out[j, i] = wrong + halves
        return out


def site_likelihoods(piled, key: list[str], model: ErrorModel | None = None):
    """``key..., gl`` (16 numbers) for each site of a pileup with ``base``, ``qual`` and ``reverse``; a site's reads are capped before they are gathered."""
    from pyspark.sql import Window

    model = model or ErrorModel()
    w = Window.partitionBy(*key).orderBy(F.desc("qual"), "base", "reverse")
    few = piled.where(F.col("base").isin("A", "C", "G", "T")).withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= model.depth)
    sites = few.groupBy(*key).agg(F.collect_list(F.struct(F.instr(F.lit("ACGT"), F.col("base")).alias("b"), F.col("qual").alias("q"), F.col("reverse").alias("r"))).alias("seen"))

    @F.pandas_udf("array<double>")
    def run(seen: pd.Series) -> pd.Series:
        return pd.Series([model.likelihoods(np.array([x["b"] for x in s]) - 1, np.array([x["q"] for x in s]), np.array([bool(x["r"]) for x in s])).reshape(-1).tolist() for s in seen], index=seen.index)

    return sites.select(*key, run("seen").alias("gl"))
