"""Mathematical functions as column expressions, and spline bases and distributions where Spark has none."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shipping import ship


def logit(p: Column) -> Column:
    """ln(p / (1 - p)); null outside (0, 1)."""
    return F.when((p > 0) & (p < 1), F.log(p / (1 - p)))


def logit_inv(x: Column) -> Column:
    """exp(x) / (1 + exp(x)), without overflow on either side."""
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def lope(x: Column) -> Column:
    """ln(1 + exp(x)), without overflow."""
    return F.when(x > 0, x + F.log1p(F.exp(-x))).otherwise(F.log1p(F.exp(x)))


def multinomial_logit_inv(x: Column) -> Column:
    """The probabilities of an array of logits against a first category of logit 0, that category first."""
    all_ = F.concat(F.array(F.lit(0.0)), x)
    weights = F.transform(all_, lambda v: F.exp(v - F.array_max(all_)))
    return F.transform(weights, lambda v: v / F.aggregate(weights, F.lit(0.0), lambda a, b: a + b))


def multinomial_logit(p: Column) -> Column:
    """Logits of an array of probabilities against its first."""
    return F.transform(F.slice(p, F.lit(2), F.size(p) - 1), lambda v: F.log(v / F.get(p, F.lit(0))))


def log_sum_exp(df: DataFrame, x: str, by: Sequence[str] = (), name: str = "lse") -> DataFrame:
    """ln(sum(exp(x))) of each group; the greatest value is taken out first, so nothing overflows."""
    top = df.groupBy(*by).agg(F.max(x).alias("_m"))
    rows = df.join(top, [*by]) if by else df.crossJoin(F.broadcast(top))  # one row
    return rows.groupBy(*by).agg((F.first("_m") + F.log(F.sum(F.exp(F.col(x) - F.col("_m"))))).alias(name))


def normalize(df: DataFrame, x: str, by: Sequence[str], name: str = "p", logs: bool = False) -> DataFrame:
    """Each value's share of its group's sum; logs: of exp(x)."""
    w = Window.partitionBy(*by)
    v = F.exp(F.col(x) - F.max(x).over(w)) if logs else F.col(x)
    return df.withColumn("_v", v).withColumn(name, F.col("_v") / F.sum("_v").over(w)).drop("_v")


#: Lanczos coefficients of the log gamma function, g = 7.
_LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)


def lgamma(x: Column) -> Column:
    """ln(gamma(x)) of positive numbers, to about 15 digits; stays in the JVM."""
    z = x - 1
    series = F.lit(_LANCZOS[0])
    for k, c in enumerate(_LANCZOS[1:], 1):
        series = series + c / (z + k)
    t = z + 7.5
    return F.lit(0.5 * math.log(2 * math.pi)) + (z + 0.5) * F.log(t) - t + F.log(series)


def log_multivariate_gamma(x: Column, dim: int) -> Column:
    out = F.lit(dim * (dim - 1) / 4 * math.log(math.pi))
    for k in range(dim):
        out = out + lgamma(x - k / 2)
    return out


def log_density(kind: str, x: Column, *p: Column | float) -> Column:
    """ln of a density or probability at x. kind and p: normal (mean, sd), gamma (shape, rate), beta (a, b), exponential
    (rate), poisson (mean), binomial (n, prob), negative_binomial (size, prob), student (df), chi_square (df),
    cauchy (centre, scale), logistic (centre, scale), weibull (shape, scale), uniform (low, high)."""
    q = [c if isinstance(c, Column) else F.lit(float(c)) for c in p]
    beta = lambda a, b: lgamma(a) + lgamma(b) - lgamma(a + b)
    if kind == "normal":
        return -0.5 * F.pow((x - q[0]) / q[1], 2.0) - F.log(q[1]) - 0.5 * math.log(2 * math.pi)
    if kind == "gamma":
        return q[0] * F.log(q[1]) - lgamma(q[0]) + (q[0] - 1) * F.log(x) - q[1] * x
    if kind == "beta":
        return (q[0] - 1) * F.log(x) + (q[1] - 1) * F.log1p(-x) - beta(q[0], q[1])
    if kind == "exponential":
        return F.log(q[0]) - q[0] * x
    if kind == "poisson":
        return x * F.log(q[0]) - q[0] - lgamma(x + 1)
    if kind == "binomial":
        return lgamma(q[0] + 1) - lgamma(x + 1) - lgamma(q[0] - x + 1) + x * F.log(q[1]) + (q[0] - x) * F.log1p(-q[1])
    if kind == "negative_binomial":
        return lgamma(q[0] + x) - lgamma(q[0]) - lgamma(x + 1) + q[0] * F.log(q[1]) + x * F.log1p(-q[1])
    if kind == "student":
        return lgamma((q[0] + 1) / 2) - lgamma(q[0] / 2) - 0.5 * F.log(q[0] * math.pi) - (q[0] + 1) / 2 * F.log1p(x * x / q[0])
    if kind == "chi_square":
        return log_density("gamma", x, q[0] / 2, F.lit(0.5))
    if kind == "cauchy":
        return -F.log(q[1] * math.pi) - F.log1p(F.pow((x - q[0]) / q[1], 2.0))
    if kind == "logistic":
        z = (x - q[0]) / q[1]
        return -z - F.log(q[1]) - 2 * lope(-z)
    if kind == "weibull":
        return F.log(q[0] / q[1]) + (q[0] - 1) * F.log(x / q[1]) - F.pow(x / q[1], q[0])
    if kind == "uniform":
        return F.when((x >= q[0]) & (x <= q[1]), -F.log(q[1] - q[0])).otherwise(F.lit(float("-inf")))
    raise ValueError(f"no distribution named {kind}")


def mvn_log_density(x: Column, mean: Sequence[float], covariance: Sequence[Sequence[float]], df: float | None = None) -> Column:
    """ln of the multivariate normal density of an array, or of the multivariate Student one with df degrees of freedom (then
    `covariance` is its scale matrix). NULL where the array isn't as long as the mean or holds a NULL."""
    d, low = len(mean), np.linalg.cholesky(np.asarray(covariance, dtype=float))
    whiten = F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in np.linalg.inv(low)])
    off = F.zip_with(x.cast("array<double>"), F.array(*[F.lit(float(v)) for v in mean]), lambda a, b: a - b)
    along = lambda row: F.aggregate(F.zip_with(row, off, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    square = F.aggregate(F.transform(whiten, along), F.lit(0.0), lambda s, v: s + v * v)
    log_root = float(np.log(np.diag(low)).sum())
    if df is None:
        return -0.5 * square - (log_root + 0.5 * d * math.log(2 * math.pi))
    return F.lit(math.lgamma((df + d) / 2) - math.lgamma(df / 2) - 0.5 * d * math.log(df * math.pi) - log_root) - (df + d) / 2 * F.log1p(square / df)


def _tail_coefficients(degree: int = 24) -> list[float]:
    """Of a polynomial in 2 t - 1, t = 2 / (2 + z), for ln(erfc(z) / t) + z * z: fitted at Chebyshev's points of z from 0 on."""

    def target(u: float) -> float:
        t = max((u + 1) / 2, 1e-9)
        z = 2 / t - 2
        if z < 20:
            return math.log(math.erfc(z) / t) + z * z
        r = 1 / (2 * z * z)
        return math.log((1 - r + 3 * r**2 - 15 * r**3 + 105 * r**4 - 945 * r**5) / (z * math.sqrt(math.pi) * t))

    fitted = np.polynomial.chebyshev.chebinterpolate(np.vectorize(target), degree)
    return [float(c) for c in np.polynomial.chebyshev.cheb2poly(fitted)]


_TAIL = _tail_coefficients()


def normal_cdf(x: Column, mean: float = 0.0, sd: float = 1.0) -> Column:
    """The normal distribution function, to some 12 digits on either tail; stays in the JVM."""
    z = F.abs((x.cast("double") - mean) / sd) / math.sqrt(2.0)
    t = 2 / (2 + z)
    u = 2 * t - 1
    p = F.lit(_TAIL[-1])
    for c in reversed(_TAIL[:-1]):
        p = p * u + c
    half = 0.5 * t * F.exp(p - z * z)
    return F.when(x.cast("double") < mean, half).otherwise(1 - half)


def normal_density(x: Column) -> Column:
    return F.exp(-0.5 * x * x) * 0.3989422804014327


def bspline_basis(x: np.ndarray, knots: Sequence[float], degree: int = 3) -> np.ndarray:
    """A row of len(knots) - 1 + degree basis functions for each x; knots ascend, the ends are repeated. 0 outside them."""
    t = np.concatenate([[knots[0]] * degree, knots, [knots[-1]] * degree]).astype(float)
    n = len(t) - 1
    out = np.zeros((len(x), n))
    last = len(knots) + degree - 2  # the last interval that isn't empty, which takes its right end too
    for k in range(degree, last + 1):
        out[:, k] = (x >= t[k]) & ((x < t[k + 1]) | (k == last) & (x <= t[k + 1]))
    for d in range(1, degree + 1):
        for k in range(n - d):
            left = (x - t[k]) / (t[k + d] - t[k]) * out[:, k] if t[k + d] > t[k] else 0.0
            right = (t[k + d + 1] - x) / (t[k + d + 1] - t[k + 1]) * out[:, k + 1] if t[k + d + 1] > t[k + 1] else 0.0
            out[:, k] = left + right
    return out[:, : n - degree]


def mspline_basis(x: np.ndarray, knots: Sequence[float], degree: int = 3) -> np.ndarray:
    """As `bspline_basis`, scaled so that each function has an area of one."""
    t = np.concatenate([[knots[0]] * degree, knots, [knots[-1]] * degree]).astype(float)
    n = len(knots) - 1 + degree
    return bspline_basis(x, knots, degree) * (degree + 1) / (t[degree + 1 : degree + 1 + n] - t[:n])


def ispline_basis(x: np.ndarray, knots: Sequence[float], degree: int = 3) -> np.ndarray:
    """The integrals of `mspline_basis` up to x: they rise from 0 at the first knot to 1 at the last, and stay there."""
    higher = bspline_basis(np.clip(x, knots[0], knots[-1]), knots, degree + 1)
    return np.cumsum(higher[:, ::-1], axis=1)[:, ::-1][:, 1:]


def natural_spline(x: Column, knots: Sequence[float]) -> Column:
    """An array of len(knots) - 1 functions that, with a constant, span the cubic splines that are straight beyond the outer
    knots: x, then for each knot but the last two a difference of truncated cubes. Plain arithmetic in the JVM."""
    cube = lambda k: F.pow(F.greatest(x - float(k), F.lit(0.0)), F.lit(3.0))
    part = lambda k: (cube(k) - cube(knots[-1])) / float(knots[-1] - k)
    return F.when(x.isNotNull(), F.array(x.cast("double"), *[part(k) - part(knots[-2]) for k in knots[:-2]]))


def bspline(df: DataFrame, x: str, knots: Sequence[float], degree: int = 3, name: str = "basis", functions=bspline_basis) -> DataFrame:
    """df with the B-spline basis of x as an array (or that of the `functions` given: M- or I-splines); null where x is."""
    ship(df.sparkSession)

    @F.pandas_udf("array<double>")
    def basis(v: pd.Series) -> pd.Series:
        rows = functions(v.to_numpy(dtype=float, na_value=np.nan), knots, degree)
        return pd.Series([None if m else r for r, m in zip(rows, v.isna(), strict=True)])

    return df.withColumn(name, basis(F.col(x).cast("double")))
