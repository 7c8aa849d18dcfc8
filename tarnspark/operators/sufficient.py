"""Mergeable sufficient statistics as plain aggregates, and what is solved from them on the driver."""

from __future__ import annotations

import math
from collections.abc import Sequence
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnspark.functions.shipping import ship

from .moments import Fit, fit, grouped_moments, moments


def gaussian(x: Column, w: Column | None = None) -> list[Column]:
    if w is None:
        return [F.count(x).alias("n"), F.sum(x).alias("sum"), F.sum(x * x).alias("sum2")]
    return [F.count(x).alias("n"), F.sum(F.when(x.isNotNull(), w)).alias("sum_w"), F.sum(w * x).alias("sum"), F.sum(w * x * x).alias("sum2")]


def poisson(x: Column) -> list[Column]:
    return [F.count(x).alias("n"), F.sum(x).alias("sum")]


def gamma(x: Column) -> list[Column]:
    return [F.count(x).alias("n"), F.sum(x).alias("sum"), F.sum(F.when(x > 0, F.ln(x))).alias("sum_log")]


def beta(p: Column) -> list[Column]:
    inside = (p > 0) & (p < 1)
    return [F.count(F.when(inside, 1)).alias("n"), F.sum(F.when(inside, F.ln(p))).alias("sum_log"), F.sum(F.when(inside, F.ln(1 - p))).alias("sum_log1m")]


def uniform(x: Column) -> list[Column]:
    return [F.min(x).alias("low"), F.max(x).alias("high")]


def binomial(y: Column, n: Column) -> list[Column]:
    return [F.sum(y).alias("successes"), F.sum(n).alias("trials")]


def zero_inflated_poisson(x: Column) -> list[Column]:
    return [F.count_if(x == 0).alias("zeros"), F.count_if(x > 0).alias("positive"), F.sum(x).alias("sum")]


def ar1(y: str, by: Sequence[str], order: Sequence[str]):
    """df -> sums of y, y squared and y times its lag, over each series: lags are built before anything is summed."""

    def run(df: DataFrame) -> DataFrame:
        w = Window.partitionBy(*by).orderBy(*order)
        rows = df.select(*by, F.col(y).alias("y"), F.lag(y).over(w).alias("l"))
        return rows.groupBy(*by).agg(F.count("y").alias("n"), F.sum("y").alias("sum"), F.sum(F.col("y") * F.col("y")).alias("sum2"), F.sum(F.col("y") * F.col("l")).alias("cross"))

    return run


def gramian(df: DataFrame, columns: dict[str, Column], weight: Column | None = None) -> tuple[list[str], np.ndarray]:
    """Names and X'WX of the given columns, over rows where none is missing: centred sums put together again, see `moments`."""
    return list(columns), moments(df, list(columns.values()), weight).gramian


@contextmanager
def kept(rows: DataFrame):
    """rows, which the rounds of a fit read over and over, on the executors until the block ends; what is lost is made again."""
    held = rows.persist()
    try:
        yield held
    finally:
        held.unpersist()


def _number(x: float) -> float | None:
    return None if x != x else float(x)


def _terms(names: Sequence[str], f: Fit, k: int = 0) -> list[tuple[str, float | None, float | None, float | None]]:
    """(term, estimate, se, t) of the k-th response; terms that others give have none of them."""
    free = f.w - f.rank
    sigma2 = f.sse[k] / free if free > 0 else math.nan
    se = np.sqrt(np.maximum(0.0, np.diag(f.inverse)) * sigma2)
    return [(c, float(b), _number(s), float(b / s) if s > 0 else None) if told else (c, None, None, None) for c, b, s, told in zip(names, f.b[:, k], se, f.told, strict=True)]


def least_squares(df: DataFrame, y: str, design: dict[str, Column], weight: Column | None = None) -> DataFrame:
    """term, estimate, se, t of the regression of y on the design (which holds its own intercept).

    Solved from centred products, so columns may stand as far from zero as they like. A term that those before it give has
    NULL for an estimate. Rows that miss a value are left out."""
    f = fit(moments(df, [*design.values(), F.col(y)], weight), len(design))
    return df.sparkSession.createDataFrame(_terms(list(design), f), "term string, estimate double, se double, t double")


def lm(df: DataFrame, y: str, design: dict[str, Column], weight: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Coefficients (term, estimate, se, t, p) and the analysis of variance (source, df, ss, ms, f, p, r2, adjusted_r2) of a
    regression whose design holds an intercept of ones; one pass over the rows in all. Terms that others give: as `least_squares`."""
    m = moments(df, [*design.values(), F.col(y)], weight)
    f = fit(m, len(design))
    n, syy = m.w, float(m.s[-1, -1])
    sse, d1, d2 = min(syy, float(f.sse[0])), f.rank - 1, n - f.rank
    sigma2 = sse / d2 if d2 > 0 else float("nan")
    terms = [(*row, None if row[3] is None else student_p(row[3], float(d2))) for row in _terms(list(design), f)]
    ratio = (syy - sse) / d1 / sigma2 if d1 > 0 and d2 > 0 and sigma2 > 0 else None
    r2 = 1 - sse / syy if syy > 0 else None
    adjusted = 1 - (1 - r2) * (n - 1) / d2 if r2 is not None and d2 > 0 else None
    table = [
        ("model", float(d1), syy - sse, (syy - sse) / d1 if d1 else None, ratio, None if ratio is None else f_p(ratio, d1, float(d2)), r2, adjusted),
        ("residual", float(d2), sse, sigma2 if d2 > 0 else None, None, None, None, None),
        ("total", float(n - 1), syy, None, None, None, None, None),
    ]
    spark = df.sparkSession
    plain = [tuple(v if v is None or isinstance(v, str) else float(v) for v in r) for r in table]
    return spark.createDataFrame(terms, "term string, estimate double, se double, t double, p double"), spark.createDataFrame(plain, "source string, df double, ss double, ms double, f double, p double, r2 double, adjusted_r2 double")


def screened_regression(df: DataFrame, y: str, candidates: dict[str, Column], keep: int) -> DataFrame:
    """term, estimate, se, t of y on an intercept and the `keep` candidates that go most with it (ties to the first named).

    The rows are read twice: once for each candidate's correlation with y, over rows that have both, once for the Gramian of
    those chosen. What comes back grows with the number of candidates, then with the square of `keep`.
    """
    names, v = list(candidates), F.col(y).cast("double")
    both = [(F.when(c.isNotNull(), v), F.when(v.isNotNull(), c.cast("double"))) for c in candidates.values()]
    found = df.agg(*[F.try_divide(F.covar_pop(a, b), F.sqrt(F.var_pop(a) * F.var_pop(b))).alias(f"r{k}") for k, (a, b) in enumerate(both)]).first()
    told = [0.0 if r is None or r != r else abs(r) for r in found]
    chosen = sorted(sorted(range(len(names)), key=lambda k: -told[k])[:keep])
    return least_squares(df, y, {"(Intercept)": F.lit(1.0), **{names[k]: candidates[names[k]] for k in chosen}})


def mvn(df: DataFrame, vector: str, by: Sequence[str], dim: int) -> DataFrame:
    """by, i, j, n, mean_i, mean_j, s (centred cross-product), i <= j: for vectors of `dim` numbers; others are left out.

    Group columns may not be called like those of the result (`grouped_moments`)."""
    return grouped_moments(df, F.col(vector), dim, by).drop("w")


def independent_mvn(df: DataFrame, vector: str, by: Sequence[str]) -> DataFrame:
    """by, i, n, mean, ss (centred sum of squares) of each component of vectors; missing components are left out alone."""
    each = df.select(*by, F.posexplode(F.col(vector).cast("array<double>")).alias("i", "_x")).filter(F.col("_x").isNotNull() & ~F.isnan("_x"))
    return each.groupBy(*by, "i").agg(F.count("*").alias("n"), F.avg("_x").alias("mean"), (F.var_pop("_x") * F.count("*")).alias("ss"))


def weighted_mvn(df: DataFrame, columns: Sequence[str], weight: str, by: Sequence[str] = ()) -> DataFrame:
    """by, i, j (names of columns), sum_w, mean_i, mean_j, s (weighted centred cross-product), over rows without a missing value."""
    out = grouped_moments(df, F.array(*[F.col(c).cast("double") for c in columns]), len(columns), by, F.col(weight))
    name = lambda c: F.element_at(F.array(*map(F.lit, columns)), F.col(c) + 1).alias(c)
    return out.select(*by, name("i"), name("j"), F.col("w").alias("sum_w"), "mean_i", "mean_j", "s")


def dirichlet(df: DataFrame, shares: str, by: Sequence[str]) -> DataFrame:
    """by, i, n, sum_log of each component of arrays of shares; arrays that hold one that isn't above 0 are left out whole."""
    p = F.col(shares).cast("array<double>")
    whole = df.filter(F.coalesce(F.forall(p, lambda v: F.coalesce(v > 0, F.lit(False))), F.lit(False)))
    return whole.select(*by, F.posexplode(p).alias("i", "_p")).groupBy(*by, "i").agg(F.count("*").alias("n"), F.sum(F.ln("_p")).alias("sum_log"))


def wishart(df: DataFrame, matrix: str, by: Sequence[str], dim: int) -> DataFrame:
    """by, cell (row * dim + column), n, sum, sum_log_det: of symmetric matrices in arrays of dim * dim numbers, row by row.

    Those that aren't positive definite are left out. Determinants are found in Arrow batches, by Cholesky's factors.
    """
    ship(df.sparkSession)

    @F.pandas_udf("double")
    def log_det(cells: pd.Series) -> pd.Series:
        def one(v) -> float | None:
            try:
                return None if v is None else 2 * float(np.log(np.diag(np.linalg.cholesky(np.asarray(v, dtype=float).reshape(dim, dim)))).sum())
            except (ValueError, np.linalg.LinAlgError):
                return None

        return cells.map(one).astype("float64")

    m = F.col(matrix).cast("array<double>")
    rows = df.select(*by, m.alias("_m")).withColumn("_d", log_det("_m")).filter(F.col("_d").isNotNull() & ~F.isnan("_d"))
    return rows.select(*by, "_d", F.posexplode("_m").alias("cell", "_v")).groupBy(*by, "cell").agg(F.count("*").alias("n"), F.sum("_v").alias("sum"), F.sum("_d").alias("sum_log_det"))


def multivariate_regression(df: DataFrame, responses: Sequence[str], design: dict[str, Column]) -> DataFrame:
    """response, term, estimate, se: least squares of several responses on one design, from one pass of centred products;
    rows that miss any of them are left out for all. Terms that others give: as `least_squares`."""
    f = fit(moments(df, [*design.values(), *map(F.col, responses)]), len(design))
    rows = [(c, t, b, se) for k, c in enumerate(responses) for t, b, se, _ in _terms(list(design), f, k)]
    return df.sparkSession.createDataFrame(rows, "response string, term string, estimate double, se double")


# --- conjugate posteriors ---


def beta_binomial(df: DataFrame, by: Sequence[str], success: Column, a: float = 1.0, b: float = 1.0) -> DataFrame:
    """a, b, mean and sd of the posterior of each group's rate."""
    s = df.groupBy(*by).agg(F.count_if(success).alias("y"), F.count(success).alias("n"))
    s = s.withColumns({"a": F.col("y") + F.lit(a), "b": F.col("n") - F.col("y") + F.lit(b)})
    t = F.col("a") + F.col("b")
    return s.select(*by, "n", "a", "b", (F.col("a") / t).alias("mean"), F.sqrt(F.col("a") * F.col("b") / (t * t * (t + 1))).alias("sd"))


def gamma_poisson(df: DataFrame, by: Sequence[str], events: Column, exposure: Column, a: float = 1.0, b: float = 1.0) -> DataFrame:
    s = df.groupBy(*by).agg((F.sum(events) + a).alias("a"), (F.sum(exposure) + b).alias("b"))
    return s.select(*by, "a", "b", (F.col("a") / F.col("b")).alias("mean"), (F.sqrt("a") / F.col("b")).alias("sd"))


def normal_inverse_gamma(df: DataFrame, by: Sequence[str], x: Column, mu0: float, k0: float, a0: float, b0: float) -> DataFrame:
    """Posterior mu, k, a, b of a normal mean and variance, and the expected variance."""
    s = df.groupBy(*by).agg(F.count(x).alias("n"), F.avg(x).alias("m"), (F.coalesce(F.var_pop(x), F.lit(0.0)) * F.count(x)).alias("ss"))
    k = F.lit(k0) + F.col("n")
    mu = (F.lit(k0 * mu0) + F.col("n") * F.coalesce("m", F.lit(0.0))) / k
    b = F.lit(b0) + F.col("ss") / 2 + F.lit(k0) * F.col("n") * (F.coalesce("m", F.lit(0.0)) - mu0) ** 2 / (2 * k)
    a = F.lit(a0) + F.col("n") / 2
    return s.select(*by, mu.alias("mu"), k.alias("k"), a.alias("a"), b.alias("b"), F.when(a > 1, b / (a - 1)).alias("expected_variance"))


def dirichlet_multinomial(df: DataFrame, by: Sequence[str], level: str, alpha: float = 1.0) -> DataFrame:
    """by, level, posterior: mean share of each level seen anywhere, in each group. NULL is no level."""
    n = df.groupBy(*by, level).agg(F.count(level).alias("n"))
    levels = n.agg(F.sort_array(F.collect_set(level)).alias("_levels"))  # one row, as long as each group's share of the result
    held = n.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.when(F.col(level).isNotNull(), F.struct(level, "n")))).alias("_n"), F.sum("n").alias("_total"))
    full = held.join(F.broadcast(levels)).select(*by, "_n", "_total", F.size("_levels").alias("_k"), F.explode("_levels").alias(level))
    count = F.coalesce(F.element_at("_n", F.col(level)), F.lit(0))
    return full.select(*by, level, count.alias("n"), ((count + alpha) / (F.col("_total") + alpha * F.col("_k"))).alias("posterior"))


# --- distribution functions, by series and continued fractions ---


def gamma_upper(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function."""
    if x <= 0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > 1e-16 * abs(total):
            k += 1
            term *= x / k
            total += term
        return 1 - total * front
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def beta_lower(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_lower(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or tiny)
    h = d
    for m in range(1, 10000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d or tiny)
            c = 1 + num / c or tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def chi_square_p(statistic: float, df: float) -> float:
    return gamma_upper(df / 2, statistic / 2)


def f_p(f: float, d1: float, d2: float) -> float:
    return beta_lower(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)) if f > 0 else 1.0


def student_p(t: float, df: float) -> float:
    """Two-sided."""
    return beta_lower(df / 2, 0.5, df / (df + t * t))


def _beta_panels(a: float, b: float) -> tuple[float, np.ndarray]:
    """The logit of the mode, and edges of panels over all logits at which the density is over exp(-45) of its greatest."""
    mode = math.log(a) - math.log(b)

    def fall(t: float) -> float:
        return a * (_log_logistic(mode) - _log_logistic(t)) + b * (_log_logistic(-mode) - _log_logistic(-t))

    ends = []
    for sign in (-1, 1):
        far = 1e-6
        while fall(mode + sign * far) < 45:
            far *= 2
        near = far / 2
        for _ in range(40):
            mid = (near + far) / 2
            near, far = (near, mid) if fall(mode + sign * mid) >= 45 else (mid, far)
        ends.append(mode + sign * far)
    return mode, np.linspace(*ends, 400)


def _log_logistic(t):
    return -np.logaddexp(0.0, -t)


def compare_rates(y1: int, n1: int, y2: int, n2: int, a: float = 1.0, b: float = 1.0) -> float:
    """Posterior probability that the second rate exceeds the first, by Gauss quadrature over logits: the work is the same for any counts."""
    groups = [(y1 + a, n1 - y1 + b), (y2 + a, n2 - y2 + b)]
    panels = [_beta_panels(*g) for g in groups]
    edges = np.unique(np.concatenate([e for _, e in panels]))
    x, w = np.polynomial.legendre.leggauss(8)
    powers = np.vander(x, increasing=True)
    ahead = (1 - powers * x[:, None]) / np.arange(1, len(x) + 1)  # integrals of the powers from each node to 1
    ahead = ahead @ np.linalg.inv(powers)
    half = np.diff(edges)[:, None] / 2
    t = edges[:-1, None] + half * (1 + x)
    first, second = (np.exp(p * (_log_logistic(t) - _log_logistic(m)) + q * (_log_logistic(-t) - _log_logistic(-m))) for (p, q), (m, _) in zip(groups, panels, strict=True))
    mass = (second * half) @ w
    after = np.append(np.cumsum(mass[::-1])[-2::-1], 0.0)[:, None] + (second * half) @ ahead.T
    return float(((first * after * half) @ w).sum() / ((first * half) @ w).sum() / mass.sum())
