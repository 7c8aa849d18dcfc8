"""Comparisons and regressions that reduce to a few aggregates: proportions, predictions, robust fits, autoregression, pooling."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnspark.functions.shipping import ship

from .sufficient import compare_rates, f_p, gramian, kept


def compare_proportions(df: DataFrame, group: str, success: Column, first, second) -> DataFrame:
    """y1, n1, y2, n2 and the posterior probability that the second group's rate exceeds the first's, with uniform priors."""
    counts = {r.g: (r.y, r.n) for r in df.filter(F.col(group).isin(first, second)).groupBy(F.col(group).alias("g")).agg(F.count_if(success).alias("y"), F.count(success).alias("n")).collect()}  # two rows
    (y1, n1), (y2, n2) = counts.get(first, (0, 0)), counts.get(second, (0, 0))
    return df.sparkSession.createDataFrame([(y1, n1, y2, n2, compare_rates(y1, n1, y2, n2))], "y1 long, n1 long, y2 long, n2 long, probability double")


def compare_predictions(df: DataFrame, truth: Column, predicted: Column) -> DataFrame:
    """n, intercept, slope, f, p: the F test that predictions regressed on the truth have intercept 0 and slope 1."""
    x, y = truth.cast("double"), predicted.cast("double")
    r = df.filter(x.isNotNull() & y.isNotNull()).agg(
        F.count("*").alias("n"), F.regr_slope(y, x).alias("b"), F.regr_intercept(y, x).alias("a"), F.sum((y - x) ** 2).alias("sse0"), F.regr_syy(y, x).alias("syy"), F.regr_sxx(y, x).alias("sxx")
    )
    r = r.select("n", "a", "b", "sse0", (F.col("syy") - F.col("b") ** 2 * F.col("sxx")).alias("sse1"))
    f = F.try_divide((F.col("sse0") - F.col("sse1")) / 2, F.try_divide(F.col("sse1"), F.col("n") - 2))
    row = r.select("n", "a", "b", f.alias("f")).first()
    p = None if row.f is None else f_p(row.f, 2, row.n - 2)
    return df.sparkSession.createDataFrame([(row.n, row.a, row.b, row.f, p)], "n long, intercept double, slope double, f double, p double")


def ks_critical_value(n: Column, alpha: float) -> Column:
    """The distance that an empirical distribution of n >= 35 rows exceeds with a chance of alpha."""
    return F.sqrt(F.lit(-0.5 * math.log(alpha / 2)) / n)


def _reweighted(df: DataFrame, y: Column, design: dict[str, Column], weight, rounds: int) -> tuple[list[str], np.ndarray]:
    """Least squares over and over, weight(residual) given: each round is one aggregation of a weighted Gramian."""
    names, beta = list(design), None
    terms = [F.col(f"_x{i}") for i in range(len(names))]
    columns = {**dict(zip(names, terms, strict=True)), "_y": F.col("_y")}
    with kept(df.select(y.cast("double").alias("_y"), *[c.cast("double").alias(f"_x{i}") for i, c in enumerate(design.values())]).dropna()) as rows:
        for _ in range(rounds):
            fit = F.lit(0.0) if beta is None else sum((c * float(b) for c, b in zip(terms, beta, strict=True)), F.lit(0.0))
            w = None if beta is None else weight(F.col("_y") - fit)
            _, g = gramian(rows, columns, w)
            p = len(names)
            new = np.linalg.lstsq(g[:p, :p], g[:p, p], rcond=None)[0]
            if beta is not None and np.abs(new - beta).max() < 1e-9 * (1 + np.abs(new).max()):
                break
            beta = new
    return names, new


def quantile_regression(df: DataFrame, y: Column, design: dict[str, Column], q: float = 0.5, rounds: int = 40, least: float = 1e-4) -> DataFrame:
    """term, estimate of the q-quantile's linear predictor. Residuals below `least` weigh as one of it."""
    names, beta = _reweighted(df, y, design, lambda r: F.when(r >= 0, q).otherwise(1 - q) / F.greatest(F.abs(r), F.lit(least)), rounds)
    return df.sparkSession.createDataFrame(list(zip(names, map(float, beta), strict=True)), "term string, estimate double")


def student_regression(df: DataFrame, y: Column, design: dict[str, Column], nu: float, scale: float, rounds: int = 40) -> DataFrame:
    """term, estimate with Student errors of nu degrees of freedom and this scale."""
    names, beta = _reweighted(df, y, design, lambda r: F.lit(nu + 1) / (nu + (r / scale) ** 2), rounds)
    return df.sparkSession.createDataFrame(list(zip(names, map(float, beta), strict=True)), "term string, estimate double")


def autoregression(df: DataFrame, x: str, by: Sequence[str], order: Sequence[str], lags: int) -> DataFrame:
    """term, estimate: intercept and lag coefficients pooled over all series, from one Gramian of lag columns."""
    w = Window.partitionBy(*by).orderBy(*order)
    rows = df.select(F.col(x).cast("double").alias("_y"), *[F.lag(F.col(x).cast("double"), k).over(w).alias(f"lag{k}") for k in range(1, lags + 1)]).dropna()
    names, beta = _reweighted(rows, F.col("_y"), {"intercept": F.lit(1.0), **{f"lag{k}": F.col(f"lag{k}") for k in range(1, lags + 1)}}, None, 1)
    return df.sparkSession.createDataFrame(list(zip(names, map(float, beta), strict=True)), "term string, estimate double")


def partial_pooling(df: DataFrame, x: str, group: str) -> DataFrame:
    """group, n, mean, pooled: group means drawn towards their overall mean by a normal hierarchy with moment estimates.

    within: pooled variance inside groups; between: what the variance of group means holds beyond within / n, at least 0.
    Two aggregations; nothing comes to the driver.
    """
    v = F.col(x).cast("double")
    each = df.filter(v.isNotNull()).groupBy(group).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.coalesce(F.var_samp(v), F.lit(0.0)).alias("var"))
    total = each.agg(
        F.avg("mean").alias("_centre"),
        F.coalesce(F.try_divide(F.sum((F.col("n") - 1) * F.col("var")), F.sum(F.col("n") - 1)), F.lit(0.0)).alias("_within"),
        F.coalesce(F.var_samp("mean"), F.lit(0.0)).alias("_spread"),
        F.avg(1 / F.col("n")).alias("_inverse"),
    )
    between = F.greatest(F.col("_spread") - F.col("_within") * F.col("_inverse"), F.lit(0.0))
    keep = F.coalesce(F.try_divide(between, between + F.col("_within") / F.col("n")), F.lit(1.0))
    return each.join(F.broadcast(total)).select(group, "n", "mean", (F.col("_centre") + keep * (F.col("mean") - F.col("_centre"))).alias("pooled"))


def one_step_errors(df: DataFrame, y: str, by: Sequence[str], order: Sequence[str], *, level_var: float, slope_var: float, noise_var: float, season: int = 0, season_var: float = 0.0) -> DataFrame:
    """by, order, expected, variance, error: one-step predictions of a local linear trend with a season, a Kalman filter a series.

    A series must fit in a task's memory; series are dealt over tasks. Missing values get a prediction and no error.
    """
    ship(df.sparkSession)
    kinds = [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in [*by, *order]]
    m = 2 + max(0, season - 1)
    move, noise, look = np.zeros((m, m)), np.zeros((m, m)), np.zeros(m)
    move[0, :2], move[1, 1], look[0] = 1.0, 1.0, 1.0
    noise[0, 0], noise[1, 1] = level_var, slope_var
    if season > 1:
        move[2, 2:], look[2], noise[2, 2] = -1.0, 1.0, season_var
        move[3:, 2:-1] = np.eye(m - 3)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(list(order), kind="stable")
        a, p = np.zeros(m), np.eye(m) * 1e6
        out = []
        for v in rows[y].to_numpy(dtype=float):
            f = look @ p @ look + noise_var
            expected = look @ a
            if v == v:
                gain = p @ look / f
                out.append((expected, f, v - expected))
                a, p = a + gain * (v - expected), p - np.outer(gain, look @ p)
            else:
                out.append((expected, f, None))
            a, p = move @ a, move @ p @ move.T + noise
        found = pd.DataFrame(out, columns=["expected", "variance", "error"], index=rows.index)
        return pd.concat([rows[[*by, *order]], found], axis=1)

    return df.select(*by, *order, F.col(y).cast("double").alias(y)).groupBy(*by).applyInPandas(run, ", ".join([*kinds, "expected double", "variance double", "error double"]))
