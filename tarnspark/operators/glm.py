"""Regressions of categories, of signs and of positive numbers: Fisher scoring, each step one aggregation over the rows.

What comes back to the driver in a step are sums over the design's columns (and levels), never rows. Rows that miss a value are
left out. A fit that doesn't settle within its steps raises.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnspark.functions.mathx import logit_inv, normal_cdf, normal_density

from .sufficient import gramian, kept


def _linear(b: Sequence[float], x: Sequence[Column]) -> Column:
    return sum((c * float(v) for c, v in zip(x, b, strict=True)), F.lit(0.0))


def settled_steps(step: Callable[[np.ndarray], np.ndarray], b: np.ndarray, rounds: int, close: float = 1e-9) -> np.ndarray:
    """b after as many steps as it takes until none of its entries moves by `close` of its size (or of 1)."""
    for _ in range(rounds):
        new = step(b)
        moved, b = np.max(np.abs(new - b) / np.maximum(1.0, np.abs(new)), initial=0.0), new
        if moved < close:
            return b
    raise RuntimeError(f"no convergence in {rounds} steps")


def _table(df: DataFrame, names: Sequence[str], b: np.ndarray, information: np.ndarray) -> DataFrame:
    se = np.sqrt(np.maximum(0.0, np.diag(np.linalg.pinv(information))))
    return df.sparkSession.createDataFrame([(n, float(e), float(s)) for n, e, s in zip(names, b, se, strict=True)], "term string, estimate double, se double")


def _sums(rows: DataFrame, cells: dict[tuple[int, int] | int, Column]) -> dict:
    """One aggregation of all cells: an int stands for an entry of the gradient, a pair for one of the information."""
    got = rows.agg(*[F.sum(c).alias(f"s{k}") for k, c in enumerate(cells.values())]).first()
    return dict(zip(cells, (v or 0.0 for v in got), strict=True))


def _matrices(sums: dict, size: int) -> tuple[np.ndarray, np.ndarray]:
    gradient, information = np.zeros(size), np.zeros((size, size))
    for at, v in sums.items():
        if isinstance(at, tuple):
            information[at] = information[at[::-1]] = v
        else:
            gradient[at] = v
    return gradient, information


def probit(df: DataFrame, y: Column, design: dict[str, Column], rounds: int = 50) -> DataFrame:
    """term, estimate, se of a regression of a truth value whose chance is the normal distribution function of the design."""
    k, last = len(design), {}
    rows = df.select(y.cast("double").alias("_y"), *[c.cast("double").alias(f"_x{i}") for i, c in enumerate(design.values())]).dropna()
    x = [F.col(f"_x{i}") for i in range(k)]

    def step(b: np.ndarray) -> np.ndarray:
        eta = F.greatest(F.lit(-8.0), F.least(F.lit(8.0), _linear(b, x)))
        near = rows.withColumn("_eta", eta).withColumn("_tail", normal_cdf(-F.abs("_eta")))
        tail = F.col("_tail")
        p = F.when(F.col("_eta") < 0, tail).otherwise(1 - tail)
        lean = near.select(*x, (normal_density(F.col("_eta")) / (tail * (1 - tail))).alias("_l"), (F.col("_y") - p).alias("_r"), normal_density(F.col("_eta")).alias("_f"))
        cells: dict = {i: F.col("_l") * F.col("_r") * v for i, v in enumerate(x)}
        cells |= {(i, j): F.col("_l") * F.col("_f") * x[i] * x[j] for i in range(k) for j in range(i, k)}
        gradient, last["g"] = _matrices(_sums(lean, cells), k)
        return b + np.linalg.solve(last["g"], gradient)

    with kept(rows) as rows:
        b = settled_steps(step, np.zeros(k), rounds)
    return _table(df, list(design), b, last["g"])


def gamma_regression(df: DataFrame, y: Column, design: dict[str, Column], rounds: int = 50) -> tuple[DataFrame, float]:
    """term, estimate, se of a gamma regression with a log link, and its shape (by likelihood); y that isn't above 0 is left out."""
    v, k, last = F.col("_y"), len(design), {}
    x = [F.col(f"_x{i}") for i in range(k)]
    terms = dict(zip(design, x, strict=True))
    rows = df.select(y.cast("double").alias("_y"), *[c.cast("double").alias(f"_x{i}") for i, c in enumerate(design.values())]).dropna().filter("_y > 0")

    def step(b: np.ndarray) -> np.ndarray:
        eta = _linear(b, x)
        _, g = gramian(rows, {**terms, "_z": eta + v * F.exp(-eta) - 1})
        last["g"] = g[:k, :k]
        return np.linalg.solve(g[:k, :k], g[:k, k])

    with kept(rows) as rows:
        _, g = gramian(rows, {**terms, "_z": F.ln(v)})
        b = settled_steps(step, np.linalg.solve(g[:k, :k], g[:k, k]), rounds)
        ratio = v * F.exp(-_linear(b, x))
        # at the estimate the shape solves ln(a) - digamma(a) = mean(ratio) - 1 - mean(ln(ratio))
        gap = rows.agg(F.avg(ratio - 1 - F.ln(ratio))).first()[0] or 0.0
    shape = _shape(gap)
    return _table(df, list(design), b, last["g"] * shape), shape


def _digamma(a: float) -> float:
    """By its series for large arguments, after steps up to them."""
    out = 0.0
    while a < 10:
        out, a = out - 1 / a, a + 1
    r = 1 / (a * a)
    return out + math.log(a) - 0.5 / a - r * (1 / 12 - r * (1 / 120 - r * (1 / 252 - r / 240)))


def _shape(gap: float) -> float:
    """The a at which ln(a) - digamma(a), which falls in a, is `gap`: by halving on a log scale."""
    if gap <= 0:
        return math.inf
    low, high = -30.0, 30.0
    for _ in range(200):
        mid = (low + high) / 2
        a = math.exp(mid)
        low, high = (mid, high) if math.log(a) - _digamma(a) > gap else (low, mid)
    return math.exp((low + high) / 2)


def multinomial_logit(df: DataFrame, y: str, levels: Sequence, design: dict[str, Column], rounds: int = 50) -> DataFrame:
    """level, term, estimate, se: log odds of each level but the first against the first, linear in the design."""
    k, others = len(design), list(levels[1:])
    rows = df.filter(F.col(y).isin(*levels)).select(F.col(y).alias("_y"), *[c.cast("double").alias(f"_x{i}") for i, c in enumerate(design.values())]).dropna()
    x, size, last = [F.col(f"_x{i}") for i in range(k)], k * len(others), {}

    def step(b: np.ndarray) -> np.ndarray:
        eta = [_linear(b[a * k : a * k + k], x) for a in range(len(others))]
        top = F.greatest(F.lit(0.0), *eta)
        # the chances are columns of their own, so that each is worked out once a row
        odds = rows.withColumns({f"_e{a}": F.exp(e - top) for a, e in enumerate(eta)} | {"_e": F.exp(-top)})
        total = sum((F.col(f"_e{a}") for a in range(len(others))), F.col("_e"))
        chances = odds.select("_y", *x, *[(F.col(f"_e{a}") / total).alias(f"_p{a}") for a in range(len(others))])
        p = [F.col(f"_p{a}") for a in range(len(others))]
        cells: dict = {a * k + i: ((F.col("_y") == level).cast("double") - p[a]) * x[i] for a, level in enumerate(others) for i in range(k)}
        for a in range(len(others)):
            for c in range(a, len(others)):
                w = p[a] * (1 - p[a]) if a == c else -p[a] * p[c]
                cells |= {(a * k + i, c * k + j): w * x[i] * x[j] for i in range(k) for j in range(i if a == c else 0, k)}
        gradient, last["g"] = _matrices(_sums(chances, cells), size)
        return b + np.linalg.solve(last["g"], gradient)

    with kept(rows) as rows:
        b = settled_steps(step, np.zeros(size), rounds)
    se = np.sqrt(np.maximum(0.0, np.diag(np.linalg.pinv(last["g"]))))
    out = [(str(level), t, float(b[a * k + i]), float(se[a * k + i])) for a, level in enumerate(others) for i, t in enumerate(design)]
    return df.sparkSession.createDataFrame(out, "level string, term string, estimate double, se double")


def ordinal_logit(df: DataFrame, y: str, levels: Sequence, design: dict[str, Column], rounds: int = 50) -> DataFrame:
    """term, estimate, se of a cumulative logit: the chance of a level up to the k-th is logistic in cut k less the design, which
    holds no intercept. Terms are `cut.<level>` of each level but the last, then the design's."""
    m, k = len(levels), len(design)
    place = F.array_position(F.array(*[F.lit(v) for v in levels]), F.col(y)).cast("int")
    rows = df.select(place.alias("_y"), *[c.cast("double").alias(f"_x{i}") for i, c in enumerate(design.values())]).dropna().filter("_y > 0")
    x, cuts, size, last = [F.col(f"_x{i}") for i in range(k)], m - 1, m - 1 + k, {}
    counts = dict(rows.groupBy("_y").count().collect())  # one row a level
    if len(counts) < m:
        raise ValueError("each level has to occur")
    share = np.cumsum([counts[i + 1] for i in range(cuts)]) / sum(counts.values())

    def step(b: np.ndarray) -> np.ndarray:
        eta = _linear(b[cuts:], x)
        below = rows.select("_y", *x, *[logit_inv(float(b[j]) - eta).alias(f"_c{j + 1}") for j in range(cuts)])
        c = [F.lit(0.0), *[F.col(f"_c{j + 1}") for j in range(cuts)], F.lit(1.0)]
        # f: densities at the cuts, p: chances of the levels
        terms = below.select("_y", *x, *[(v * (1 - v)).alias(f"_f{j}") for j, v in enumerate(c)], *[(c[j + 1] - c[j]).alias(f"_p{j}") for j in range(m)])
        f, p = [F.col(f"_f{j}") for j in range(m + 1)], [F.col(f"_p{j}") for j in range(m)]
        is_, slope = [F.when(F.col("_y") == j + 1, 1.0).otherwise(0.0) for j in range(m)], [f[j + 1] - f[j] for j in range(m)]
        cells: dict = {j: f[j + 1] * (is_[j] / p[j] - is_[j + 1] / p[j + 1]) for j in range(cuts)}
        pull = sum((is_[j] * slope[j] / p[j] for j in range(m)), F.lit(0.0))
        spread = sum((slope[j] * slope[j] / p[j] for j in range(m)), F.lit(0.0))
        cells |= {cuts + i: -v * pull for i, v in enumerate(x)}
        cells |= {(j, j): f[j + 1] * f[j + 1] * (1 / p[j] + 1 / p[j + 1]) for j in range(cuts)}
        cells |= {(j, j + 1): -f[j + 1] * f[j + 2] / p[j + 1] for j in range(cuts - 1)}
        cells |= {(j, cuts + i): -v * f[j + 1] * (slope[j] / p[j] - slope[j + 1] / p[j + 1]) for j in range(cuts) for i, v in enumerate(x)}
        cells |= {(cuts + i, cuts + j): x[i] * x[j] * spread for i in range(k) for j in range(i, k)}
        gradient, last["g"] = _matrices(_sums(terms, cells), size)
        move = np.linalg.solve(last["g"], gradient)
        while np.any(np.diff((b + move)[:cuts]) <= 0):  # the cuts have to stay in order
            move /= 2
        return b + move

    with kept(rows) as rows:
        b = settled_steps(step, np.append(np.log(share / (1 - share)), np.zeros(k)), rounds)
    return _table(df, [*[f"cut.{v}" for v in levels[:-1]], *design], b, last["g"])


def zero_inflated_fit(df: DataFrame, by: Sequence[str], x: Column) -> DataFrame:
    """by, zeros, positive, rate, extra: the Poisson rate and the share of zeros beyond it, by likelihood, of each group of counts.

    The rate solves rate / (1 - exp(-rate)) = mean of the positive counts; fewer zeros than Poisson gives make `extra` negative,
    as its likelihood is greatest there. NULL rate without a count above 1.
    """
    s = df.groupBy(*by).agg(F.count_if(x == 0).alias("zeros"), F.count_if(x > 0).alias("positive"), F.sum(F.when(x > 0, x)).cast("double").alias("_s"))
    mean = F.try_divide(F.col("_s"), F.col("positive"))
    # Newton from above on a convex increasing function; the fold keeps each step one expression
    newton = lambda r, _: r - (r / -F.expm1(-r) - F.col("_m")) / ((-F.expm1(-r) - r * F.exp(-r)) / (F.expm1(-r) * F.expm1(-r)))
    rate = F.aggregate(F.sequence(F.lit(1), F.lit(60)), F.col("_m"), newton)
    fitted = s.withColumn("_m", mean).withColumn("rate", F.when(F.col("_m") > 1, rate))
    n = F.col("zeros") + F.col("positive")
    return fitted.select(*by, "zeros", "positive", "rate", (1 - F.try_divide(F.col("positive").cast("double"), n * -F.expm1(-F.col("rate")))).alias("extra"))
