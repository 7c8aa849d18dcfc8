"""Models with parts that are not seen: factors, abilities, levels that walk, zeros of two kinds, nets. The rows are read as
sums on the cluster; what is fitted from those sums has the size of the model, never of the data."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnspark.functions.shipping import ship

from .models import settled
from .sufficient import gramian, kept, mvn

# --- factors ---


def factor_analysis(df: DataFrame, vector: str, dim: int, k: int, close: float = 1e-9, least: float = 1e-4) -> DataFrame:
    """variable, factor, loading, uniqueness (the share of the variable's variance that no factor holds) by likelihood.

    The rows give their correlations in one aggregation; expectation and maximisation run on those until a round adds less
    than `close`. Factors are turned to be independent given the data, the strongest first, their largest loading positive.
    Uniquenesses are `least` at least. Loadings are those of the standardized variables.
    """
    s = np.zeros((dim, dim))
    for r in mvn(df, vector, [], dim).select("i", "j", "s").collect():  # dim * (dim + 1) / 2 rows
        s[r.i, r.j] = s[r.j, r.i] = r.s
    scale = np.sqrt(np.diag(s))
    if not np.all(scale > 0):
        raise ValueError("each variable has to vary")
    r = s / np.outer(scale, scale)
    values, vectors = np.linalg.eigh(r)
    noise = float(np.clip(values[:-k].mean(), 0.05, 0.95))
    start = vectors[:, -k:] * np.sqrt(np.maximum(values[-k:] - noise, 0.01))

    def parts(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return at[: dim * k].reshape(dim, k), np.exp(np.clip(at[dim * k :], math.log(least), 5.0))

    def em(at: np.ndarray) -> tuple[np.ndarray, float]:
        load, unique = parts(at)
        inner = np.linalg.inv(np.eye(k) + (load.T / unique) @ load)
        beta = inner @ (load.T / unique)
        seen = r @ beta.T
        fit = -0.5 * (np.log(unique).sum() - np.linalg.slogdet(inner)[1] + (np.diag(r) / unique).sum() - np.sum((beta @ seen) * np.linalg.inv(inner)))
        new = seen @ np.linalg.inv(inner + beta @ seen)
        left = np.maximum(np.diag(r) - np.einsum("ij,ij->i", new, seen), least)
        return np.concatenate([new.ravel(), np.log(left)]), float(fit)

    load, unique = parts(settled(em, np.concatenate([start.ravel(), np.log(np.full(dim, noise))]), None, close))
    strength, turn = np.linalg.eigh((load.T / unique) @ load)
    load = load @ turn[:, np.argsort(-strength)]
    load = load * np.where(load[np.abs(load).argmax(axis=0), np.arange(k)] < 0, -1.0, 1.0)
    out = [(i, f, float(load[i, f]), float(unique[i])) for i in range(dim) for f in range(k)]
    return df.sparkSession.createDataFrame(out, "variable int, factor int, loading double, uniqueness double")


# --- abilities ---


def _symmetric(e: np.ndarray) -> np.ndarray:
    """The elementary symmetric functions of e, of degree 0 and up."""
    out = np.ones(1)
    for v in e:
        out = np.append(out, 0.0) + v * np.append(0.0, out)
    return out


def rasch(df: DataFrame, items: dict[str, Column], rounds: int = 100) -> DataFrame:
    """item, n (persons), correct, difficulty, se: the chance of a right answer is logistic in ability less difficulty.

    Fitted given each person's number of right answers, which does away with abilities: the number of persons and the right
    answers to each item, by score, are all that is needed of the rows, and come from one aggregation of as many rows as there
    are scores. Persons that miss an answer are left out. Those who got all or none right count, but say nothing of
    difficulties. Difficulties sum to 0.
    """
    names, p = list(items), len(items)
    right = df.select(*[c.cast("boolean").cast("int").alias(f"_i{k}") for k, c in enumerate(items.values())]).dropna()
    score = sum((F.col(f"_i{k}") for k in range(1, p)), F.col("_i0"))
    found = right.groupBy(score.alias("_r")).agg(F.count("*").alias("_n"), *[F.sum(f"_i{k}").alias(f"_s{k}") for k in range(p)]).collect()
    n, total = np.zeros(p + 1), np.zeros(p)
    for row in found:
        n[row._r] = row._n
        if 0 < row._r < p:
            total += [row[f"_s{k}"] for k in range(p)]
    told = n[1:p].sum()
    if not told or np.any(total == 0) or np.any(total == told):
        raise ValueError("each item needs right and wrong answers of persons who got neither all nor none right")
    b, out = np.zeros(p), np.zeros((p, p))
    for _ in range(rounds):
        e = np.exp(-b)
        whole = _symmetric(e)
        one = np.array([e[i] * _symmetric(np.delete(e, i)) for i in range(p)])  # degree r holds item i right at score r + 1
        chance = one[:, : p - 1] / whole[1:p]
        out = -(chance * n[1:p]) @ chance.T
        for i in range(p):
            out[i, i] += (chance[i] * n[1:p]).sum()
            for j in range(i):
                both = e[i] * e[j] * _symmetric(np.delete(e, [i, j]))
                out[i, j] += (np.append(0.0, both)[: p - 1] / whole[1:p] * n[1:p]).sum()
                out[j, i] = out[i, j]
        step = np.linalg.pinv(out) @ (chance @ n[1:p] - total)
        b = b + step * min(1.0, 2.0 / max(np.abs(step).max(), 1e-300))
        b -= b.mean()
        if np.abs(step).max() < 1e-10:
            se = np.sqrt(np.maximum(np.diag(np.linalg.pinv(out)), 0.0))
            correct = [int(sum(row[f"_s{k}"] for row in found)) for k in range(p)]
            rows = [(names[k], int(n.sum()), correct[k], float(b[k]), float(se[k])) for k in range(p)]
            return df.sparkSession.createDataFrame(rows, "item string, n long, correct long, difficulty double, se double")
    raise RuntimeError(f"no convergence in {rounds} steps")


# --- levels that walk ---


def multiplexed(df: DataFrame, by: Sequence[str], time: str, y: str) -> DataFrame:
    """by, time, n, mean, ss: several values of a series at one time, as what a Gaussian level needs of them."""
    v = F.col(y).cast("double")
    return df.groupBy(*by, time).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), (F.var_pop(v) * F.count(v)).alias("ss"))


def _profile(values: np.ndarray, ratio: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each ratio of the level's variance to the noise's: log likelihood at the best noise, that noise, last level and its
    variance over the noise's. The level starts as the first value."""
    level = spread = None
    logs, squares, n = np.zeros_like(ratio), np.zeros_like(ratio), 0
    for v in values:
        if spread is not None:
            spread = spread + ratio
        if v != v:
            continue
        if spread is None:
            level, spread = np.full_like(ratio, v), np.ones_like(ratio)
            continue
        f = spread + 1
        e = v - level
        logs, squares, n = logs + np.log(f), squares + e * e / f, n + 1
        level, spread = level + spread / f * e, spread / f
    noise = squares / max(n, 1)
    with np.errstate(divide="ignore"):
        return -0.5 * (n * (np.log(2 * math.pi * noise) + 1) + logs), noise, level, spread


def local_level_fit(df: DataFrame, y: str, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """by, n, level_var, noise_var, loglik, level, level_variance: variances of each series' walking level and of the noise about
    it, by likelihood, and the level after the last row.

    The ratio of the two is sought on a grid over its logarithm (0 is tried too), narrowed five times around its best point;
    the noise follows from it. Series of less than three values or of equal ones have no fit (NULL). A series must fit in a
    task's memory; series are dealt over tasks.
    """
    ship(df.sparkSession)
    keys = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        values = rows.sort_values(list(order), kind="stable")[y].to_numpy(dtype=float)
        n, got = int((values == values).sum()), (None,) * 5
        if n >= 3 and np.nanmax(values) > np.nanmin(values):
            low, high, best = -16.0, 12.0, None
            for _ in range(6):
                grid = np.linspace(low, high, 41)
                ratio = np.append(np.exp(grid), 0.0)
                fit, noise, level, spread = _profile(values, ratio)
                at = int(fit.argmax())
                if best is None or fit[at] > best[0]:
                    best = (fit[at], ratio[at] * noise[at], noise[at], level[at], spread[at] * noise[at])
                inner = min(max(int(fit[:-1].argmax()), 1), 39)
                low, high = grid[inner - 1], grid[inner + 1]
            got = (best[1], best[2], best[0], best[3], best[4])
        names = ("level_var", "noise_var", "loglik", "level", "level_variance")
        return pd.DataFrame([{**{c: rows[c].iloc[0] for c in by}, "n": n, **{k: None if v is None else float(v) for k, v in zip(names, got, strict=True)}}])

    rows = df.select(*dict.fromkeys([*by, *order]), F.col(y).cast("double").alias(y))
    return rows.groupBy(*by).applyInPandas(run, f"{keys}, n long, level_var double, noise_var double, loglik double, level double, level_variance double")


def level_forecast(fits: DataFrame, by: Sequence[str], horizon: int) -> DataFrame:
    """by, ahead, expected, sd of the next values of each series of `local_level_fit` (or of any table with those columns)."""
    ahead = fits.filter(F.col("level").isNotNull()).select("*", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("ahead"))
    return ahead.select(*by, "ahead", F.col("level").alias("expected"), F.sqrt(F.col("level_variance") + F.col("ahead") * F.col("level_var") + F.col("noise_var")).alias("sd"))


# --- zeros of two kinds ---


def zero_inflated_regression(df: DataFrame, y: Column, counts: dict[str, Column], zeros: dict[str, Column], close: float = 1e-9, rounds: int = 50) -> DataFrame:
    """part (count, zero), term, estimate, se: counts whose logarithm of the mean is linear in one design, but that are 0 anyway
    with a chance whose log odds are linear in another.

    Rounds of expectation and one scoring step (`models.settled`) come near; steps by the likelihood's own curvature end it.
    Each is one aggregation over the rows. Rows that miss a value are left out.
    """
    p, q = len(counts), len(zeros)
    columns = [*counts.values(), *zeros.values()]
    rows = df.select(y.cast("double").alias("_y"), *[c.cast("double").alias(f"_x{i}") for i, c in enumerate(columns)]).dropna().filter("_y >= 0")
    x = [F.col(f"_x{i}") for i in range(p + q)]
    linear = lambda b, xs: F.greatest(F.lit(-30.0), F.least(F.lit(30.0), sum((c * float(v) for c, v in zip(xs, b, strict=True)), F.lit(0.0))))

    def sums(at: np.ndarray, curved: bool) -> tuple[float, np.ndarray, np.ndarray]:
        """The mean log likelihood, its slope, and the information: of the likelihood itself (curved) or of complete rows."""
        near = rows.select("_y", *x, F.exp(linear(at[:p], x[:p])).alias("_m"), (1 / (1 + F.exp(-linear(at[p:], x[p:])))).alias("_z"))
        zero, m, z = F.col("_y") == 0, F.col("_m"), F.col("_z")
        chance = z + (1 - z) * F.exp(-m)
        held = near.select("_y", *x, "_m", "_z", F.when(zero, z / chance).otherwise(0.0).alias("_r"), F.when(zero, F.ln(chance)).otherwise(F.log1p(-z) + F.col("_y") * F.ln(m) - m).alias("_l"))
        r = F.col("_r")
        down = F.when(zero, -(1 - r) * m).otherwise(F.col("_y") - m)
        both = r * (1 - r)
        if curved:
            weights = ((1 - r) * m - both * m * m, -both * m, z * (1 - z) - both)
        else:
            weights = ((1 - r) * m, F.lit(0.0), z * (1 - z))
        pairs = [(i, j) for i in range(p + q) for j in range(i, p + q)]
        cells = [F.sum(x[i] * (down if i < p else r - z)) for i in range(p + q)]
        cells += [F.sum(x[i] * x[j] * weights[(i >= p) + (j >= p)]) for i, j in pairs]
        got = held.agg(F.count("*"), F.sum("_l"), *cells).first()
        information = np.zeros((p + q, p + q))
        for (i, j), v in zip(pairs, got[2 + p + q :], strict=True):
            information[i, j] = information[j, i] = v or 0.0
        return (got[1] or 0.0) / max(got[0], 1), np.array([v or 0.0 for v in got[2 : 2 + p + q]]), information

    def em(at: np.ndarray) -> tuple[np.ndarray, float]:
        fit, slope, information = sums(at, False)
        return at + np.linalg.lstsq(information, slope, rcond=None)[0], fit

    with kept(rows) as rows:
        _, g = gramian(rows.filter("_y > 0"), {**{str(i): c for i, c in enumerate(x[:p])}, "_z": F.ln("_y")})
        start = np.append(np.linalg.lstsq(g[:p, :p], g[:p, p], rcond=None)[0], np.zeros(q))
        b = settled(em, start, None, close)
        for _ in range(rounds):
            _, slope, information = sums(b, True)
            step = np.linalg.solve(information, slope)
            b = b + step
            if np.abs(step).max() < 1e-8 * max(1.0, np.abs(b).max()):
                break
        else:
            raise RuntimeError(f"no convergence in {rounds} steps")
    se = np.sqrt(np.maximum(0.0, np.diag(np.linalg.pinv(information))))
    names = [("count", t) for t in counts] + [("zero", t) for t in zeros]
    return df.sparkSession.createDataFrame([(*n, float(e), float(s)) for n, e, s in zip(names, b, se, strict=True)], "part string, term string, estimate double, se double")


# --- nets ---


def eliminate(tables: Sequence[DataFrame], keep: Sequence[str], evidence: dict | None = None, weight: str = "p") -> DataFrame:
    """keep, p: the distribution of the kept variables of a net, given what is known of others.

    tables: one for each node or clique, its variables and a weight; variables are shared by name. Evidence filters every
    table; then the other variables go one by one, at each the one whose tables have the fewest variables together: its tables
    are joined on what they share, multiplied and summed over it. Parts of the net that aren't linked to the kept variables
    cancel. Raises if the kept variables aren't linked with each other.
    """
    left = []
    for t in tables:
        t = reduce(lambda d, c: d.filter(F.col(c) == F.lit(evidence[c])), [c for c in t.columns if c in (evidence or {})], t)
        names = [c for c in t.columns if c != weight and c not in (evidence or {})]
        left.append(t.groupBy(*names).agg(F.sum(weight).alias(weight)))

    def product(a: DataFrame, b: DataFrame) -> DataFrame:
        on = [c for c in a.columns if c in b.columns and c != weight]
        if not on:
            raise ValueError("the kept variables are not linked")
        joined = a.withColumnRenamed(weight, "_a").join(b.withColumnRenamed(weight, "_b"), on)
        return joined.withColumn(weight, F.col("_a") * F.col("_b")).drop("_a", "_b")

    while True:
        left = [t for t in left if len(t.columns) > 1]
        width = {v: len({c for t in left if v in t.columns for c in t.columns}) for t in left for v in t.columns if v not in (*keep, weight)}
        if not width:
            break
        gone = min(width, key=lambda v: (width[v], v))
        whole = reduce(product, [t for t in left if gone in t.columns])
        rest = [c for c in whole.columns if c not in (gone, weight)]
        left = [t for t in left if gone not in t.columns] + [whole.groupBy(*rest).agg(F.sum(weight).alias(weight))]
    while len(left) > 1:  # next one that shares a variable with the first
        other = next((t for t in left[1:] if set(t.columns) & set(left[0].columns) - {weight}), left[1])
        left = [product(left[0], other), *[t for t in left[1:] if t is not other]]
    total = left[0].agg(F.sum(weight).alias("_total"))  # one row
    return left[0].join(F.broadcast(total)).select(*keep, F.try_divide(weight, "_total").alias(weight))
