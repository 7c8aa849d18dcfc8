"""Mixtures of normal vectors, finite or of a Dirichlet process, and labels of one clustering matched to those of another."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnspark.functions.shipping import ship

from .moments import Moments
from .sufficient import kept
from .wide import _matrix, centre

#: Rows, of least hash, on which a fit looks for its first means.
STARTERS = 4096
_PART = "component int, loglik double, n long, w double, mean array<double>, low array<double>, s array<double>"
_KINDS = pa.schema([("component", pa.int32()), ("loglik", pa.float64()), ("n", pa.int64()), ("w", pa.float64()), *[(c, pa.list_(pa.float64())) for c in ("mean", "low", "s")]])


@dataclass(frozen=True)
class Mixture:
    """Components of these weights, means and covariances; loglik: the mean log density of a row where the last round began."""

    weights: np.ndarray
    means: np.ndarray
    covariances: np.ndarray
    loglik: float = math.nan

    def log_densities(self, x: np.ndarray) -> np.ndarray:
        """Rows by components, with the components' weights."""
        out = np.full((len(x), len(self.weights)), -np.inf)
        for k in np.flatnonzero(self.weights > 0):
            root = np.linalg.cholesky(self.covariances[k])
            z = np.linalg.solve(root, (x - self.means[k]).T)
            out[:, k] = math.log(self.weights[k]) - 0.5 * (z * z).sum(axis=0) - np.log(np.diag(root)).sum() - 0.5 * x.shape[1] * math.log(2 * math.pi)
        return out

    def shares(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each row's log density, and the chance of each component given the row."""
        logs = self.log_densities(x)
        top = logs.max(axis=1, keepdims=True)
        e = np.exp(logs - top)
        total = e.sum(axis=1, keepdims=True)
        return (top + np.log(total))[:, 0], e / total

    def table(self, spark) -> DataFrame:
        """component, weight, mean, covariance (row by row)."""
        rows = [(k, float(w), m.tolist(), c.ravel().tolist()) for k, (w, m, c) in enumerate(zip(self.weights, self.means, self.covariances, strict=True))]
        return spark.createDataFrame(rows, "component int, weight double, mean array<double>, covariance array<double>")


def em_round(df: DataFrame, vector: str, dim: int, now: Mixture, *, sticks: float | None = None, prior_rows: float = 0.0, prior: np.ndarray | None = None) -> Mixture:
    """One round of expectation and maximisation. Each task adds up the moments of each component over its rows, by their chances;
    a component's parts meet in one task, and one row a component comes to the driver.

    prior_rows, prior: covariances shrink to the matrix `prior` as if that many rows had it. sticks: weights are pieces broken
    off a stick one after another, each with a share whose prior is Beta(1, sticks), the largest component first."""
    k = len(now.weights)
    at = df.sparkSession.sparkContext.broadcast(now)

    def rows(found: dict[int, tuple[float, Moments]]) -> pa.RecordBatch:
        lists = [m.lists() | {"component": [c], "loglik": [fit]} for c, (fit, m) in found.items()]
        return pa.RecordBatch.from_pydict({c.name: [v for x in lists for v in x[c.name]] for c in _KINDS}, _KINDS)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fit, sums = 0.0, [Moments.none(dim) for _ in range(k)]
        for batch in batches:
            x = _matrix(batch, dim, False)
            if len(x):
                density, chance = at.value.shares(x)
                fit += float(density.sum())
                sums = [s + Moments.of(x, chance[:, c]) for c, s in enumerate(sums)]
        yield rows({c: (fit if c == 0 else 0.0, s) for c, s in enumerate(sums)})

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, tuple[float, Moments]] = {}
        for batch in batches:
            for c, fit, *held in zip(*[x.to_pylist() for x in batch.columns], strict=True):
                own = Moments.read(*held)
                found[c] = (found[c][0] + fit, found[c][1] + own) if c in found else (fit, own)
        yield rows(found)

    got = df.select(F.col(vector).cast("array<double>").alias("v")).mapInArrow(part, _PART).repartition("component").mapInArrow(merge, _PART).collect()
    got = {r.component: r for r in got}
    n = max((r.n for r in got.values()), default=0)
    if not n:
        raise ValueError("no row has a whole vector")
    own = [Moments.read(*got[c][2:]) for c in range(k)]
    w = np.array([m.w for m in own])
    order = np.argsort(-w, kind="stable") if sticks is not None else np.arange(k)
    w = w[order]
    if sticks is None:
        weights = w / n
    else:
        rest = np.append(np.cumsum(w[::-1])[::-1][1:], 0.0)
        broken = np.clip(w / np.maximum(w + rest + max(sticks - 1.0, 0.0), 1e-300), 0.0, 1.0)
        broken[-1] = 1.0
        weights = broken * np.append(1.0, np.cumprod(1 - broken)[:-1])
    shape = np.zeros((dim, dim)) if prior is None else prior
    means = np.stack([own[c].mean + own[c].low if own[c].w > 0 else now.means[c] for c in order])
    spread = np.stack([(own[c].s + prior_rows * shape) / (own[c].w + prior_rows) if own[c].w + prior_rows > 0 else now.covariances[c] for c in order])
    return Mixture(weights, means, spread, sum(r.loglik for r in got.values()) / n)


def fit_mixture(df: DataFrame, vector: str, dim: int, components: int, *, sticks: float | None = None, prior_rows: float = 5.0, seed: int = 0, close: float = 1e-7, rounds: int = 500) -> Mixture:
    """A mixture of normal vectors by expectation and maximisation over all rows, until a round adds less than `close` to the
    mean log density; raises after `rounds`. Components come by falling weight.

    The first means are rows far from each other, out of STARTERS rows of least hash; covariances start from, and shrink to,
    the one of all rows. sticks: a Dirichlet process cut off after `components` pieces; unneeded ones end next to nothing.
    """
    ship(df.sparkSession)
    v = df.select(F.col(vector).cast("array<double>").alias("v"))
    with kept(v) as held:
        whole = em_round(held, "v", dim, Mixture(np.ones(1), centre(held, "v", dim)[1][None], np.eye(dim)[None]))
        first = held.orderBy(F.xxhash64("v", F.lit(seed)), "v").limit(STARTERS).toArrow().to_batches()
        x = np.concatenate([np.zeros((0, dim)), *[_matrix(b, dim, False) for b in first]])
        z = (x - whole.means[0]) / np.sqrt(np.maximum(np.diag(whole.covariances[0]), 1e-300))
        draw = np.random.default_rng(seed)
        at = [int(draw.integers(len(x)))]
        while len(at) < min(components, len(x)):
            far = np.min([((z - z[a]) ** 2).sum(axis=1) for a in at], axis=0)
            at.append(int(draw.choice(len(x), p=far / far.sum())) if far.sum() > 0 else len(at))
        k, shape = len(at), whole.covariances[0] + 1e-9 * np.eye(dim)
        now, before = Mixture(np.full(k, 1 / k), x[at], np.repeat(shape[None], k, axis=0)), -math.inf
        for _ in range(rounds):
            now = em_round(held, "v", dim, now, sticks=sticks, prior_rows=prior_rows, prior=shape)
            if abs(now.loglik - before) < close:
                order = np.argsort(-now.weights, kind="stable")
                return Mixture(now.weights[order], now.means[order], now.covariances[order], now.loglik)
            before = now.loglik
    raise RuntimeError(f"no convergence in {rounds} rounds")


def assign(df: DataFrame, vector: str, dim: int, mixture: Mixture, component: str = "component", chance: str = "chance") -> DataFrame:
    """df with each row's likeliest component and its chance, NULL for vectors of another length or with missing numbers."""
    ship(df.sparkSession)
    at = df.sparkSession.sparkContext.broadcast(mixture)

    @F.pandas_udf("component int, chance double")
    def best(vectors: pd.Series) -> pd.DataFrame:
        whole = vectors.map(lambda v: v is not None and len(v) == dim and not pd.isna(v).any()).to_numpy(dtype=bool)
        out = pd.DataFrame({"component": pd.array([None] * len(vectors), dtype="Int32"), "chance": np.nan})
        if whole.any():
            _, share = at.value.shares(np.stack(vectors[whole].to_list()).astype(float))
            out.loc[whole, "component"], out.loc[whole, "chance"] = share.argmax(axis=1), share.max(axis=1)
        return out

    found = df.withColumn("_best", best(F.col(vector).cast("array<double>")))
    return found.withColumns({component: F.col("_best.component"), chance: F.when(~F.isnan("_best.chance"), F.col("_best.chance"))}).drop("_best")


def _greatest(gain: np.ndarray) -> list[int]:
    """The column of each row of a square matrix, each once, with the greatest sum: rows come in one after another, each by the
    cheapest chain of changes among those already in."""
    n = len(gain)
    row_price, column_price, owner = np.zeros(n), np.zeros(n + 1), [-1] * (n + 1)
    for row in range(n):
        least, via, done = np.full(n + 1, np.inf), np.full(n + 1, n), np.zeros(n + 1, dtype=bool)
        owner[n], column = row, n
        while owner[column] >= 0:
            done[column] = True
            own = owner[column]
            slack = -gain[own] - row_price[own] - column_price[:n]
            better = ~done[:n] & (slack < least[:n])
            least[:n][better], via[:n][better] = slack[better], column
            nearest = int(np.argmin(np.where(done[:n], np.inf, least[:n])))
            step = least[nearest]
            for c in np.flatnonzero(done):
                row_price[owner[c]] += step
                column_price[c] -= step
            least[:n][~done[:n]] -= step
            column = nearest
        while column != n:
            owner[column] = owner[via[column]]
            column = int(via[column])
    out = [0] * n
    for c in range(n):
        out[owner[c]] = c
    return out


def match_labels(df: DataFrame, a: str, b: str) -> DataFrame:
    """a, b, n: each label of column a with the label of column b that it goes with, one to one, so that as many rows as can be
    have labels that go together; n of them have these two. Labels left over on one side have NULL for the other. Rows that miss
    a label don't count. What comes to the driver are counts of pairs of labels.
    """
    counts = df.dropna(subset=[a, b]).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).count().collect()
    left, right = sorted({r.a for r in counts}), sorted({r.b for r in counts})
    size = max(len(left), len(right))
    gain = np.zeros((size, size))
    for r in counts:
        gain[left.index(r.a), right.index(r.b)] = r["count"]
    rows = []
    for i, j in enumerate(_greatest(gain)):
        if i < len(left) or j < len(right):
            rows.append((left[i] if i < len(left) else None, right[j] if j < len(right) else None, int(gain[i, j])))
    return df.sparkSession.createDataFrame(rows, f"`{a}` {df.schema[a].dataType.simpleString()}, `{b}` {df.schema[b].dataType.simpleString()}, n long")
