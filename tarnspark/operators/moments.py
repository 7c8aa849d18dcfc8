"""Weights, means and centred products of columns: numpy in Arrow batches, merged so that values far from zero lose nothing.

Sums of uncentred products cancel where means are large beside deviations (a time stamp has 1e9 of the one and 1e5 of the
other). Here each batch is centred on its own means, and two parts are merged by their difference.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnspark.functions.shipping import ship

#: Groups that a task holds at once; the parts of others go on to the shuffle first.
HELD = 2000


@dataclass
class Moments:
    """Rows n, their weight w, weighted means, and weighted products of deviations from them.

    `low` is what a mean is above the double next to it: far from zero, parts differ by less than means can tell."""

    n: int
    w: float
    mean: np.ndarray
    low: np.ndarray
    s: np.ndarray

    @classmethod
    def none(cls, dim: int) -> Moments:
        return cls(0, 0.0, np.zeros(dim), np.zeros(dim), np.zeros((dim, dim)))

    @classmethod
    def of(cls, x: np.ndarray, w: np.ndarray | None = None) -> Moments:
        none = cls.none(x.shape[1])
        total = float(len(x)) if w is None else float(w.sum())
        if not total:
            return cls(len(x), 0.0, none.mean, none.low, none.s)
        first = x[0]
        mean = first + ((x - first).mean(axis=0) if w is None else w @ (x - first) / total)
        d = x - mean
        left = d.sum(axis=0) if w is None else w @ d
        return cls(len(x), total, mean, left / total, (d if w is None else d * w[:, None]).T @ d - np.outer(left, left) / total)

    def __add__(self, other: Moments) -> Moments:
        if not other.w or not self.w:
            one = self if self.w else other
            return Moments(self.n + other.n, one.w, one.mean, one.low, one.s)
        w = self.w + other.w
        gap = (other.mean - self.mean) + (other.low - self.low)
        step = self.low + gap * (other.w / w)
        mean = self.mean + step
        return Moments(self.n + other.n, w, mean, step - (mean - self.mean), self.s + other.s + np.outer(gap, gap) * (self.w * other.w / w))

    @property
    def gramian(self) -> np.ndarray:
        """The sums of products themselves, uncentred."""
        return self.s + self.w * np.outer(self.mean, self.mean)

    def lists(self) -> dict[str, list]:
        return {"n": [self.n], "w": [self.w], "mean": [self.mean.tolist()], "low": [self.low.tolist()], "s": [self.s.ravel().tolist()]}

    @classmethod
    def read(cls, n, w, mean, low, s) -> Moments:
        return cls(int(n), float(w), np.asarray(mean, dtype=float), np.asarray(low, dtype=float), np.asarray(s, dtype=float).reshape(len(mean), len(mean)))


_PART = "n long, w double, mean array<double>, low array<double>, s array<double>"
_KINDS = pa.schema([("n", pa.int64()), ("w", pa.float64()), *[(c, pa.list_(pa.float64())) for c in ("mean", "low", "s")]])


def moments(df: DataFrame, columns: Sequence[Column], weight: Column | None = None) -> Moments:
    """Of the columns as numbers, over rows that miss none of them (nor the weight). No rows: all zero.

    Each task merges its batches to one row; one task merges those, and one row comes to the driver.
    """
    ship(df.sparkSession)
    k, heavy = len(columns), weight is not None
    rows = df.select(*[c.cast("double").alias(f"x{i}") for i, c in enumerate(columns)], *([] if weight is None else [weight.cast("double").alias("w")])).dropna()

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Moments.none(k)
        for batch in batches:
            if batch.num_rows:
                x = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(k)])
                out += Moments.of(x, batch.column(k).to_numpy(zero_copy_only=False) if heavy else None)
        yield pa.RecordBatch.from_pydict(out.lists(), _KINDS)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Moments.none(k)
        for batch in batches:
            for part in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                out += Moments.read(*part)
        yield pa.RecordBatch.from_pydict(out.lists(), _KINDS)

    row = rows.mapInArrow(part, _PART).repartition(1).mapInArrow(merge, _PART).first()
    return Moments.read(*row)


def grouped_moments(df: DataFrame, vector: Column, dim: int, by: Sequence[str], weight: Column | None = None) -> DataFrame:
    """by, i, j, n, w, mean_i, mean_j, s for i <= j: of vectors of `dim` numbers in each group; other vectors are left out.

    Each task merges its rows by group; the parts of a group, one a task at most, meet sorted by group and are merged as
    they come, one group at a time. Group columns may not be called like the others.
    """
    taken = {"i", "j", "n", "w", "mean_i", "mean_j", "s", "_v", "_w", "mean", "low"} & {c.lower() for c in by}
    if taken:
        raise ValueError(f"rename the group columns {sorted(taken)}: the result has columns of these names")
    ship(df.sparkSession)
    keys = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in by)
    i, j = np.triu_indices(dim)
    heavy = weight is not None

    def plain(group) -> tuple:
        return tuple(None if g is None or g != g else g for g in (group if isinstance(group, tuple) else (group,)))

    def framed(held: dict[tuple, Moments]) -> Iterator[pd.DataFrame]:
        for group, m in held.items():
            yield pd.DataFrame({**{c: [g] for c, g in zip(by, group, strict=True)}, **m.lists()})

    def part(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, Moments] = {}
        for frame in frames:
            for group, rows in frame.groupby(list(by), dropna=False, sort=False) if by else [((), frame)]:
                if not len(rows):
                    continue
                x = np.stack(rows["_v"].to_list()).astype(np.float64)
                own = Moments.of(x, rows["_w"].to_numpy(dtype=float) if heavy else None)
                group = plain(group)
                held[group] = held[group] + own if group in held else own
            if len(held) > HELD:
                yield from framed(held)
                held = {}
        yield from framed(held)

    def finished(group: tuple, m: Moments) -> pd.DataFrame:
        return pd.DataFrame({**{c: [g] * len(i) for c, g in zip(by, group, strict=True)}, "i": i, "j": j, "n": m.n, "w": m.w, "mean_i": m.mean[i], "mean_j": m.mean[j], "s": m.s[i, j]})

    def merge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, sum_ = None, None
        for frame in frames:
            groups = [plain(g) for g in frame[list(by)].itertuples(index=False, name=None)] if by else [()] * len(frame)
            for group, *held in zip(groups, *[frame[c] for c in ("n", "w", "mean", "low", "s")], strict=True):
                own = Moments.read(*held)
                if sum_ is not None and group == now:
                    sum_ = sum_ + own
                else:
                    if sum_ is not None:
                        yield finished(now, sum_)
                    now, sum_ = group, own
        if sum_ is not None:
            yield finished(now, sum_)

    v = vector.cast("array<double>")
    whole = (F.size(v) == dim) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x))
    rows = df.select(*by, v.alias("_v"), *([] if weight is None else [weight.cast("double").alias("_w")])).filter(F.col("_v").isNotNull() & F.coalesce(whole, F.lit(False)))
    rows = rows if weight is None else rows.filter(F.col("_w").isNotNull() & ~F.isnan("_w"))
    parts = rows.mapInPandas(part, f"{keys}{_PART}")
    together = parts.repartition(*by).sortWithinPartitions(*by) if by else parts.repartition(1)
    return together.mapInPandas(merge, f"{keys}i int, j int, n long, w double, mean_i double, mean_j double, s double")


@dataclass
class Fit:
    """Least squares: estimates (None for terms that others before them give), the inverse of the information, and sums of squares."""

    b: np.ndarray
    inverse: np.ndarray
    told: np.ndarray
    sse: np.ndarray
    total: np.ndarray
    rank: int
    w: float


def _independent(r: np.ndarray, close: float = 1e-10) -> list[int]:
    """The columns of a matrix of products of unit diagonal that the ones before them don't give, in order."""
    factor, out = np.zeros((0, 0)), []
    for k in range(len(r)):
        v = np.linalg.solve(factor, r[out, k]) if out else np.zeros(0)
        left = r[k, k] - v @ v
        if left > close:
            wider = np.zeros((len(out) + 1, len(out) + 1))
            wider[: len(out), : len(out)], wider[len(out), : len(out)], wider[len(out), len(out)] = factor, v, np.sqrt(left)
            factor = wider
            out.append(k)
    return out


def fit(m: Moments, p: int) -> Fit:
    """The columns from p on, regressed on the first p.

    With a constant among those p, all is solved in deviations from means, in units of standard deviations; else in units
    of root mean squares. A term that the ones before it give (within 1e-10 of its variance) has no estimate (`told` is
    False), and its rank is not counted.
    """
    q = len(m.mean)
    own = np.diag(m.s)
    steady = [k for k in range(p) if own[k] <= (1e-14 * abs(m.mean[k])) ** 2 * m.w and m.mean[k]]
    one = steady[0] if steady else None
    g = m.s if one is not None else m.gramian
    size = np.sqrt(np.maximum(np.diag(g), 0.0))
    terms = [k for k in range(p) if k not in steady and size[k] > 0] if one is not None else [k for k in range(p) if size[k] > 0]
    scaled = g[np.ix_(terms, terms)] / np.outer(size[terms], size[terms])
    at = [terms[k] for k in _independent(scaled)]
    units = size[at]
    b, inverse, told = np.zeros((p, q - p)), np.zeros((p, p)), np.zeros(p, dtype=bool)
    total = np.diag(g)[p:].copy()
    sse = total.copy()
    if at:
        small = np.linalg.inv(g[np.ix_(at, at)] / np.outer(units, units))
        pull = g[np.ix_(at, range(p, q))] / units[:, None]
        slope = small @ pull
        slope += small @ (pull - (g[np.ix_(at, at)] / np.outer(units, units)) @ slope)  # what rounding left of the residual
        b[at], sse = slope / units[:, None], np.maximum(0.0, total - np.einsum("kr,kr->r", slope, pull))
        inverse[np.ix_(at, at)] = small / np.outer(units, units)
        told[at] = True
    if one is not None and m.w:
        c = m.mean[one]
        b[one] = (m.mean[p:] - b[at].T @ m.mean[at] if at else m.mean[p:]) / c
        across = -inverse @ m.mean[:p] / c
        across[one] = 0.0
        inverse[one], inverse[:, one] = across, across
        inverse[one, one] = (1 / m.w + m.mean[:p][at] @ inverse[np.ix_(at, at)] @ m.mean[:p][at]) / c**2
        told[one] = True
    return Fit(b, inverse, told, sse, total, len(at) + (one is not None), m.w)
