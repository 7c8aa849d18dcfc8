"""Structural time series: level, slope, season, regression (and so holidays), filtered and smoothed in parallel over time.

A series is cut into stretches of consecutive steps. What a stretch says of the state before it is a normal likelihood, and the
state after it is linear in the state before it; both are found without knowing that state, for all stretches at once, and
two stretches in a row join into one of the same form. So a series is not one task: tasks summarise stretches, a scan over the
summaries gives each stretch the state before it and what all later ones say of its end, and tasks then filter and smooth
their stretches with those. Arrays hold many stretches, so Python loops over a stretch's steps, not over rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnspark.functions.shipping import ship

#: Steps of a stretch, and numbers in the arrays of stretches that a task works on at once.
STRETCH, HELD = 256, 1 << 23


@dataclass(frozen=True)
class Structure:
    """What a series is made of: a level that walks; a slope that walks and moves it; a season of `season` steps, whose effects
    sum to about 0; coefficients of `predictors` numbers a row. `summed`: rows are fine steps, and y is the sum over a coarse
    period, seen on its last step only (see `nowcast`)."""

    slope: bool = False
    season: int = 0
    predictors: int = 0
    summed: bool = False

    @property
    def parts(self) -> dict[str, slice]:
        """Where each component stands in the state."""
        out, at = {}, 0
        for name, n in (("level", 1), ("slope", int(self.slope)), ("season", max(0, self.season - 1)), ("regression", self.predictors)):
            if n:
                out[name] = slice(at, at + n)
                at += n
        return out

    @property
    def walking(self) -> list[str]:
        return [c for c in ("level", "slope", "season") if c in self.parts]

    @property
    def size(self) -> int:
        return 1 + self.slope + max(0, self.season - 1) + self.predictors

    @property
    def dim(self) -> int:
        return self.size + self.summed

    def transition(self) -> np.ndarray:
        f = np.eye(self.size)
        if self.slope:
            f[0, 1] = 1.0
        if self.season > 1:
            s = self.parts["season"]
            f[s, s] = np.eye(self.season - 1, k=-1)
            f[s.start, s] = -1.0
        return f

    def loads(self) -> np.ndarray:
        """Which state each walking component's step goes into."""
        g = np.zeros((self.size, len(self.walking)))
        for k, c in enumerate(self.walking):
            g[self.parts[c].start, k] = 1.0
        return g

    def signal(self, x: np.ndarray) -> np.ndarray:
        """The row of the observation, for arrays of predictors (..., predictors)."""
        h = np.zeros((*x.shape[:-1], self.size))
        h[..., 0] = 1.0
        if self.season > 1:
            h[..., self.parts["season"].start] = 1.0
        if self.predictors:
            h[..., self.parts["regression"]] = x
        return h


@dataclass(frozen=True)
class Model:
    """A structure with its variances (`noise` and one for each walking component) and the prior of the state one step before
    a series' first row: independent normal numbers of these means and variances."""

    structure: Structure
    variances: dict[str, float]
    mean: tuple[float, ...]
    spread: tuple[float, ...]
    loglik: float = field(default=math.nan, compare=False)

    def prior(self) -> tuple[np.ndarray, np.ndarray]:
        extra = [0.0] * self.structure.summed
        return np.array([*self.mean, *extra]), np.diag([*self.spread, *extra])


class _Steps:
    """The steps of many stretches, longest first, so that those which reach step t are the first ones."""

    def __init__(self, model: Model, packed: pd.DataFrame):
        s = model.structure
        n = packed["y"].map(len).to_numpy()
        self.order = np.argsort(-n, kind="stable")
        self.n = n[self.order]
        count, length = len(n), int(self.n.max(initial=0))
        self.length, self.active = length, np.searchsorted(-self.n, -np.arange(length), side="left")
        self.y = np.full((count, length), np.nan)
        x = np.zeros((count, length, s.predictors))
        self.new = np.zeros((count, length), dtype=bool)
        for row, k in enumerate(self.order):
            self.y[row, : n[k]] = np.asarray(packed["y"].iloc[k], dtype=float)
            if s.predictors:
                x[row, : n[k]] = np.asarray(packed["x"].iloc[k], dtype=float).reshape(n[k], s.predictors)
            if s.summed:
                self.new[row, : n[k]] = np.asarray(packed["new"].iloc[k], dtype=bool)
        self.model, self.h = model, s.signal(x)
        self.f, self.g = s.transition(), s.loads()
        self.q = np.array([model.variances[c] for c in s.walking])
        self.r = model.variances["noise"]

    def into(self, t: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The transition into step t of the first k stretches, and how the walking components' steps load on the state."""
        s = self.model.structure
        if not s.summed:
            return self.f, self.g
        f, g = np.zeros((k, s.dim, s.dim)), np.zeros((k, s.dim, len(self.q)))
        f[:, :-1, :-1], g[:, :-1] = self.f, self.g
        f[:, -1, :-1], g[:, -1] = self.h[:k, t] @ self.f, self.h[:k, t] @ self.g
        f[:, -1, -1] = ~self.new[:k, t]
        return f, g

    def seen(self, t: int, k: int) -> np.ndarray:
        s = self.model.structure
        if not s.summed:
            return self.h[:k, t]
        h = np.zeros((k, s.dim))
        h[:, -1] = 1.0
        return h


def _t(m: np.ndarray) -> np.ndarray:
    return np.swapaxes(m, -1, -2)


def _times(m: np.ndarray, v: np.ndarray) -> np.ndarray:
    return (m @ v[..., None])[..., 0]


def _outer(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a[..., :, None] * b[..., None, :]


def _summaries(steps: _Steps) -> dict[str, np.ndarray]:
    """Of each stretch, given the state x before it: its end is normal about a @ x + b with variance c, and the log likelihood
    of its rows is const + eta @ x - x @ j @ x / 2."""
    count, d = len(steps.n), steps.model.structure.dim
    a, b, c = np.broadcast_to(np.eye(d), (count, d, d)).copy(), np.zeros((count, d)), np.zeros((count, d, d))
    eta, j, const = np.zeros((count, d)), np.zeros((count, d, d)), np.zeros(count)
    for t in range(steps.length):
        k = int(steps.active[t])
        f, g = steps.into(t, k)
        a[:k], b[:k] = f @ a[:k], _times(f, b[:k])
        c[:k] = f @ c[:k] @ _t(f) + (g * steps.q) @ _t(g)
        h, y = steps.seen(t, k), steps.y[:k, t]
        there = ~np.isnan(y)
        ha, ch = (h[:, None, :] @ a[:k])[:, 0], _times(c[:k], h)
        s = (h * ch).sum(axis=1) + steps.r
        e = np.where(there, y - (h * b[:k]).sum(axis=1), 0.0)
        w = there / s
        j[:k] += _outer(ha, ha) * w[:, None, None]
        eta[:k] += ha * (w * e)[:, None]
        const[:k] -= 0.5 * np.where(there, np.log(2 * np.pi * s) + e * e / s, 0.0)
        gain = ch * w[:, None]
        a[:k] -= _outer(gain, ha)
        b[:k] += gain * e[:, None]
        c[:k] -= _outer(gain, ch)
        c[:k] = (c[:k] + _t(c[:k])) / 2
    return {"a": a, "b": b, "c": c, "eta": eta, "j": j, "const": const}


def _conditioned(m: np.ndarray, p: np.ndarray, eta: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Mean and variance of a normal state given a likelihood, and the log of that likelihood's mean (without its constant)."""
    left = np.eye(len(m)) + p @ j
    v = np.linalg.solve(left, p)
    lean = eta - j @ m
    return m + v @ lean, (v + v.T) / 2, -0.5 * np.linalg.slogdet(left)[1] + float(eta @ m - 0.5 * m @ j @ m + 0.5 * lean @ v @ lean)


def _scan(model: Model, rows: pd.DataFrame) -> pd.DataFrame:
    """A series' summaries in order of time -> for each stretch the state before it (m, p), the slope and curvature (rho, nu) that
    later stretches put on its end, and (on the first one) the log likelihood of the whole series. On the last: its end (mf, pf)."""
    d = model.structure.dim
    shape = {"a": (d, d), "b": (d,), "c": (d, d), "eta": (d,), "j": (d, d)}
    own = [{c: np.asarray(r[c], dtype=float).reshape(s) for c, s in shape.items()} | {"const": r["const"]} for _, r in rows.iterrows()]
    m, p = model.prior()
    before, after, loglik = [], [], 0.0
    for s in own:
        before.append((m, p))
        mean, variance, gained = _conditioned(m, p, s["eta"], s["j"])
        loglik += s["const"] + gained
        m, p = s["a"] @ mean + s["b"], s["a"] @ variance @ s["a"].T + s["c"]
        after.append((m, p))
    eta, j = np.zeros(d), np.zeros((d, d))
    late = []
    for s, (m, p) in zip(own[::-1], after[::-1], strict=True):
        left = np.linalg.inv(np.eye(d) + j @ p)
        late.append((left @ (eta - j @ m), left @ j))
        left = np.linalg.inv(np.eye(d) + j @ s["c"])
        eta, j = s["eta"] + s["a"].T @ left @ (eta - j @ s["b"]), s["j"] + s["a"].T @ left @ j @ s["a"]
    flat = lambda pairs, k: [np.ravel(x[k]).tolist() for x in pairs]
    late = late[::-1]
    out = {"m": flat(before, 0), "p": flat(before, 1), "rho": flat(late, 0), "nu": flat(late, 1), "loglik": [loglik, *[0.0] * (len(own) - 1)]}
    out |= {"mf": [None] * (len(own) - 1) + [after[-1][0].tolist()], "pf": [None] * (len(own) - 1) + [after[-1][1].ravel().tolist()]}
    return pd.DataFrame(out)


def _through(steps: _Steps, start: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Filter and smoother of stretches whose surroundings are known. Of each row: prediction and its variance, smoothed states
    and their variances' diagonal; of each stretch: what the likelihood's slope along each variance is made of."""
    s = steps.model.structure
    count, d, length = len(steps.n), s.dim, steps.length
    m, p = start["m"].copy(), start["p"].copy()
    means, spreads = np.zeros((length, count, d)), np.zeros((length, count, d, d))
    gains, pulls = np.zeros((length, count, d)), np.zeros((length, count))
    weights, predicted, variance = np.zeros((length, count)), np.full((length, count), np.nan), np.full((length, count), np.nan)
    for t in range(length):
        k = int(steps.active[t])
        f, g = steps.into(t, k)
        m[:k], p[:k] = _times(f, m[:k]), f @ p[:k] @ _t(f) + (g * steps.q) @ _t(g)
        means[t, :k], spreads[t, :k] = m[:k], p[:k]
        h, y = steps.seen(t, k), steps.y[:k, t]
        there = ~np.isnan(y)
        ph = _times(p[:k], h)
        predicted[t, :k], variance[t, :k] = (h * m[:k]).sum(axis=1), (h * ph).sum(axis=1) + steps.r
        w = there / variance[t, :k]
        e = np.where(there, y - predicted[t, :k], 0.0)
        gains[t, :k], pulls[t, :k], weights[t, :k] = ph * w[:, None], w * e, w
        m[:k] += gains[t, :k] * e[:, None]
        p[:k] -= _outer(gains[t, :k], ph)
        p[:k] = (p[:k] + _t(p[:k])) / 2
    rho, nu = start["rho"].copy(), start["nu"].copy()
    states, doubts = np.full((length, count, d), np.nan), np.full((length, count, d), np.nan)
    noise, walked = np.zeros(count), np.zeros((count, len(steps.q)))
    for t in range(length - 1, -1, -1):
        k = int(steps.active[t])
        h, there = steps.seen(t, k), weights[t, :k] > 0
        gain = gains[t, :k]
        u = pulls[t, :k] - np.where(there, (gain * rho[:k]).sum(axis=1), 0.0)
        ng = _times(nu[:k], gain)
        big = weights[t, :k] + (gain * ng).sum(axis=1)
        noise[:k] += np.where(there, u * u - big, 0.0)
        rho[:k] += h * u[:, None]
        nu[:k] += _outer(h, h) * big[:, None, None] - _outer(h, ng) - _outer(ng, h)
        states[t, :k] = means[t, :k] + _times(spreads[t, :k], rho[:k])
        doubts[t, :k] = np.einsum("kii->ki", spreads[t, :k] - spreads[t, :k] @ nu[:k] @ spreads[t, :k])
        f, g = steps.into(t, k)
        walked[:k] += _times(_t(g), rho[:k]) ** 2 - np.einsum("...ii->...i", _t(g) @ nu[:k] @ g)
        rho[:k], nu[:k] = _times(_t(f), rho[:k]), _t(f) @ nu[:k] @ f
    return {"predicted": predicted, "variance": variance, "states": states, "doubts": doubts, "noise": noise, "walked": walked}


def _key(by: Sequence[str]):
    return F.to_json(F.struct(*by), {"ignoreNullFields": "false"}) if by else F.lit("")


def packed(df: DataFrame, y: str, time: str, by: Sequence[str], predictors: Sequence[str] = (), new: str | None = None, stretch: int = STRETCH) -> DataFrame:
    """One row a stretch: _key (of the series), _stretch, by, t, y, x (row after row) and new, in order of time.

    time: whole numbers, one row for each step from a series' first to its last (a missing y is NULL); others raise.
    """
    ship(df.sparkSession)
    t = F.col(time).cast("bigint")
    held = df.select(_key(by).alias("_key"), *by, t.alias("_t"), F.col(y).cast("double").alias("_y"), F.array(*[F.col(c).cast("double") for c in predictors]).cast("array<double>").alias("_x"), (F.lit(False) if new is None else F.coalesce(F.col(new).cast("boolean"), F.lit(False))).alias("_new"))
    odd = held.groupBy("_key").agg((F.count("*") != F.max("_t") - F.min("_t") + 1).alias("gap"), (F.count_distinct("_t") != F.count("*")).alias("twice"), F.max(F.col("_t").isNull() | F.exists("_x", lambda v: v.isNull() | F.isnan(v))).alias("none"))
    found = odd.agg(F.count_if(F.col("gap") | F.col("twice")), F.count_if("none")).first()
    if found[1]:
        raise ValueError(f"{found[1]} series miss a time or a predictor")
    if found[0]:
        raise ValueError(f"{found[0]} series have steps without a row, or several rows for a step: make them regular first")
    rows = held.groupBy("_key", *by, F.floor(F.col("_t") / F.lit(stretch)).alias("_stretch")).agg(F.sort_array(F.collect_list(F.struct("_t", "_y", "_x", "_new"))).alias("_r"))
    return rows.select("_key", *by, "_stretch", F.col("_r._t").alias("t"), F.transform("_r._y", lambda v: F.coalesce(v, F.lit(float("nan")))).alias("y"), F.flatten("_r._x").alias("x"), F.col("_r._new").alias("new"))


def _few(frames: Iterator[pd.DataFrame], d: int) -> Iterator[pd.DataFrame]:
    """Frames of packed stretches in parts whose arrays of d x d numbers a step hold HELD numbers or so."""
    for frame in frames:
        size = frame["y"].map(len).cumsum().to_numpy() * d * d // HELD
        for _, part in frame.groupby(size, sort=False):
            yield part


_SUMMARY = "_key string, _stretch long, a array<double>, b array<double>, c array<double>, eta array<double>, j array<double>, const double"
_AROUND = "_key string, _stretch long, m array<double>, p array<double>, rho array<double>, nu array<double>, loglik double, mf array<double>, pf array<double>"


def _around(stretches: DataFrame, model: Model) -> DataFrame:
    """_key, _stretch and what `_scan` finds. A series' summaries, of 3 d x d numbers a stretch, meet in one task."""
    d = model.structure.dim

    def summarise(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in _few(frames, d):
            steps = _Steps(model, part)
            found = _summaries(steps)
            yield pd.DataFrame({"_key": part["_key"].to_numpy()[steps.order], "_stretch": part["_stretch"].to_numpy()[steps.order], **{c: [np.ravel(v).tolist() for v in found[c]] for c in ("a", "b", "c", "eta", "j")}, "const": found["const"]})

    def scan(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_stretch")
        found = _scan(model, rows)
        return pd.concat([rows[["_key", "_stretch"]].reset_index(drop=True), found], axis=1)

    return stretches.drop("t").mapInPandas(summarise, _SUMMARY).groupBy("_key").applyInPandas(scan, _AROUND)


def _joined(stretches: DataFrame, model: Model) -> DataFrame:
    return stretches.join(_around(stretches, model).drop("mf", "pf"), ["_key", "_stretch"])


def _start(part: pd.DataFrame, steps: _Steps, d: int) -> dict[str, np.ndarray]:
    shape = {"m": (d,), "p": (d, d), "rho": (d,), "nu": (d, d)}
    return {c: np.stack([np.asarray(part[c].iloc[k], dtype=float).reshape(s) for k in steps.order]) for c, s in shape.items()}


def rows_of(stretches: DataFrame, model: Model, by: Sequence[str]) -> DataFrame:
    """by, t, y, predicted and predicted_sd (from all rows before), and of all rows: level, slope, season, regression (those of
    the structure), fitted and level_sd."""
    s, d = model.structure, model.structure.dim
    parts = [c for c in s.parts]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in _few(frames, d):
            steps = _Steps(model, part)
            got = _through(steps, _start(part, steps, d))
            there = np.arange(steps.length)[None, :] < steps.n[:, None]
            pick = lambda a: np.swapaxes(a, 0, 1)[there]
            states = pick(got["states"])
            out = {c: np.repeat(part[c].to_numpy()[steps.order], steps.n) for c in by}
            out["t"] = np.concatenate([np.asarray(part["t"].iloc[k]) for k in steps.order])
            out |= {"y": steps.y[there], "predicted": pick(got["predicted"]), "predicted_sd": np.sqrt(pick(got["variance"]))}
            signal = steps.h[there]
            for c in parts:
                at = s.parts[c]
                out[c] = (states[:, at] * signal[:, at]).sum(axis=1) if c == "regression" else states[:, at.start]
            out["fitted"] = (states[:, : s.size] * signal).sum(axis=1)
            out["level_sd"] = np.sqrt(np.maximum(0.0, pick(got["doubts"])[:, 0]))
            yield pd.DataFrame(out)

    keys = "".join(f"`{c}` {stretches.schema[c].dataType.simpleString()}, " for c in by)
    found = _joined(stretches, model).mapInPandas(run, f"{keys}t long, y double, predicted double, predicted_sd double, {''.join(f'{c} double, ' for c in parts)}fitted double, level_sd double")
    return found.withColumn("y", F.when(~F.isnan("y"), F.col("y")))


def _sums(stretches: DataFrame, model: Model) -> tuple[float, np.ndarray, float, int, int]:
    """Log likelihood, what the walking components' and the noise's variances lean to, rows, and rows with y."""
    d, names = model.structure.dim, model.structure.walking

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in _few(frames, d):
            steps = _Steps(model, part)
            got = _through(steps, _start(part, steps, d))
            yield pd.DataFrame({"loglik": [part["loglik"].sum()], "noise": [got["noise"].sum()], "n": [int(steps.n.sum())], "seen": [int((~np.isnan(steps.y)).sum())], **{c: [v] for c, v in zip(names, got["walked"].sum(axis=0), strict=True)}})

    found = _joined(stretches, model).mapInPandas(run, "loglik double, noise double, n long, seen long" + "".join(f", {c} double" for c in names))
    row = found.agg(*[F.sum(c).alias(c) for c in found.columns]).first()
    return row.loglik, np.array([row[c] for c in names]), row.noise, row.n, row.seen


@contextmanager
def _held(stretches: DataFrame):
    kept = stretches.persist()
    try:
        yield kept
    finally:
        kept.unpersist()


def default_model(stretches: DataFrame, structure: Structure) -> Model:
    """Where a fit starts: the variance of y is shared out, and the prior is wide on its scale."""
    each = stretches.select(F.explode("y").alias("y")).filter(~F.isnan("y"))
    mean, var = each.agg(F.avg("y"), F.var_samp("y")).first()
    if mean is None:
        raise ValueError("no row has a value")
    var = var or 1.0
    level = 0.0 if structure.summed else mean
    return Model(structure, {"noise": 0.5 * var, **{c: 0.1 * var if c == "level" else 0.01 * var for c in structure.walking}}, (level, *[0.0] * (structure.size - 1)), tuple([100.0 * var + 10.0 * mean * mean] * structure.size))


def _climb(at, x: np.ndarray, close: float, rounds: int) -> tuple[np.ndarray, float]:
    """The x where `at` (its value and slope) is greatest, from here uphill: steps by the slopes met so far, cut in half until
    they gain enough. Ends once two steps gain less than `close` together; raises after so many evaluations."""
    value, slope = at(x)
    curve, used = np.eye(len(x)) / max(float(np.abs(slope).max()), 1e-12), 1
    gains = [math.inf, math.inf]
    while sum(gains[-2:]) >= close:
        step = curve @ slope
        step = step * min(1.0, 3.0 / max(float(np.abs(step).max()), 1e-300))
        while True:
            new, new_slope = at(x + step)
            used += 1
            if new >= value + 1e-4 * slope @ step or np.abs(step).max() < 1e-6:
                break
            step = step / 2
        bend = slope - new_slope
        if step @ bend > 1e-14:
            turn = np.eye(len(x)) - np.outer(step, bend) / (step @ bend)
            curve = turn @ curve @ turn.T + np.outer(step, step) / (step @ bend)
        gains.append(max(0.0, new - value))
        if new >= value:
            x, value, slope = x + step, new, new_slope
        if used > rounds:
            raise RuntimeError(f"no convergence in {rounds} evaluations")
    return x, value


def fit(stretches: DataFrame, structure: Structure, start: Model | None = None, close: float = 1e-8, rounds: int = 200) -> Model:
    """The variances of greatest likelihood, shared by all series of the table.

    An evaluation is one job over the stretches, which stay on the executors; it brings the likelihood and its slope along
    each variance's logarithm to the driver: what expectation and maximisation would sum. A variance may end next to nothing.
    """
    with _held(stretches) as held:
        model = start or default_model(held, structure)
        names = ["noise", *structure.walking]

        def model_at(x: np.ndarray) -> Model:
            return Model(structure, dict(zip(names, np.exp(np.maximum(x, -700.0)).tolist(), strict=True)), model.mean, model.spread)

        def at(x: np.ndarray) -> tuple[float, np.ndarray]:
            total, walked, noise, _, seen = _sums(held, model_at(x))
            return total / max(seen, 1), 0.5 * np.exp(x) * np.array([noise, *walked]) / max(seen, 1)

        x, value = _climb(at, np.log([max(model.variances[c], 1e-12) for c in names]), close, rounds)
        out = model_at(x)
        return Model(structure, out.variances, out.mean, out.spread, value * _sums(held, out)[4])


def loglik(stretches: DataFrame, model: Model) -> float:
    return _around(stretches, model).agg(F.sum("loglik")).first()[0]


def forecast(stretches: DataFrame, model: Model, by: Sequence[str], steps: int, future: DataFrame | None = None, time: str = "t", predictors: Sequence[str] = ()) -> DataFrame:
    """by, t, mean, sd of the next `steps` values of each series. future: by, time and the predictors of those steps, where the
    structure has some; a step without them has no row."""
    s = model.structure
    if s.summed:
        raise ValueError("a summed structure has no step of its own to forecast: see nowcast")
    last = stretches.groupBy("_key", *by).agg(F.max(F.element_at("t", -1)).alias("_last"))
    ends = last.join(_around(stretches, model).filter("mf IS NOT NULL").select("_key", "mf", "pf"), "_key")
    ahead = ends.select("_key", *by, "_last", "mf", "pf", F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("_ahead")).withColumn("t", F.col("_last") + F.col("_ahead"))
    if s.predictors:
        known = future.select(_key(by).alias("_key"), F.col(time).cast("bigint").alias("t"), F.array(*[F.col(c).cast("double") for c in predictors]).alias("x"))
        ahead = ahead.join(known, ["_key", "t"])
    else:
        ahead = ahead.withColumn("x", F.array().cast("array<double>"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f, g = s.transition(), s.loads()
        q = (g * np.array([model.variances[c] for c in s.walking])) @ g.T
        powers, noises = [np.eye(s.size)], [np.zeros((s.size, s.size))]
        for _ in range(steps):
            powers.append(f @ powers[-1])
            noises.append(f @ noises[-1] @ f.T + q)
        for frame in frames:
            if not len(frame):
                continue
            m = np.stack([np.asarray(v, dtype=float) for v in frame["mf"]])
            p = np.stack([np.asarray(v, dtype=float).reshape(s.size, s.size) for v in frame["pf"]])
            h = s.signal(np.stack([np.asarray(v, dtype=float).reshape(s.predictors) for v in frame["x"]]))
            k = frame["_ahead"].to_numpy()
            go, more = np.stack(powers)[k], np.stack(noises)[k]
            spread = go @ p @ _t(go) + more
            yield pd.DataFrame({**{c: frame[c].to_numpy() for c in by}, "t": frame["t"].to_numpy(), "mean": (h * _times(go, m)).sum(axis=1), "sd": np.sqrt((h * _times(spread, h)).sum(axis=1) + model.variances["noise"])})

    keys = "".join(f"`{c}` {stretches.schema[c].dataType.simpleString()}, " for c in by)
    return ahead.mapInPandas(run, f"{keys}t long, mean double, sd double")


def holdout_errors(stretches: DataFrame, model: Model, by: Sequence[str], after: int) -> DataFrame:
    """by, t, error, scaled (by its standard deviation) of the one-step predictions of the rows after a step; the model is
    that of the rows up to it, fitted before."""
    rows = rows_of(stretches, model, by).filter((F.col("t") > after) & F.col("y").isNotNull())
    error = F.col("y") - F.col("predicted")
    return rows.select(*by, "t", error.alias("error"), (error / F.col("predicted_sd")).alias("scaled"))


def nowcast(stretches: DataFrame, model: Model, by: Sequence[str]) -> DataFrame:
    """by, t, level, slope, season, regression, fitted of each fine step, where y is a sum over coarse periods (`summed`), NULL
    but on a period's last step; `new` marks the first step of each. `predicted` is what the period has come to so far."""
    if not model.structure.summed:
        raise ValueError("the structure is not summed")
    return rows_of(stretches, model, by)
