"""Structural series against the joint normal distribution of all their values, whatever the stretches they are cut into."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnspark.operators import structural as T


def joint(structure, variances, mean, spread, x, new=None):
    """Mean and covariance of (all states, all signals) and the covariance of observations' noise, built from the equations."""
    n, d = len(x), structure.dim
    f0, g0, h = structure.transition(), structure.loads(), structure.signal(x)
    q = np.array([variances[c] for c in structure.walking])
    m = np.zeros(d)
    m[: structure.size] = mean
    p = np.zeros((d, d))
    p[: structure.size, : structure.size] = np.diag(spread)
    means, rows, noises = [], [], []
    carry, root = m, np.eye(d)
    for t in range(n):
        f, g = np.zeros((d, d)), np.zeros((d, len(q)))
        f[: structure.size, : structure.size], g[: structure.size] = f0, g0
        if structure.summed:
            f[-1, :-1], g[-1], f[-1, -1] = h[t] @ f0, h[t] @ g0, 0.0 if new[t] else 1.0
        carry, root = f @ carry, f @ root
        noises = [f @ k for k in noises] + [g * np.sqrt(q)]
        means.append(carry)
        rows.append((root, list(noises)))
    wide = np.zeros((n * d, d + n * len(q)))
    for t, (root, parts) in enumerate(rows):
        wide[t * d : t * d + d, :d] = root @ np.sqrt(p)
        for k, part in enumerate(parts):
            wide[t * d : t * d + d, d + k * len(q) : d + (k + 1) * len(q)] = part
    see = np.zeros((n, n * d))
    for t in range(n):
        if structure.summed:
            see[t, t * d + d - 1] = 1.0
        else:
            see[t, t * d : t * d + d] = h[t]
    return np.concatenate(means), wide @ wide.T, see


def dense(structure, variances, mean, spread, x, y, new=None):
    """log likelihood; smoothed states and their variances; each row's prediction from the rows before it and its variance."""
    m, cov, see = joint(structure, variances, mean, spread, x, new)
    total = see @ cov @ see.T + variances["noise"] * np.eye(len(y))
    there = ~np.isnan(y)
    e = y[there] - (see @ m)[there]
    v = total[np.ix_(there, there)]
    loglik = -0.5 * (len(e) * np.log(2 * np.pi) + np.linalg.slogdet(v)[1] + e @ np.linalg.solve(v, e))
    cross = (cov @ see.T)[:, there]
    smooth, doubt = m + cross @ np.linalg.solve(v, e), np.diag(cov - cross @ np.linalg.solve(v, cross.T))
    predicted, spread_ = [], []
    for t in range(len(y)):
        old = np.flatnonzero(there[:t])
        w = np.linalg.solve(total[np.ix_(old, old)], total[old, t]) if len(old) else np.zeros(0)
        predicted.append((see @ m)[t] + w @ (y[old] - (see @ m)[old]))
        spread_.append(total[t, t] - w @ total[old, t])
    return loglik, smooth.reshape(len(y), -1), doubt.reshape(len(y), -1), np.array(predicted), np.sqrt(spread_)


def series(rng, n, structure, missing=0.15):
    x = rng.normal(size=(n, structure.predictors))
    y = 3 + np.cumsum(rng.normal(0, 0.4, n)) + 2 * np.sin(np.arange(n) * 2 * np.pi / 4) + (x @ [1.5, -1.0] if structure.predictors else 0.0) + rng.normal(0, 0.7, n)
    y[rng.random(n) < missing] = np.nan
    return x, y


def table(spark, data, first=5):
    rows = [(g, first + t, None if np.isnan(v) else float(v), *map(float, r)) for g, (x, y) in data.items() for t, (r, v) in enumerate(zip(x, y))]
    names = [f"x{k}" for k in range(next(iter(data.values()))[0].shape[1])]
    return spark.createDataFrame(rows, "g int, t long, y double" + "".join(f", {c} double" for c in names)).repartition(4), names


FULL = T.Structure(slope=True, season=4, predictors=2)


def test_rows_equal_the_joint_distribution(spark):
    rng = np.random.default_rng(1)
    data = {1: series(rng, 45, FULL), 2: series(rng, 9, FULL), None: series(rng, 1, FULL)}
    df, names = table(spark, data)
    variances = {"noise": 0.5, "level": 0.2, "slope": 0.01, "season": 0.03}
    model = T.Model(FULL, variances, (1.0, *[0.0] * 6), (4.0, 1.0, *[2.0] * 3, 3.0, 3.0))
    for stretch in (7, 1000):
        stretches = T.packed(df, "y", "t", ["g"], names, stretch=stretch)
        if stretch == 7:
            assert stretches.filter("g = 1").count() == 8  # 45 steps from step 5
        want = {g: dense(FULL, variances, model.mean, model.spread, x, y) for g, (x, y) in data.items()}
        assert np.isclose(T.loglik(stretches, model), sum(w[0] for w in want.values()), rtol=1e-10)
        got = {}
        for r in T.rows_of(stretches, model, ["g"]).collect():
            got.setdefault(r.g, []).append(r)
        for g, (x, y) in data.items():
            own = sorted(got[g], key=lambda r: r.t)
            loglik, smooth, doubt, predicted, spread = want[g]
            assert [r.t for r in own] == list(range(5, 5 + len(y))) and [r.y is None for r in own] == np.isnan(y).tolist()
            assert np.allclose([r.predicted for r in own], predicted, atol=1e-8) and np.allclose([r.predicted_sd for r in own], spread, atol=1e-8)
            for c, k in (("level", 0), ("slope", 1), ("season", 2)):
                assert np.allclose([r[c] for r in own], smooth[:, k], atol=1e-8)
            assert np.allclose([r.regression for r in own], (smooth[:, 5:] * x).sum(axis=1), atol=1e-8)
            assert np.allclose([r.level_sd for r in own], np.sqrt(doubt[:, 0]), atol=1e-8)


def test_forecast_and_holdout(spark):
    rng = np.random.default_rng(2)
    data = {1: series(rng, 50, FULL), 2: series(rng, 30, FULL)}
    df, names = table(spark, data, first=0)
    variances = {"noise": 0.5, "level": 0.2, "slope": 0.01, "season": 0.03}
    model = T.Model(FULL, variances, (1.0, *[0.0] * 6), (4.0, 1.0, *[2.0] * 3, 3.0, 3.0))
    early = T.packed(df.filter("t < 24"), "y", "t", ["g"], names, stretch=5)
    ahead = {(r.g, r.t): r for r in T.forecast(early, model, ["g"], 6, df.filter("t >= 24"), "t", names).collect()}
    assert len(ahead) == 12
    for g, (x, y) in data.items():
        y = np.append(y[:24], [np.nan] * 6)
        m, cov, see = joint(FULL, variances, model.mean, model.spread, x[:30])
        there = ~np.isnan(y)
        total = see @ cov @ see.T + 0.5 * np.eye(30)
        w = np.linalg.solve(total[np.ix_(there, there)], total[there][:, 24:])
        assert np.allclose([ahead[g, t].mean for t in range(24, 30)], (see @ m)[24:] + w.T @ (y[there] - (see @ m)[there]), atol=1e-8)
        assert np.allclose([ahead[g, t].sd for t in range(24, 30)], np.sqrt(np.diag(total[24:, 24:] - total[24:][:, there] @ w)), atol=1e-8)
    whole = T.packed(df, "y", "t", ["g"], names, stretch=5)
    errors = {(r.g, r.t): r for r in T.holdout_errors(whole, model, ["g"], 23).collect()}
    _, _, _, predicted, spread = dense(FULL, variances, model.mean, model.spread, *data[1])
    y = data[1][1]
    for t in range(24, 50):
        assert ((1, t) in errors) == (not np.isnan(y[t]))
        if not np.isnan(y[t]):
            assert np.isclose(errors[1, t].error, y[t] - predicted[t], atol=1e-8) and np.isclose(errors[1, t].scaled, (y[t] - predicted[t]) / spread[t], atol=1e-8)


def test_fit_ends_where_the_likelihood_is_flat(spark):
    rng = np.random.default_rng(3)
    s = T.Structure(season=4)
    x, y = series(rng, 160, T.Structure(), 0.1)
    df, _ = table(spark, {1: (x, y)})
    stretches = T.packed(df, "y", "t", ["g"], stretch=20)
    model = T.fit(stretches, s)
    at = lambda k, e: dense(s, {c: v * (1 + e) if c == k else v for c, v in model.variances.items()}, model.mean, model.spread, x, y)[0]
    assert np.isclose(model.loglik, at("", 0.0), rtol=1e-9)
    for c, v in model.variances.items():
        slope = (at(c, 1e-3) - at(c, -1e-3)) / 2e-3
        assert abs(slope) < 0.02 or v < 1e-4 * model.variances["noise"], (c, v, slope)  # a variance may end at nothing


def test_sums_of_coarse_periods(spark):
    """Weeks (fine) are seen only as sums over months (coarse), with a predictor that is known for each week."""
    rng = np.random.default_rng(4)
    s = T.Structure(slope=True, predictors=1, summed=True)
    n = 40
    x = rng.normal(size=(n, 1))
    week = 10 + np.cumsum(rng.normal(0, 0.3, n)) + 2 * x[:, 0]
    ends = [3, 8, 12, 17, 21, 25, 30, 34]
    new = np.zeros(n, dtype=bool)
    new[[0, *[e + 1 for e in ends]]] = True
    y, start = np.full(n, np.nan), 0
    for e in ends:
        y[e], start = week[start : e + 1].sum() + rng.normal(0, 0.1), e + 1
    rows = [(t, None if np.isnan(y[t]) else float(y[t]), float(x[t, 0]), bool(new[t])) for t in range(n)]
    df = spark.createDataFrame(rows, "t long, y double, x double, new boolean").repartition(3)
    variances = {"noise": 0.01, "level": 0.09, "slope": 0.001}
    model = T.Model(s, variances, (8.0, 0.0, 0.0), (25.0, 1.0, 4.0))
    for stretch in (6, 100):
        stretches = T.packed(df, "y", "t", [], ["x"], new="new", stretch=stretch)
        loglik, smooth, _, predicted, spread = dense(s, variances, model.mean, model.spread, x, y, new)
        assert np.isclose(T.loglik(stretches, model), loglik, rtol=1e-9)
        got = sorted(T.nowcast(stretches, model, []).collect(), key=lambda r: r.t)
        assert np.allclose([r.level for r in got], smooth[:, 0], atol=1e-7)
        assert np.allclose([r.fitted for r in got], smooth[:, 0] + smooth[:, 2] * x[:, 0], atol=1e-7)
        assert np.allclose([r.predicted for r in got], predicted, atol=1e-7) and np.allclose([r.predicted_sd for r in got], spread, atol=1e-7)
        # the weeks of a period add up to what was seen of it, but for noise
        assert abs(sum(r.fitted for r in got[9:13]) - y[12]) < 0.5


def test_odd_series(spark):
    df = spark.createDataFrame([(1, 0, 1.0), (1, 2, 2.0)], "g int, t long, y double")
    with pytest.raises(ValueError, match="without a row"):
        T.packed(df, "y", "t", ["g"])
    with pytest.raises(ValueError, match="without a row"):
        T.packed(df.union(spark.createDataFrame([(1, 0, 1.0)], "g int, t long, y double")), "y", "t", ["g"])
    with pytest.raises(ValueError, match="miss a time"):
        T.packed(df.withColumn("t", F.lit(None).cast("long")), "y", "t", ["g"])
    empty = T.packed(df.limit(0), "y", "t", ["g"])
    assert empty.count() == 0
    with pytest.raises(ValueError, match="no row"):
        T.default_model(empty, T.Structure())
    blank = T.packed(df.withColumn("t", F.col("t") / 2).withColumn("y", F.lit(None).cast("double")), "y", "t", ["g"])
    assert T.loglik(blank, T.Model(T.Structure(), {"noise": 1.0, "level": 1.0}, (0.0,), (1.0,))) == 0.0
