"""Models with unseen parts against numpy: likelihoods that have to be flat where the fits end, enumeration, known values."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnspark.functions import mathx, ordered
from tarnspark.operators import aggregate, latent, sufficient


def slope(f, b, h=1e-5):
    return np.array([(f(b + h * e) - f(b - h * e)) / (2 * h) for e in np.eye(len(b))])


def test_factors(spark):
    rng = np.random.default_rng(1)
    load = np.array([[0.9, 0], [0.8, 0.3], [0.7, 0], [0, 0.8], [0.2, 0.7], [0.1, 0.6]])
    x = rng.normal(size=(800, 2)) @ load.T + rng.normal(size=(800, 6)) * np.sqrt(1 - (load**2).sum(axis=1))
    got = latent.factor_analysis(spark.createDataFrame([([float(v) for v in r],) for r in x], "x array<double>").repartition(3), "x", 6, 2, close=1e-12).collect()
    b, u = np.zeros((6, 2)), np.zeros(6)
    for r in got:
        b[r.variable, r.factor], u[r.variable] = r.loading, r.uniqueness
    s = np.corrcoef(x.T)

    def loglik(t):
        c = t[:12].reshape(6, 2) @ t[:12].reshape(6, 2).T + np.diag(t[12:])
        return -0.5 * (np.linalg.slogdet(c)[1] + np.trace(np.linalg.solve(c, s)))

    assert np.abs(slope(loglik, np.append(b.ravel(), u))).max() < 1e-3
    assert np.abs(b @ b.T + np.diag(u) - load @ load.T - np.diag(1 - (load**2).sum(axis=1))).max() < 0.15
    assert abs(((b.T / u) @ b)[0, 1]) < 1e-6


def test_rasch_is_where_the_conditional_likelihood_is_flat(spark):
    rng = np.random.default_rng(2)
    d = np.array([-1.0, -0.2, 0.3, 0.9])
    y = rng.random((500, 4)) < 1 / (1 + np.exp(-(rng.normal(size=(500, 1)) - d)))
    df = spark.createDataFrame([tuple(bool(v) for v in r) for r in y] + [(True, None, False, True)], "a boolean, b boolean, c boolean, d boolean").repartition(3)
    got = {r.item: r for r in latent.rasch(df, {c: F.col(c) for c in "abcd"}).collect()}
    b = np.array([got[c].difficulty for c in "abcd"])

    def loglik(v):
        total = 0.0
        for r in y:
            ways = [sum(-v[i] for i in w) for w in itertools.combinations(range(4), int(r.sum()))]
            total += -(v * r).sum() - math.log(sum(map(math.exp, ways)))
        return total

    assert np.abs(slope(loglik, b)).max() < 1e-4 and abs(b.sum()) < 1e-9 and np.abs(b - (d - d.mean())).max() < 0.4
    assert got["a"].n == 500 and got["b"].correct == int(y[:, 1].sum()) and 0.05 < got["a"].se < 0.3
    with pytest.raises(ValueError):
        latent.rasch(df.filter("a"), {c: F.col(c) for c in "abcd"})


def test_variances_of_walking_levels(spark):
    rng = np.random.default_rng(3)
    series = {"u": np.cumsum(rng.normal(size=150)) * 2 + rng.normal(size=150), "v": rng.normal(size=60) + 5}
    rows = [(k, i, float(v)) for k, s in series.items() for i, v in enumerate(s)] + [("u", 150, None), ("u", 151, 3.0), ("w", 0, 1.0), ("c", 0, 2.0), ("c", 1, 2.0), ("c", 2, 2.0)]
    fits = latent.local_level_fit(spark.createDataFrame(rows, "k string, i int, y double").repartition(4), "y", ["k"], ["i"])
    got = {r.k: r for r in fits.collect()}
    assert got["w"].level is None and got["c"].loglik is None and got["u"].n == 151

    def loglik(values, level_var, noise_var):
        """From the joint normal distribution of differences to the first value."""
        at = np.array([i for i, v in enumerate(values) if v is not None][1:], dtype=float)
        e = np.array([v for v in values if v is not None])
        c = np.minimum.outer(at, at) * level_var + noise_var * (np.eye(len(at)) + 1)
        e = e[1:] - e[0]
        return -0.5 * (np.linalg.slogdet(2 * math.pi * c)[1] + e @ np.linalg.solve(c, e))

    # the differences' covariance has 1 + identity as the first value's noise is in each
    for k in "uv":
        values = [v for n, _, v in rows if n == k]
        r = got[k]
        here = loglik(values, r.level_var, r.noise_var)
        assert math.isclose(here, r.loglik, rel_tol=1e-9)
        for a, b in ((1.05, 1), (0.95, 1), (1, 1.05), (1, 0.95)):
            assert loglik(values, r.level_var * a + (a - 1) * 1e-3 * (r.level_var == 0), r.noise_var * b) <= here + 1e-6
    ahead = {(r.k, r.ahead): r for r in latent.level_forecast(fits, ["k"], 3).collect()}
    u = got["u"]
    assert len(ahead) == 6 and ahead["u", 3].expected == u.level and math.isclose(ahead["u", 3].sd ** 2, u.level_variance + 3 * u.level_var + u.noise_var)


def test_zero_inflated_regression_is_where_the_likelihood_is_flat(spark):
    rng = np.random.default_rng(4)
    a = rng.normal(size=700)
    m, z = np.exp(0.7 + 0.5 * a), 1 / (1 + np.exp(-(-0.5 + 0.8 * a)))
    y = np.where(rng.random(700) < z, 0, rng.poisson(m))
    df = spark.createDataFrame([(float(u), int(v)) for u, v in zip(a, y, strict=True)] + [(None, 3), (1.0, None)], "a double, y int").repartition(3)
    design = {"one": F.lit(1.0), "a": F.col("a")}
    got = {(r.part, r.term): r for r in latent.zero_inflated_regression(df, F.col("y"), design, design).collect()}
    b = np.array([got[k, t].estimate for k in ("count", "zero") for t in design])

    def loglik(v):
        m, z = np.exp(v[0] + v[1] * a), 1 / (1 + np.exp(-(v[2] + v[3] * a)))
        return float(np.where(y == 0, np.log(z + (1 - z) * np.exp(-m)), np.log(1 - z) + y * np.log(m) - m).sum())

    assert np.abs(slope(loglik, b)).max() < 1e-4 and np.abs(b - [0.7, 0.5, -0.5, 0.8]).max() < 0.4
    assert all(0.02 < r.se < 0.4 for r in got.values())


def test_nets_against_enumeration(spark):
    rng = np.random.default_rng(5)
    shape = {"ab": (2, 3), "bc": (3, 2), "cd": (2, 2), "bd": (3, 2), "e": (2,)}
    weights = {k: rng.random(s) for k, s in shape.items()}
    tables = [spark.createDataFrame([(*map(int, at), float(w)) for at, w in np.ndenumerate(weights[k]) for at in [at]], ", ".join(f"{c} int" for c in k) + ", p double") for k in shape]
    joint = np.einsum("ab,bc,cd,bd->abcd", *[weights[k] for k in list(shape)[:4]])
    got = np.zeros((2, 2))
    for r in latent.eliminate(tables, ["a", "d"], {"c": 1}).collect():
        got[r.a, r.d] = r.p
    want = joint[:, :, 1].sum(axis=1)
    assert np.abs(got - want / want.sum()).max() < 1e-12
    with pytest.raises(ValueError):
        latent.eliminate(tables, ["a", "e"])


def test_densities_of_vectors(spark):
    rng = np.random.default_rng(6)
    root = rng.normal(size=(3, 3))
    c, m, x = root @ root.T + np.eye(3), np.array([1.0, -2.0, 0.5]), np.array([0.3, 0.1, -1.0])
    df = spark.createDataFrame([([float(v) for v in x],), ([1.0, 2.0],), ([1.0, None, 2.0],), (None,)], "x array<double>").coalesce(1)
    got = [tuple(r) for r in df.select(mathx.mvn_log_density(F.col("x"), m, c), mathx.mvn_log_density(F.col("x"), m, c, df=3.0)).collect()]
    q = (x - m) @ np.linalg.solve(c, x - m)
    half = 0.5 * np.linalg.slogdet(c)[1]
    assert math.isclose(got[0][0], -0.5 * q - half - 1.5 * math.log(2 * math.pi), rel_tol=1e-12)
    assert math.isclose(got[0][1], math.lgamma(3) - math.lgamma(1.5) - 1.5 * math.log(3 * math.pi) - half - 3 * math.log1p(q / 3), rel_tol=1e-12)
    assert got[1:] == [(None, None)] * 3


def test_screened_regression(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(300, 5))
    y = 2 * x[:, 3] - x[:, 1] + 0.1 * rng.normal(size=300) + 4
    df = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y, strict=True)], "a double, b double, c double, d double, e double, y double")
    got = sufficient.screened_regression(df, "y", {"k": F.lit(1.0), **{c: F.col(c) for c in "abcde"}}, 2).collect()
    want = np.linalg.lstsq(np.stack([np.ones(300), x[:, 1], x[:, 3]], axis=1), y, rcond=None)[0]
    assert [r.term for r in got] == ["(Intercept)", "b", "d"] and np.abs(np.array([r.estimate for r in got]) - want).max() < 1e-9


def test_quantiles_and_codes_in_ranges(spark):
    rng = np.random.default_rng(8)
    groups = {"u": rng.integers(0, 40, 500).astype(float), None: rng.normal(size=77), "w": np.array([3.0])}
    df = spark.createDataFrame([(g, float(v)) for g, s in groups.items() for v in s] + [("u", None), ("x", None)], "g string, v double").repartition(5)
    probs = [0.0, 0.1, 0.5, 0.77, 1.0]
    got = {(r.g, r.prob): r.quantile for r in aggregate.quantiles(df, "v", probs, ["g"]).collect()}
    assert set(got) == {(g, p) for g in groups for p in probs}
    assert all(math.isclose(got[g, p], np.quantile(s, p), abs_tol=1e-12) for g, s in groups.items() for p in probs)
    assert not aggregate.quantiles(df.filter("g = 'x'"), "v", probs).collect()
    levels = [f"level {k * 7919 % 1000}" for k in range(1000)]
    codes = {r.t: r.code for r in ordered.coded(spark.createDataFrame([(t,) for t in levels], "t string"), "t", "code").collect()}
    assert codes == {t: k for k, t in enumerate(sorted(levels))}


def test_shares_of_levels(spark):
    df = spark.createDataFrame([("u", "a"), ("u", "a"), ("u", "b"), ("v", None), ("w", "b")], "g string, t string")
    got = {(r.g, r.t): (r.n, r.posterior) for r in sufficient.dirichlet_multinomial(df, ["g"], "t").collect()}
    assert got == {("u", "a"): (2, 0.6), ("u", "b"): (1, 0.4), ("v", "a"): (0, 0.5), ("v", "b"): (0, 0.5), ("w", "a"): (0, 1 / 3), ("w", "b"): (1, 2 / 3)}
