"""Sums of products far from zero, held against numpy on the same values taken from their means first."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnspark.operators import models
from tarnspark.operators import sufficient as S
from tarnspark.operators.moments import Moments, fit, moments


def _far(n=4000, at=1e8, seed=3):
    rng = np.random.default_rng(seed)
    z = rng.normal(size=(n, 3)) @ np.array([[1.0, 0.3, 0.0], [0.0, 0.8, 0.2], [0.0, 0.0, 1.3]])
    x = at * np.array([1.0, -2.0, 3.0]) + z
    return x, rng.uniform(0.1, 2.0, n)


def test_moments_far_from_zero(spark):
    x, w = _far()
    df = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, w)], "a double, b double, c double, w double").repartition(7)
    d = x - x[0]
    cells = [F.col(c) for c in "abc"]
    plain = moments(df, cells)
    d0 = d - d.mean(axis=0)
    assert plain.n == len(x) and np.allclose(plain.s, d0.T @ d0, rtol=1e-9, atol=1e-9 * len(x))
    heavy = moments(df, cells, F.col("w"))
    d1 = d - w @ d / w.sum()
    assert np.isclose(heavy.w, w.sum()) and np.allclose(heavy.s, (d1 * w[:, None]).T @ d1, rtol=1e-9, atol=1e-9 * len(x))
    assert np.allclose(heavy.mean - x[0], w @ d / w.sum(), atol=1e-7)


def test_mvn_far_from_zero(spark):
    x, w = _far()
    rows = [(k % 3 if k % 5 else None, [float(v) for v in r], *map(float, r), float(v)) for k, (r, v) in enumerate(zip(x, w))]
    df = spark.createDataFrame(rows, "g int, v array<double>, a double, b double, c double, w double").repartition(5)
    got = {(r.g, r.i, r.j): r for r in S.mvn(df, "v", ["g"], 3).collect()}
    heavy = {(r.g, r.i, r.j): r for r in S.weighted_mvn(df, ["a", "b", "c"], "w", ["g"]).collect()}
    assert len(got) == 4 * 6 == len(heavy)
    for g in (None, 0, 1, 2):
        at = np.array([r[0] == g for r in rows])
        d = x[at] - x[0]
        for i in range(3):
            for j in range(i, 3):
                own, other = d - d.mean(axis=0), d - w[at] @ d / w[at].sum()
                r = got[g, i, j]
                assert r.n == at.sum() and np.isclose(r.s, own[:, i] @ own[:, j], rtol=1e-9, atol=1e-6)
                r = heavy[g, "abc"[i], "abc"[j]]
                assert np.isclose(r.sum_w, w[at].sum()) and np.isclose(r.s, (w[at] * other[:, i]) @ other[:, j], rtol=1e-9, atol=1e-6)
    with pytest.raises(ValueError, match="rename"):
        S.mvn(df.withColumnRenamed("g", "i"), "v", ["i"], 3)


def test_regression_on_a_time_stamp(spark):
    rng = np.random.default_rng(5)
    t = 1.7e9 + rng.integers(0, 86400 * 30, 3000).astype(float)
    e = 1000 * rng.normal(size=len(t))
    y = 2.0 * (t - 1.7e9) + e
    df = spark.createDataFrame([(float(a), float(b), 3.0 * float(a)) for a, b in zip(t, y)], "t double, y double, again double").repartition(6)
    got = {r.term: r for r in S.least_squares(df, "y", {"one": F.lit(1.0), "t": F.col("t"), "again": F.col("again")}).collect()}
    d, u = t - t.mean(), y - y.mean()
    slope = d @ u / (d @ d)
    rest = u - slope * d
    se = np.sqrt(rest @ rest / (len(t) - 2) / (d @ d))
    assert np.isclose(got["t"].estimate, slope, rtol=1e-10) and np.isclose(got["t"].se, se, rtol=1e-6)
    assert got["again"].estimate is None and got["again"].t is None  # three times a term before it
    assert np.isclose(got["one"].estimate, y.mean() - slope * t.mean(), rtol=1e-9)
    assert np.isclose(got["one"].se, np.sqrt(rest @ rest / (len(t) - 2) * (1 / len(t) + t.mean() ** 2 / (d @ d))), rtol=1e-6)
    terms, table = S.lm(df, "y", {"one": F.lit(1.0), "t": F.col("t")})
    assert {r.source: r.df for r in table.collect()} == {"model": 1.0, "residual": len(t) - 2.0, "total": len(t) - 1.0}
    model = table.filter("source = 'model'").first()
    assert np.isclose(1 - model.r2, rest @ rest / (u @ u), rtol=1e-5) and np.isclose(model.f, (slope / se) ** 2, rtol=1e-5)
    both = {(r.response, r.term): r for r in S.multivariate_regression(df.withColumn("z", -F.col("y")), ["y", "z"], {"one": F.lit(1.0), "t": F.col("t")}).collect()}
    assert np.isclose(both["z", "t"].estimate, -slope, rtol=1e-10) and np.isclose(both["y", "t"].se, se, rtol=1e-6)


def test_without_an_intercept_and_without_rows(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(500, 2))
    y = x @ [1.5, -0.5] + 4 + rng.normal(size=500)
    f = fit(Moments.of(np.column_stack([x, y])), 2)
    assert np.allclose(f.b[:, 0], np.linalg.lstsq(x, y, rcond=None)[0]) and f.rank == 2
    empty = spark.createDataFrame([], "x double, y double")
    assert [r.estimate for r in S.least_squares(empty, "y", {"one": F.lit(1.0), "x": F.col("x")}).collect()] == [None, None]
    assert S.mvn(spark.createDataFrame([], "g int, v array<double>"), "v", ["g"], 2).collect() == []


def test_scored_fits_settle_or_raise(spark):
    rng = np.random.default_rng(9)
    t = 1.7e9 + rng.integers(0, 10**6, 2000).astype(float)
    z = (t - t.mean()) / t.std()
    y = (rng.random(2000) < 1 / (1 + np.exp(-(0.4 + 0.9 * z)))).astype(float)
    k = rng.poisson(np.exp(0.3 + 0.5 * z)).astype(float)
    df = spark.createDataFrame([(float(a), float(b), float(c)) for a, b, c in zip(t, y, k)], "t double, y double, k double")
    x = np.stack([np.ones(2000), z], axis=1)
    b, c = np.zeros(2), np.array([np.log(k.mean()), 0.0])
    for _ in range(50):
        p, m = 1 / (1 + np.exp(-x @ b)), np.exp(x @ c)
        b = b + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x, x.T @ (y - p))
        c = c + np.linalg.solve((x * m[:, None]).T @ x, x.T @ (k - m))
    design = {"one": F.lit(1.0), "t": F.col("t")}
    got = {r.term: r.estimate for r in models.logistic(df, F.col("y"), design).collect()}
    assert np.isclose(got["t"] * t.std(), b[1], rtol=1e-6) and np.isclose(got["one"] + got["t"] * t.mean(), b[0], rtol=1e-5)
    got = {r.term: r.estimate for r in models.poisson_regression(df, F.col("k"), design).collect()}
    assert np.isclose(got["t"] * t.std(), c[1], rtol=1e-6)
    with pytest.raises(RuntimeError, match="no convergence"):
        models.logistic(df.withColumn("y", (F.col("t") > 1.7005e9).cast("int")), F.col("y"), design)
    with pytest.raises(ValueError, match="no row"):
        models.logistic(df.limit(0), F.col("y"), design)
