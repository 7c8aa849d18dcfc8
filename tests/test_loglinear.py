"""Log-linear fits against their margins and plain proportional fitting; weekly rates where their likelihood is flat."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnspark.operators import loglinear as LL


def test_margins_equal_the_data(spark):
    rng = np.random.default_rng(1)
    n = rng.poisson(rng.gamma(2.0, 5.0, (3, 4, 2)))
    n[0, 1, :] = 0  # a margin of nothing
    rows = [(f"a{i}", j, bool(k), int(n[i, j, k])) for i in range(3) for j in range(4) for k in range(2) if n[i, j, k]]
    df = spark.createDataFrame([*rows, (None, 1, True, 5)], "a string, b int, c boolean, n int").repartition(3)
    fitted = LL.loglinear_fit(df, ["a", "b", "c"], [["a", "b"], ["b", "c"], ["a", "c"]], count="n")
    got = np.zeros(n.shape)
    for r in fitted.collect():
        got[int(r.a[1]), r.b, int(r.c)] = r.fitted
        assert r.n == n[int(r.a[1]), r.b, int(r.c)]
    fit = np.ones(n.shape)
    for _ in range(3000):
        for axis in (2, 0, 1):
            total = fit.sum(axis=axis, keepdims=True)
            fit = fit * np.divide(n.sum(axis=axis, keepdims=True), total, out=np.zeros_like(total), where=total > 0)
    assert np.allclose(got, fit, atol=1e-6)
    for axis in range(3):
        assert np.allclose(got.sum(axis=axis), n.sum(axis=axis), atol=1e-6)
    row = LL.deviance(fitted).first()
    some = n > 0
    assert np.isclose(row.g2, 2 * (n[some] * np.log(n[some] / fit[some])).sum(), atol=1e-4) and row.x2 >= 0
    assert LL.loglinear_fit(df.limit(0), ["a", "b"], [["a"], ["b"]]).count() == 0
    with pytest.raises(ValueError, match="cells"):
        LL.cells(df, ["a", "b", "c"], limit=10)


def test_exposure_of_windows(spark):
    rows = [("x", "2024-01-06 22:15:00", "2024-01-07 01:30:00"), ("x", "2024-01-01 00:00:00", "2024-01-15 00:00:00"), ("y", "2024-01-03 05:10:00", "2024-01-10 06:20:00"), ("y", "2024-01-03 05:10:00", "2024-01-03 05:10:00"), ("z", None, "2024-01-03 05:10:00")]
    df = spark.createDataFrame(rows, "g string, s string, e string")
    got = {(r.g, r.day, r.hour): r.exposure for r in LL.week_exposure(df, "s", "e", ["g"]).collect()}
    assert len([k for k in got if k[0] == "x"]) == 168 and "z" not in {k[0] for k in got}
    assert np.isclose(got["x", 7, 22], 2.75) and np.isclose(got["x", 7, 23], 3.0) and np.isclose(got["x", 1, 1], 2.5) and np.isclose(got["x", 3, 4], 2.0)
    assert np.isclose(got["y", 4, 5], 1 + 50 / 60) and np.isclose(got["y", 4, 6], 1 + 20 / 60) and np.isclose(got["y", 2, 0], 1.0)


def test_weekly_rates_are_flat(spark):
    rng = np.random.default_rng(2)
    x = rng.uniform(5, 30, (7, 24))
    n = rng.poisson(x * rng.uniform(0.2, 2, (7, 1)) * rng.uniform(0.2, 2, (1, 24)))
    n[:, 3] = 0
    table = spark.createDataFrame([(d + 1, h, int(n[d, h]), float(x[d, h])) for d in range(7) for h in range(24)], "day int, hour int, n int, exposure double")
    rate = np.zeros((7, 24))
    for r in LL.weekly_rates(table, table).collect():
        rate[r.day - 1, r.hour] = r.rate
    free = np.array([True, *[False] * 5, True])
    # where the likelihood is flat, expected counts are those of the data for each day and for each hour of each kind of day
    assert np.allclose((rate * x).sum(axis=1), n.sum(axis=1))
    for on in (free, ~free):
        assert np.allclose((rate * x)[on].sum(axis=0), n[on].sum(axis=0))
        assert np.linalg.matrix_rank(np.log(np.delete(rate, 3, axis=1)[on]) - np.log(np.delete(rate, 3, axis=1)[on][:1]), tol=1e-6) <= 1
    with pytest.raises(ValueError, match="no window"):
        LL.weekly_rates(table, table.filter("hour <> 5"))
