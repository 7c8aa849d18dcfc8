"""Regressions, encoders and dates against plain references: numpy, enumeration or known values."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnspark.functions import dates, mathx
from tarnspark.operators import encode, glm, relations


def data(spark, seed=1, n=600):
    rng = np.random.default_rng(seed)
    a, c = rng.normal(size=n), rng.normal(size=n)
    return rng, np.stack([np.ones(n), a, c], axis=1), {"one": F.lit(1.0), "a": F.col("a"), "c": F.col("c")}


def made(spark, x, y, kind):
    return spark.createDataFrame([(float(r[1]), float(r[2]), v) for r, v in zip(x, y, strict=True)], f"a double, c double, y {kind}").repartition(3)


def slope(f, b, h=1e-5):
    return np.array([(f(b + h * e) - f(b - h * e)) / (2 * h) for e in np.eye(len(b))])


def phi(z):
    return 0.5 * math.erfc(-z / math.sqrt(2))


def test_probit_is_where_the_likelihood_is_flat(spark):
    rng, x, design = data(spark)
    y = [bool(rng.random() < phi(e)) for e in x @ np.array([0.2, 0.8, -0.4])]
    got = {r.term: r for r in glm.probit(made(spark, x, y, "boolean"), F.col("y"), design).collect()}
    b = np.array([got[t].estimate for t in design])
    loglik = lambda v: sum(math.log(phi(e if t else -e)) for e, t in zip(x @ v, y, strict=True))
    assert np.abs(slope(loglik, b)).max() < 1e-4 and np.abs(b - [0.2, 0.8, -0.4]).max() < 0.25
    assert all(0.02 < got[t].se < 0.2 for t in design)


def test_multinomial_logit_is_where_the_likelihood_is_flat(spark):
    rng, x, design = data(spark, 2)
    true = np.array([[0.0, 0.0, 0.0], [0.3, 1.0, 0.0], [-0.5, 0.0, 0.8]])

    def loglik(v, places):
        eta = np.concatenate([np.zeros((len(x), 1)), x @ v.reshape(2, 3).T], axis=1)
        return float((eta[np.arange(len(x)), places] - np.log(np.exp(eta).sum(axis=1))).sum())

    p = np.exp(x @ true.T)
    places = np.array([rng.choice(3, p=r / r.sum()) for r in p])
    got = {(r.level, r.term): r.estimate for r in glm.multinomial_logit(made(spark, x, ["uvw"[k] for k in places], "string"), "y", ("u", "v", "w"), design).collect()}
    b = np.array([got[v, t] for v in "vw" for t in design])
    assert np.abs(slope(lambda v: loglik(v, places), b)).max() < 1e-4


def test_ordinal_logit_is_where_the_likelihood_is_flat(spark):
    rng, x, design = data(spark, 3)
    latent = x[:, 1:] @ np.array([1.0, -0.5]) + rng.logistic(size=len(x))
    places = np.digitize(latent, [-1.0, 0.5, 2.0])
    terms = {k: v for k, v in design.items() if k != "one"}
    df = made(spark, x, [int(v) for v in places], "int").unionByName(made(spark, x[:2], [None, 9], "int"))
    got = {r.term: r.estimate for r in glm.ordinal_logit(df, "y", (0, 1, 2, 3), terms).collect()}
    b = np.array([got[t] for t in ("cut.0", "cut.1", "cut.2", "a", "c")])

    def loglik(v):
        at = np.concatenate([[-np.inf], v[:3], [np.inf]])
        eta = x[:, 1:] @ v[3:]
        f = lambda z: 1 / (1 + np.exp(-z))
        return float(np.log(f(at[places + 1] - eta) - f(at[places] - eta)).sum())

    assert np.abs(slope(loglik, b)).max() < 1e-4
    with pytest.raises(ValueError):
        glm.ordinal_logit(df, "y", (0, 1, 2, 3, 77), terms)


def test_gamma_regression_is_where_the_likelihood_is_flat(spark):
    rng, x, design = data(spark, 4)
    y = rng.gamma(3.0, np.exp(x @ np.array([1.0, 0.4, -0.2])) / 3.0)
    got, shape = glm.gamma_regression(made(spark, x, [float(v) for v in y], "double"), F.col("y"), design)
    b = np.array([r.estimate for r in got.collect()])

    def loglik(v):
        mu, a = np.exp(x @ v[:3]), v[3]
        return float((a * np.log(a / mu) - math.lgamma(a) + (a - 1) * np.log(y) - a * y / mu).sum())

    assert np.abs(slope(loglik, np.append(b, shape))).max() < 1e-3


def test_zero_inflated_counts(spark):
    df = spark.createDataFrame([("a", 0)] * 6 + [("a", 1), ("a", 2), ("a", 4), ("b", 0), ("b", 1), ("c", 0), ("d", None)], "g string, k int")
    got = {r.g: r for r in glm.zero_inflated_fit(df, ["g"], F.col("k")).collect()}
    a = got["a"]
    assert math.isclose(a.rate / -math.expm1(-a.rate), 7 / 3, rel_tol=1e-12) and math.isclose(a.extra, 1 - 3 / (9 * -math.expm1(-a.rate)))
    assert (got["b"].rate, got["c"].rate, got["d"].positive) == (None, None, 0)


def test_normal_tails(spark):
    at = [-30.0, -8.0, -2.5, -1e-9, 0.0, 0.7, 3.0, 40.0]
    for r in spark.createDataFrame([(v,) for v in [*at, None]], "x double").select("x", mathx.normal_cdf(F.col("x")).alias("p")).collect():
        assert r.p is None if r.x is None else math.isclose(r.p, phi(r.x), rel_tol=1e-11)


def test_formula_and_new_data(spark):
    df = spark.createDataFrame([("u", True, 1.0), ("v", False, 2.0), (None, True, 3.0), ("v", None, None)], "s string, b boolean, x double")
    full = encode.formula(df, "s * b * x")
    assert full.names() == ["(Intercept)", "s.v", "b.True", "x", "s.v:b.True", "s.v:x", "b.True:x", "s.v:b.True:x"]
    assert full.variable_map()["s:b:x"] == [7] and encode.from_json(encode.to_json(full)).names() == full.names()
    assert encode.formula(df, ". - 1", omit=["b"]).names() == ["s.v", "x"] and encode.formula(df, "").names() == ["(Intercept)"]
    new = spark.createDataFrame([("v", True, 2.0), ("w", True, 1.0), ("u", None, 1.0)], "s string, b boolean, x double")
    assert [tuple(r) for r in encode.predictor_matrix(new, full, unknown="drop").collect()] == [(1.0, 1.0, 1.0, 2.0, 1.0, 2.0, 2.0, 2.0)]
    with pytest.raises(Exception, match="unknown level of s: w"):
        encode.predictor_matrix(new, full).collect()


def test_guessed_dates(spark):
    want = {"5/12/2020": "2020-05-12", "25/12/2020": "2020-12-25", "2020/25/12": "2020-12-25", "2020/5/12": "2020-12-05", "1/99/2": "0099-01-02", "1/2/3": None, "2/30/2020": None, "x/1/2020": None, "1/2020": None, "": None, None: None, " 1 / 45 / 2 ": "0045-01-02"}
    rows = spark.createDataFrame([(k,) for k in want], "t string").select("t", dates.guessed_date(F.col("t")).cast("string").alias("d")).collect()
    assert {r.t: r.d for r in rows} == want


def test_labels_of_short_spans(spark):
    label = lambda *ts: [r.period for r in dates.group_timestamps(spark.createDataFrame([(t,) for t in ts], "t string").select(F.to_timestamp("t").alias("t")), "t").orderBy("t").collect()]
    assert label("2024-01-01 01:02:03", "2024-01-01 04:05:06") == ["01:02:03", "04:05:06"]
    assert label("2024-01-01 23:00:00", "2024-01-02 01:00:00") == ["2024-01-01 23:00:00", "2024-01-02 01:00:00"]
    assert label("2022-01-01 00:00:00", "2024-01-02 00:00:00", None) == [None, "2022-01", "2024-01"]


def test_areas_and_integrals_of_splines(spark):
    knots, x = [0.0, 1.0, 2.5, 4.0], np.linspace(0, 4, 40_001)
    for degree in (1, 2, 3):
        m, i = mathx.mspline_basis(x, knots, degree), mathx.ispline_basis(x, knots, degree)
        area = np.concatenate([np.zeros((1, m.shape[1])), np.cumsum((m[1:] + m[:-1]) / 2 * 1e-4, axis=0)])
        assert np.abs(area - i).max() < 1e-4 and np.abs(i[-1] - 1).max() < 1e-12
    out = mathx.bspline(spark.createDataFrame([(9.0,), (None,)], "x double"), "x", knots, functions=mathx.ispline_basis).collect()
    assert out[0].basis == [1.0] * 6 and out[1].basis is None


def test_natural_splines_are_straight_outside(spark):
    at = [-3.0, -2.0, -1.0, 6.0, 7.0, 8.0, None]
    got = [r.b for r in spark.createDataFrame([(v,) for v in at], "x double").coalesce(1).select(mathx.natural_spline(F.col("x"), [0, 1, 3, 5]).alias("b")).collect()]
    b = np.array(got[:6])
    assert got[6] is None and b.shape == (6, 3) and np.abs(b[[0, 3]] - 2 * b[[1, 4]] + b[[2, 5]]).max() < 1e-9


def test_importance_resampling(spark):
    df = spark.range(1000).select("id", (F.col("id") * -0.01 + 5000.0).alias("target"), F.lit(0.0).alias("proposal"))
    got = relations.importance_resample(df, "target", "proposal", "id", 20_000).collect()
    mean = sum(r.id * r.draws for r in got) / sum(r.draws for r in got)
    w = np.exp(-0.01 * np.arange(1000))
    assert abs(sum(r.draws for r in got) - 20_000) <= 1 and abs(mean - (np.arange(1000) * w).sum() / w.sum()) < 0.5


def test_formulas_of_every_form(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0, 4.0)], "a double, b double, c double, `odd name` double")
    names = lambda f, **k: encode.formula(df, f, **k).names()
    one = "(Intercept)"
    assert names("a*b:c") == [one, "a", "b:c", "a:b:c"]
    assert names("a + b - a") == [one, "b"] and names("a - b") == [one, "a"] and names("a*b - a:b") == [one, "a", "b"]
    assert names("a + 0") == ["a"] == names("a - 1") == names("-1 + a") == names("0 + a") and names("a + 0 + 1") == [one, "a"] == names("a - 0")
    assert names("(a + b)") == [one, "a", "b"] and names("(a + b):c") == [one, "a:c", "b:c"] and names("(a + b) * c") == [one, "a", "b", "c", "a:c", "b:c"]
    assert names("(a + b + c)^2") == [one, "a", "b", "c", "a:b", "a:c", "b:c"] and names("b:a + a:b + a:a") == [one, "a", "b:a"]
    assert names("log(a + 1)") == [one, "log.a + 1"] and names("log(a):b") == [one, "log.a:b"] and names("`odd name`:a") == [one, "odd name:a"]
    assert names(". - `odd name`") == [one, "a", "b", "c"] and names(". - b", omit=["a", "odd name"]) == [one, "c"] and names("") == [one]
    row = encode.encode(df, encode.from_json(encode.to_json(encode.formula(df, "log((a + 1) * b) + a*b:c - 1")))).first()
    assert np.allclose(list(row), [np.log(4.0), 1.0, 6.0, 6.0])
    assert np.allclose(list(encode.predictor_matrix(df, encode.formula(df, "log(a + 1)")).first()), [1.0, np.log(2.0)])
    for wrong, told in (("a + x", "unknown term of the formula: x"), ("f(a)", "unknown term of the formula: f"), ("log(x)", "unknown term"), ("a +", "its end"), ("(a", "read the formula"), ("a b", "read the formula"), ("log(a", "closed"), ("a^0", "power"), ("2 + a", "read the formula"), ("a & b", "read the formula")):
        with pytest.raises(ValueError, match=told):
            encode.formula(df, wrong)


def test_resample_refuses_weights_below_zero(spark):
    df = spark.createDataFrame([(1, 2.0), (2, None), (3, 0.0), (4, 1.0)], "id int, w double")
    assert {r.id: r.draws for r in relations.resample(df, "w", "id", 30).collect()} == {1: 20, 4: 10}
    with pytest.raises(Exception, match="below 0"):
        relations.resample(df.union(spark.createDataFrame([(5, -1.0)], "id int, w double")), "w", "id", 30).collect()
