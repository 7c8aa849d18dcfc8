"""Models and tests against plain references: numpy, enumeration, or published values."""

import itertools
import math

import numpy as np
from pyspark.sql import functions as F

from tarnspark.operators import aggregate, models, relations, sufficient


def frame(spark, columns, schema):
    return spark.createDataFrame(list(zip(*columns, strict=True)), schema).repartition(3)


def newton(x, y, mean, weight, b):
    for _ in range(50):
        m = mean(x @ b)
        w = weight(m)
        b = b + np.linalg.solve((x * w[:, None]).T @ x, x.T @ (y - m))
    return b, np.sqrt(np.diag(np.linalg.inv((x * w[:, None]).T @ x)))


def test_logistic_and_poisson_regression_against_newton(spark):
    rng = np.random.default_rng(1)
    a, c = rng.normal(size=800), rng.normal(size=800)
    x = np.stack([np.ones(800), a, c], axis=1)
    y = (rng.random(800) < 1 / (1 + np.exp(-(0.3 + a - 0.5 * c)))).astype(float)
    k = rng.poisson(np.exp(0.2 + 0.4 * a + 0.1 * c)).astype(float)
    df = frame(spark, [a.tolist(), c.tolist(), y.tolist(), k.tolist()], "a double, c double, y double, k double")
    design = {"one": F.lit(1.0), "a": F.col("a"), "c": F.col("c")}
    b, se = newton(x, y, lambda e: 1 / (1 + np.exp(-e)), lambda m: m * (1 - m), np.zeros(3))
    got = {r.term: r for r in models.logistic(df, F.col("y"), design, ridge=0.0).collect()}
    assert np.allclose([got[t].estimate for t in design], b, atol=1e-6) and np.allclose([got[t].se for t in design], se, atol=1e-6)
    b, _ = newton(x, k, np.exp, lambda m: m, np.array([math.log(k.mean()), 0.0, 0.0]))
    got = {r.term: r.estimate for r in models.poisson_regression(df, F.col("k"), design, ridge=0.0).collect()}
    assert np.allclose([got[t] for t in design], b, atol=1e-6)


def test_gaussian_mixture_against_numpy(spark):
    rng = np.random.default_rng(2)
    v = np.concatenate([rng.normal(0, 1, 300), rng.normal(6, 2, 200)])
    mean, sd, weight = np.quantile(v, [0.25, 0.75]), np.full(2, v.std() / 2), np.full(2, 0.5)
    for _ in range(7):
        r = weight * np.exp(-0.5 * ((v[:, None] - mean) / sd) ** 2) / sd
        r /= r.sum(axis=1, keepdims=True)
        n = r.sum(axis=0)
        mean = (r * v[:, None]).sum(axis=0) / n
        sd, weight = np.sqrt((r * (v[:, None] - mean) ** 2).sum(axis=0) / n), n / n.sum()
    got = sorted(models.gaussian_mixture(frame(spark, [v.tolist()], "x double"), "x", 2, rounds=7).collect())
    assert np.allclose([r.mean for r in got], mean, atol=1e-6) and np.allclose([r.sd for r in got], sd, atol=1e-6) and np.allclose([r.weight for r in got], weight, atol=1e-6)


def test_local_level_against_the_joint_distribution(spark):
    """All values of a series are jointly normal: their density and the next level's mean, without a filter."""
    rng = np.random.default_rng(3)
    y = np.cumsum(rng.normal(size=12)) + rng.normal(size=12)
    y[[3, 4, 9]] = np.nan
    df = frame(spark, [["a"] * 12, list(range(12)), [None if v != v else float(v) for v in y]], "g string, t int, y double")
    r = models.local_level(df, "y", ["g"], ["t"], level_var=0.7, noise_var=0.4, start=1.0, start_var=5.0).first()
    t = np.arange(13)
    level = 5.0 + 0.7 * np.minimum(t[:, None], t[None, :])
    at = np.flatnonzero(y == y)
    cov = level[np.ix_(at, at)] + 0.4 * np.eye(len(at))
    rest = y[at] - 1.0
    loglik = -0.5 * (len(at) * math.log(2 * math.pi) + np.linalg.slogdet(cov)[1] + rest @ np.linalg.solve(cov, rest))
    gain = np.linalg.solve(cov, level[at, 12])
    assert r.n == 9 and math.isclose(r.loglik, loglik, rel_tol=1e-9)
    assert math.isclose(r.level, 1.0 + gain @ rest, rel_tol=1e-9) and math.isclose(r.level_variance, level[12, 12] - gain @ level[at, 12], rel_tol=1e-9)


def test_hidden_markov_against_all_paths(spark):
    """One round of expected counts, by walking every path of hidden states."""
    seqs = {1: "abba", 2: "bbc", 3: "cacab"}
    rows = [(i, t, s) for i, x in seqs.items() for t, s in enumerate(x)]
    got = models.hidden_markov(spark.createDataFrame(rows, "g int, t int, s string"), "s", ("a", "b", "c"), ["g"], ["t"], 2, rounds=1)
    move, emit = np.full((2, 2), 0.15) + 0.7 * np.eye(2), np.random.default_rng(0).dirichlet(np.full(3, 5.0), 2)
    move /= move.sum(axis=1, keepdims=True)
    counts = np.zeros((2, 3))
    for x in seqs.values():
        o = ["abc".index(s) for s in x]
        paths = {p: 0.5 * math.prod(move[a, b] for a, b in zip(p, p[1:])) * math.prod(emit[h, s] for h, s in zip(p, o, strict=True)) for p in itertools.product((0, 1), repeat=len(o))}
        for p, w in paths.items():
            for h, s in zip(p, o, strict=True):
                counts[h, s] += w / sum(paths.values())
    want = counts / counts.sum(axis=1, keepdims=True)
    for r in got.collect():
        assert math.isclose(r.probability, want[r.hidden, "abc".index(r.symbol)], rel_tol=1e-6)


def test_spike_and_slab_against_all_models(spark):
    """Shares of draws in which a term is in, against the posterior of all eight models."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 3))
    y = 0.35 * x[:, 0] + 0.15 * x[:, 1] + rng.normal(size=60)
    df = frame(spark, [*x.T.tolist(), y.tolist()], "a double, b double, c double, y double")
    got = models.spike_and_slab(df, "y", {t: F.col(t) for t in "abc"}, draws=6000, burn=200, expected_size=1.5)
    shares = {r.term: r.share for r in got.groupBy("term").agg(F.avg((F.col("value") != 0).cast("double")).alias("share")).collect()}
    weight = {}
    for inside in itertools.product((0, 1), repeat=3):
        at = [k for k in range(3) if inside[k]]
        own = x[:, at]
        precision = np.diag((own**2).sum(axis=0)) / 60
        # y is multivariate t: shape 2, scale matrix I + own precision^-1 own'
        cov = np.eye(60) + (own @ np.linalg.inv(precision) @ own.T if at else 0)
        log = -0.5 * np.linalg.slogdet(cov)[1] - (60 / 2 + 1) * math.log(0.5 * y @ np.linalg.solve(cov, y) + 0.5)
        weight[inside] = log  # expected size 1.5 of 3: even odds
    total = sum(math.exp(v - max(weight.values())) for v in weight.values())
    for k, t in enumerate("abc"):
        want = sum(math.exp(v - max(weight.values())) for m, v in weight.items() if m[k]) / total
        assert abs(shares[t] - want) < 0.03


def test_sample_is_a_function_of_keys_and_seed(spark):
    df = spark.range(1000)
    draw = lambda d, seed: {r.id for r in relations.sample_rows(d, 100, "id", seed).collect()}
    one = draw(df, 1)
    assert len(one) == 100 and one == draw(df.repartition(7), 1) and len(one & draw(df, 2)) < 30
    assert abs(np.mean(sorted(one)) - 499.5) < 100


def test_sketches_are_merged_within_their_error(spark):
    rng = np.random.default_rng(5)
    v = rng.lognormal(size=40_000)
    df = frame(spark, [v.tolist(), (np.arange(40_000) % 37).tolist()], "v double, day int")
    probs = [0.01, 0.25, 0.5, 0.9, 0.99]
    found = aggregate.sketch_quantiles(aggregate.merge_sketches(aggregate.sketch(df, "v", ["day"]), []), [], probs).collect()
    for r in [*found, *aggregate.quantiles(df, "v", probs, approximate=True).collect()]:
        assert abs((v <= r.quantile).mean() - r.prob) < 0.01


def test_summary_of_odd_columns(spark):
    rows = [(1.0, "a", True), (float("nan"), None, False), (float("inf"), "b", None), (None, "b", True), (3.0, "b", True), (3.0, "c", True)]
    df = spark.createDataFrame(rows, "x double, s string, b boolean").withColumns({"d": F.when(F.col("x") == 3, F.lit("2024-02-29").cast("date")), "arr": F.array("x")})
    got = {(r.variable, r.statistic): r.value for r in aggregate.summary(df).collect()}
    assert (got["x", "observed"], got["x", "missing"], got["x", "distinct_values"], got["x", "q50"], got["x", "q25"]) == (3, 3, 2, 3.0, 2.0)
    assert math.isclose(got["x", "sd"], np.std([1, 3, 3], ddof=1)) and math.isclose(got["x", "mean"], 7 / 3)
    assert (got["s", "levels"], got["s", "missing"], got["b", "is_binary"], got["d", "days"], got["d", "missing"], got["d", "first"]) == (3, 1, 1, 1, 4, 1709164800.0)
    assert aggregate.summary(df.select("arr")).count() == 0
    empty = {(r.variable, r.statistic): r.value for r in aggregate.summary(df.filter("x = 77").select("x")).collect()}
    assert empty == {} or empty["x", "observed"] == 0


def test_published_tail_values():
    assert abs(sufficient.chi_square_p(3.841459, 1) - 0.05) < 1e-6 and abs(sufficient.chi_square_p(18.307038, 10) - 0.05) < 1e-6
    assert abs(sufficient.student_p(2.228139, 10) - 0.05) < 1e-6 and abs(sufficient.f_p(4.102821, 2, 10) - 0.05) < 1e-6


def test_linear_model_table(spark):
    rng = np.random.default_rng(6)
    a, c = rng.normal(size=40), rng.normal(size=40)
    y = 1 + 0.5 * a + rng.normal(size=40)
    df = frame(spark, [a.tolist(), c.tolist(), y.tolist()], "a double, c double, y double")
    terms, table = sufficient.lm(df, "y", {"one": F.lit(1.0), "a": F.col("a"), "c": F.col("c")})
    x = np.stack([np.ones(40), a, c], axis=1)
    b = np.linalg.lstsq(x, y, rcond=None)[0]
    sse, syy = ((y - x @ b) ** 2).sum(), ((y - y.mean()) ** 2).sum()
    rows = {r.source: r for r in table.collect()}
    assert np.allclose([r.estimate for r in terms.collect()], b) and all(0 <= r.p <= 1 for r in terms.collect())
    assert (rows["model"].df, rows["residual"].df, rows["total"].df) == (2, 37, 39)
    assert np.allclose([rows["model"].ss, rows["residual"].ss, rows["model"].f, rows["model"].r2], [syy - sse, sse, (syy - sse) / 2 / (sse / 37), 1 - sse / syy])


def test_windows_of_any_length(spark):
    days = spark.sql("SELECT explode(sequence(DATE'2020-01-01', DATE'2022-12-31')) AS g")
    windows = spark.sql("SELECT * FROM VALUES ('long', DATE'2020-03-01', DATE'2022-02-28'), ('short', DATE'2021-01-31', DATE'2021-02-01'), ('one', DATE'2020-01-01', DATE'2020-01-01'), ('back', DATE'2021-01-02', DATE'2021-01-01'), ('open', DATE'2021-01-02', NULL) AS w(name, first, last)")
    for width in (1, 8, 32, 5000):
        got = {r.name: (r.n, str(r.a), str(r.b)) for r in relations.within(days, F.col("g"), windows, width).groupBy("name").agg(F.count("*").alias("n"), F.min("g").alias("a"), F.max("g").alias("b")).collect()}
        assert got == {"long": (730, "2020-03-01", "2022-02-28"), "short": (2, "2021-01-31", "2021-02-01"), "one": (1, "2020-01-01", "2020-01-01")}


def test_whole_vectors_give_their_cross_products(spark):
    rng = np.random.default_rng(7)
    m = rng.normal(size=(50, 5))
    rows = [(k % 2 if k % 9 else None, v) for k, v in enumerate(m.tolist())] + [(0, None), (0, [1.0, 2.0]), (1, [1.0, None, 1.0, 1.0, 1.0])]
    out = sufficient.mvn(spark.createDataFrame(rows, "g int, v array<double>"), "v", ["g"], 5).collect()
    for g in (0, 1, None):
        own = m[[k for k, (x, v) in enumerate(rows[:50]) if x == g]]
        got = {(r.i, r.j): r for r in out if r.g == g}
        assert len(got) == 15 and all(r.n == len(own) for r in got.values())
        s = (own - own.mean(axis=0)).T @ (own - own.mean(axis=0))
        assert all(math.isclose(r.s, s[i, j], abs_tol=1e-9) and math.isclose(r.mean_j, own[:, j].mean(), abs_tol=1e-12) for (i, j), r in got.items())
