"""Mixtures of vectors: a round against numpy, clusters that are there, and labels matched as well as can be."""

import itertools

import numpy as np
from pyspark.sql import functions as F

from tarnspark.operators import mixtures as X


def _clusters(spark, n=900, seed=4):
    rng = np.random.default_rng(seed)
    means = np.array([[0.0, 0.0, 0.0], [6.0, 0.0, 1.0], [0.0, 7.0, -3.0]])
    of = rng.choice(3, n, p=[0.5, 0.3, 0.2])
    x = means[of] + rng.normal(size=(n, 3)) @ np.array([[1.0, 0.4, 0.0], [0.0, 0.9, 0.0], [0.0, 0.0, 0.6]])
    df = spark.createDataFrame([(int(c), [float(v) for v in r]) for c, r in zip(of, x)] + [(0, None), (1, [1.0]), (2, [float("nan")] * 3)], "k int, v array<double>")
    return means, of, x, df.repartition(5)


def test_a_round_equals_numpy(spark):
    means, _, x, df = _clusters(spark)
    start = X.Mixture(np.array([0.2, 0.5, 0.3]), means + 1.5, np.repeat(2 * np.eye(3)[None], 3, axis=0))
    got = X.em_round(df, "v", 3, start, prior_rows=4.0, prior=0.5 * np.eye(3))
    logs = np.stack([np.log(start.weights[k]) - 0.5 * ((x - start.means[k]) ** 2).sum(axis=1) / 2 - 1.5 * np.log(4 * np.pi) for k in range(3)], axis=1)
    r = np.exp(logs - logs.max(axis=1, keepdims=True))
    density = logs.max(axis=1) + np.log(r.sum(axis=1))
    r /= r.sum(axis=1, keepdims=True)
    assert np.isclose(got.loglik, density.mean(), rtol=1e-12) and np.allclose(got.weights, r.mean(axis=0))
    for k in range(3):
        m = r[:, k] @ x / r[:, k].sum()
        d = x - m
        assert np.allclose(got.means[k], m) and np.allclose(got.covariances[k], ((d * r[:, k, None]).T @ d + 2.0 * np.eye(3)) / (r[:, k].sum() + 4.0))


def test_clusters_are_found_and_labels_matched(spark):
    means, of, x, df = _clusters(spark)
    for sticks, components in ((None, 3), (1.0, 8)):
        found = X.fit_mixture(df, "v", 3, components, sticks=sticks, close=1e-6)
        assert np.isclose(found.weights.sum(), 1.0)
        if sticks is None:
            near = [int(np.argmin(((found.means - m) ** 2).sum(axis=1))) for m in means]
            assert sorted(near) == [0, 1, 2] and all(np.abs(found.means[c] - m).max() < 0.3 for c, m in zip(near, means))
            labelled = X.assign(df, "v", 3, found)
            assert labelled.filter("component IS NULL AND chance IS NULL").count() == 3
            pairs = {r.k: r.component for r in X.match_labels(labelled, "k", "component").collect()}
            assert pairs == dict(enumerate(near))
        else:
            logs = found.log_densities(x)
            single = X.em_round(df, "v", 3, X.Mixture(np.ones(1), x.mean(axis=0)[None], np.cov(x.T)[None]))
            assert np.log(np.exp(logs).sum(axis=1)).mean() > single.loglik + 0.3


def test_matches_are_the_best_there_are(spark):
    rng = np.random.default_rng(5)
    for n in range(1, 7):
        for _ in range(20):
            gain = rng.integers(0, 9, (n, n)).astype(float)
            at = X._greatest(gain)
            assert sorted(at) == list(range(n))
            assert sum(gain[i, j] for i, j in enumerate(at)) == max(sum(gain[i, p[i]] for i in range(n)) for p in itertools.permutations(range(n)))
    df = spark.createDataFrame([("x", 1), ("x", 1), ("x", 2), ("y", 1), ("y", 1), ("y", 1), ("z", 2), (None, 2), ("z", None)], "a string, b int")
    assert sorted(((r.a, r.b, r.n) for r in X.match_labels(df, "a", "b").collect()), key=str) in ([("x", 2, 1), ("y", 1, 3), ("z", None, 0)], [("x", None, 0), ("y", 1, 3), ("z", 2, 1)])
    assert X.match_labels(df.limit(0), "a", "b").count() == 0
