"""Gramians in tiles against numpy, and the predictors that a screen of thousands has to find."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tarnspark.operators import wide


def _assembled(tiles, k):
    g = np.full((k, k), np.nan)
    for r in tiles.collect():
        start = r.tile_j * 7
        g[r.i, start : start + len(r["values"])] = r["values"]
        g[start : start + len(r["values"]), r.i] = r["values"]
    return g


def test_tiles_equal_numpy(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 30)) @ rng.normal(size=(30, 30)) + 1e7
    rows = [(int(k), [float(v) for v in r]) for k, r in enumerate(x)]
    odd = [(-1, None), (-2, [1.0]), (-3, [None] * 30), (-4, [float("nan")] * 30)]
    df = spark.createDataFrame(rows + odd, "k int, v array<double>").repartition(5)
    d = x - x.mean(axis=0)
    n, mean = wide.centre(df, "v", 30)
    assert n == 400 and np.allclose(mean, x.mean(axis=0), rtol=1e-14)
    for cells in (60, 1 << 22):  # one tile at a time, or all at once
        assert np.allclose(_assembled(wide.gramian_tiles(df, "v", 30, block=7, cells=cells), 30), d.T @ d, rtol=1e-9, atol=1e-6)
    assert wide.gramian_tiles(df.limit(0), "v", 30, block=7).count() == 0
    with pytest.raises(ValueError, match="no row"):
        wide.screen(df.limit(0), F.lit(1.0), "v", 30)


def test_the_effects_of_ten_thousand_predictors(spark):
    n, p, at, effects = 5000, 10000, [0, 3, 22, 93], [8.0, -5.0, 6.0, 4.0]

    def rows(frames):
        for frame in frames:
            for k in frame["id"]:
                rng = np.random.default_rng((11, int(k)))
                x = rng.normal(size=p)
                yield pd.DataFrame({"x": [x], "y": [5.0 + float(x[at] @ effects) + rng.normal(0.0, 3.0)]})

    df = spark.range(0, n, 1, 16).mapInPandas(rows, "x array<double>, y double")
    found = {r.predictor: r for r in wide.wide_spike_and_slab(df, F.col("y"), "x", p, screening=10, draws=100, burn=20).collect()}
    sure = {k: r for k, r in found.items() if r.inclusion > 0.9}
    assert sorted(sure) == at
    assert all(abs(sure[k].mean - e) < 0.2 and 0 < sure[k].sd < 0.1 for k, e in zip(at, effects))
