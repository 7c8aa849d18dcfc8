"""Robust regressions and the seasonal filter, against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnspark.operators import compare


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(1)
    x = rng.uniform(0, 10, 800)
    y = 2 + 3 * x + rng.standard_t(3, 800) * (1 + 0.3 * x)
    return x, y


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame([(float(a), float(b)) for a, b in zip(*rows, strict=True)], "x double, y double")


def design():
    return {"intercept": F.lit(1.0), "x": F.col("x")}


@pytest.mark.parametrize("q", [0.1, 0.5, 0.9])
def test_quantile_regression_leaves_its_share_below(df, rows, q):
    b = {r.term: r.estimate for r in compare.quantile_regression(df, F.col("y"), design(), q).collect()}
    x, y = rows
    below = (y < b["intercept"] + b["x"] * x).mean()
    assert abs(below - q) < 0.01

    def loss(i, s):
        r = y - i - s * x
        return np.where(r > 0, q * r, (q - 1) * r).sum()

    best = loss(b["intercept"], b["x"])
    assert all(best <= loss(b["intercept"] + i, b["x"] + s) * 1.0005 for i in (-0.3, 0, 0.3) for s in (-0.1, 0, 0.1))


def test_student_regression_meets_its_equations(df, rows):
    b = {r.term: r.estimate for r in compare.student_regression(df, F.col("y"), design(), 4.0, 2.0).collect()}
    x, y = rows
    r = y - b["intercept"] - b["x"] * x
    w = 5 / (4 + (r / 2) ** 2)
    assert abs((w * r).sum()) < 1e-4 * len(x) and abs((w * r * x).sum()) < 1e-3 * len(x)


def test_one_step_errors_of_a_trend_with_a_season_vanish(spark):
    season = [3.0, -1.0, 2.0, -4.0]
    values = [(s, t, 5 + 2 * t + season[t % 4] * (s + 1)) for s in range(3) for t in range(40)]
    df = spark.createDataFrame([(s, t, None if t == 30 else v) for s, t, v in values], "s long, t long, v double")
    out = compare.one_step_errors(df, "v", ["s"], ["t"], level_var=0.0, slope_var=0.0, noise_var=1e-6, season=4).collect()
    assert len(out) == 120
    for r in out:
        assert (r.error is None or np.isnan(r.error)) if r.t == 30 else r.t < 8 or abs(r.error) < 1e-2


def test_pooling_of_one_group_and_none(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0)], "g string, v double")
    one = compare.partial_pooling(df, "v", "g").collect()
    assert [(r.g, r.n, r.mean, r.pooled) for r in one] == [("a", 2, 2.0, 2.0)]
    assert compare.partial_pooling(df.filter("v < 0"), "v", "g").count() == 0


def test_rates_compare_alike_by_sum_and_for_any_counts():
    from math import exp, fsum, lgamma, log

    from tarnspark.operators.sufficient import compare_rates

    def beta(p, q):
        return lgamma(p) + lgamma(q) - lgamma(p + q)

    for y1, n1, y2, n2 in [(0, 0, 0, 0), (3, 10, 5, 9), (0, 40, 2, 7), (0, 3, 900, 5000), (70, 400, 61, 401), (1000, 5000, 1040, 5000)]:
        a1, b1, a2, b2 = y1 + 1, n1 - y1 + 1, y2 + 1, n2 - y2 + 1
        want = fsum(exp(beta(a1 + i, b1 + b2) - log(b2 + i) - beta(1 + i, b2) - beta(a1, b1)) for i in range(a2))
        assert abs(compare_rates(y1, n1, y2, n2) - want) < 1e-9
    far = compare_rates(200_000_000, 10**9, 200_010_000, 10**9)  # z = 0.559
    assert abs(far - 0.711953) < 1e-3
    assert compare_rates(1, 10, 9 * 10**8, 10**9) > 0.99 and compare_rates(9 * 10**8, 10**9, 1, 10) < 0.01


def test_whole_tables_are_compared_and_put_on_a_grid(spark, tmp_path):
    from tarnspark.plans.catalogue import QUERIES

    events = spark.range(1000).selectExpr("id AS event_id", "timestamp'2024-01-01' + make_interval(0, 0, 0, CAST(id AS int)) AS ts", "id % 2 AS user_id", "if(id >= 800, 'purchase', 'view') AS event_type", "1.0D AS value")
    events.write.parquet(f"{tmp_path}/events.parquet")
    spark.sql("SELECT 1L AS o_orderkey, timestamp'2024-01-01' AS o_orderdate UNION ALL SELECT 2, timestamp'2024-01-04' UNION ALL SELECT 3, timestamp'2024-01-04'").write.parquet(f"{tmp_path}/orders.parquet")
    r = QUERIES["compare_proportions_all"](spark, str(tmp_path)).first()
    assert (r.y1, r.n1, r.y2, r.n2) == (100, 500, 100, 500) and abs(r.probability - 0.5) < 1e-6
    r = QUERIES["regularity_all"](spark, str(tmp_path)).first()
    assert (r.n, r.days, r.is_regular) == (1000, 1000, True)
    assert [(x.day, x.n) for x in QUERIES["regularize_all"](spark, str(tmp_path)).orderBy("place").collect()] == [("2024-01-01", 1), ("2024-01-02", None), ("2024-01-03", None), ("2024-01-04", 2)]
