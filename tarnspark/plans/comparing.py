"""Queries for comparisons, robust regressions and pooling."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnspark.operators import compare

from .profile import rounded
from .register import ORACLES, query, table


@query("""WITH c AS (SELECT sum((event_type = 'purchase')::INT) FILTER (user_id % 2 = 0) AS y1, count(*) FILTER (user_id % 2 = 0) AS n1,
    sum((event_type = 'purchase')::INT) FILTER (user_id % 2 = 1) AS y2, count(*) FILTER (user_id % 2 = 1) AS n2 FROM events),
  p AS (SELECT y1, n1, y2, n2, y1 + 1 AS a1, n1 - y1 + 1 AS b1, y2 + 1 AS a2, n2 - y2 + 1 AS b2, unnest(range(y2::BIGINT + 1)) AS i FROM c)
  SELECT y1::BIGINT AS y1, n1, y2::BIGINT AS y2, n2, round(sum(exp(lgamma(a1 + i) + lgamma(b1 + b2) - lgamma(a1 + i + b1 + b2) - ln(b2 + i) - lgamma(1 + i) - lgamma(b2) + lgamma(1 + i + b2) - lgamma(a1) - lgamma(b1) + lgamma(a1 + b1))), 6) AS probability FROM p GROUP BY y1, n1, y2, n2""")
def compare_proportions(spark, d):
    events = table(spark, d, "events").withColumn("g", F.col("user_id") % 2)
    return rounded(compare.compare_proportions(events, "g", F.col("event_type") == "purchase", 0, 1))


query(ORACLES["compare_proportions"], "compare_proportions_all")(compare_proportions)


@query("""WITH s AS (SELECT count(*) AS n, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept, sum((y - x) ** 2) AS sse0, regr_syy(y, x) - regr_slope(y, x) ** 2 * regr_sxx(y, x) AS sse1
    FROM (SELECT l_quantity AS x, l_extendedprice / 1000 AS y FROM lineitem))
  SELECT n, round(intercept, 6) AS intercept, round(slope, 6) AS slope, round((sse0 - sse1) / 2 / (sse1 / (n - 2)), 4) AS f FROM s""")
def compare_predictions(spark, d):
    out = compare.compare_predictions(table(spark, d, "lineitem"), F.col("l_quantity"), F.col("l_extendedprice") / 1000)
    return out.select("n", F.round("intercept", 6).alias("intercept"), F.round("slope", 6).alias("slope"), F.round("f", 4).alias("f"))


@query("SELECT event_type, count(*) AS n, round(sqrt(-0.5 * ln(0.025) / count(*)), 8) AS critical FROM events GROUP BY 1")
def ks_critical_value(spark, d):
    return rounded(table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n")).withColumn("critical", compare.ks_critical_value(F.col("n"), 0.05)), 8)


@query("""WITH l AS (SELECT value AS y, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS x FROM events)
  SELECT 'lag1' AS term, round(regr_slope(y, x), 5) AS estimate FROM l UNION ALL SELECT 'intercept', round(regr_intercept(y, x), 5) FROM l""")
def autoregression(spark, d):
    return rounded(compare.autoregression(table(spark, d, "events"), "value", ["user_id"], ["ts", "event_id"], 1), 5)


@query("""WITH g AS (SELECT o_custkey, count(*) AS n, avg(o_totalprice) AS mean, coalesce(var_samp(o_totalprice), 0) AS v FROM orders GROUP BY 1),
  t AS (SELECT avg(mean) AS centre, sum((n - 1) * v) / sum(n - 1) AS within, greatest(var_samp(mean) - sum((n - 1) * v) / sum(n - 1) * avg(1.0::DOUBLE / n), 0) AS between_ FROM g)
  SELECT o_custkey, n, round(mean, 4) AS mean, round(centre + between_ / (between_ + within / n) * (mean - centre), 4) AS pooled FROM g, t""")
def partial_pooling(spark, d):
    return rounded(compare.partial_pooling(table(spark, d, "orders"), "o_totalprice", "o_custkey"), 4)


@query()
def quantile_regression(spark, d):
    return compare.quantile_regression(table(spark, d, "lineitem"), F.col("l_extendedprice") / 1000, {"intercept": F.lit(1.0), "quantity": F.col("l_quantity")}, 0.9)


@query()
def student_regression(spark, d):
    return compare.student_regression(table(spark, d, "lineitem"), F.col("l_extendedprice") / 1000, {"intercept": F.lit(1.0), "quantity": F.col("l_quantity")}, nu=4.0, scale=10.0)


@query()
def one_step_errors(spark, d):
    days = table(spark, d, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.sum("value").alias("value"))
    return compare.one_step_errors(days, "value", ["event_type"], ["day"], level_var=10.0, slope_var=0.1, noise_var=100.0, season=7, season_var=1.0)
