"""Queries of structural time series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnspark.functions import folders
from tarnspark.operators import structural as T
from tarnspark.streaming import aggregates, filters

from .profile import rounded
from .register import query, table

#: Of the numbers of orders a day; the SQL goes through the same steps one after another.
_DAYS = """d AS (SELECT o_orderdate::DATE AS day, count(*) AS n FROM orders GROUP BY 1),
  y AS (SELECT (day - DATE '1995-01-01')::BIGINT AS t, coalesce(n, 0)::DOUBLE AS y FROM (SELECT unnest(generate_series((SELECT min(day) FROM d), (SELECT max(day) FROM d), INTERVAL 1 DAY))::DATE AS day) LEFT JOIN d USING (day)),
  s AS (SELECT (SELECT min(t) FROM y) - 1 AS t, NULL::DOUBLE AS y, NULL::DOUBLE AS predicted, NULL::DOUBLE AS f, 10.0::DOUBLE AS m, 100.0::DOUBLE AS p
    UNION ALL SELECT y.t, y.y, s.m, s.p + 6.5, s.m + (s.p + 1.5) / (s.p + 6.5) * (y.y - s.m), (s.p + 1.5) * 5.0 / (s.p + 6.5) FROM s JOIN y ON y.t = s.t + 1)"""


def _daily(spark, d: str) -> DataFrame:
    """t (days since 1995), y (orders), first (of a month), with a row for each day from the first order to the last."""
    n = table(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("n"))
    days = n.agg(F.sequence(F.min("day"), F.max("day")).alias("days")).select(F.explode("days").alias("day"))
    out = days.join(n, "day", "left")
    return out.select(F.datediff("day", F.lit("1995-01-01").cast("date")).cast("bigint").alias("t"), F.coalesce("n", F.lit(0)).cast("double").alias("y"), (F.dayofmonth("day") == 1).alias("first"), (F.dayofweek("day") == 1).cast("double").alias("sunday"), F.last_day("day").alias("month_end"), "day")


def _walk() -> T.Model:
    return T.Model(T.Structure(), {"noise": 5.0, "level": 1.5}, (10.0,), (100.0,))


@query(f"WITH RECURSIVE {_DAYS} SELECT t, y, round(predicted, 6) AS predicted, round(sqrt(f), 6) AS predicted_sd FROM s WHERE y IS NOT NULL")
def structural_predictions(spark, d):
    """One-step predictions of orders a day by a walking level, in stretches of 100 days."""
    return rounded(T.rows_of(T.packed(_daily(spark, d), "y", "t", [], stretch=100), _walk(), []).select("t", "y", "predicted", "predicted_sd"), 6)


@query(f"WITH RECURSIVE {_DAYS} SELECT (SELECT max(t) FROM y) + k AS t, round(m, 6) AS mean, round(sqrt(p + 1.5 * k + 5.0), 6) AS sd FROM s, range(1, 15) AS r(k) WHERE t = (SELECT max(t) FROM y)")
def structural_forecast(spark, d):
    return rounded(T.forecast(T.packed(_daily(spark, d), "y", "t", [], stretch=100), _walk(), [], 14), 6)


@query(f"WITH RECURSIVE {_DAYS} SELECT t, round(y - predicted, 6) AS error, round((y - predicted) / sqrt(f), 6) AS scaled FROM s WHERE t > 2000")
def structural_holdout(spark, d):
    return rounded(T.holdout_errors(T.packed(_daily(spark, d), "y", "t", [], stretch=100), _walk(), [], 2000), 6)


@query(f"WITH RECURSIVE {_DAYS} SELECT round(sum(-0.5 * (ln(2 * pi() * f) + (y - predicted) ** 2 / f)), 5) AS loglik FROM s WHERE y IS NOT NULL")
def structural_loglik(spark, d):
    return spark.createDataFrame([(round(T.loglik(T.packed(_daily(spark, d), "y", "t", [], stretch=100), _walk()), 5),)], "loglik double")


@query()
def structural_fit(spark, d):
    """Variances of orders a day: a level, a week's season, and Sundays of their own, by likelihood."""
    found = T.fit(T.packed(_daily(spark, d), "y", "t", [], ["sunday"]), T.Structure(season=7, predictors=1))
    return spark.createDataFrame([*found.variances.items(), ("loglik", found.loglik)], "part string, value double")


@query()
def mixed_frequency_nowcast(spark, d):
    """Orders a day, where only their sums over months are known."""
    days = _daily(spark, d)
    monthly = days.groupBy("month_end").agg(F.sum("y").alias("sum"))
    seen = days.join(monthly, "month_end").withColumn("y", F.when(F.col("day") == F.col("month_end"), F.col("sum")))
    model = T.Model(T.Structure(summed=True), {"noise": 1.0, "level": 1.5}, (10.0,), (100.0,))
    return rounded(T.nowcast(T.packed(seen, "y", "t", [], new="first"), model, []), 6)


@query(f"WITH RECURSIVE {_DAYS} SELECT t, y, round(predicted, 6) AS predicted, round(sqrt(f), 6) AS predicted_sd, round(m, 6) AS level, round(sqrt(p), 6) AS level_sd FROM s WHERE y IS NOT NULL")
def streamed_filter(spark, d):
    """Orders a day as a stream of four chunks in order of time, filtered by a walking level whose state is kept in between."""
    path, out, state = (folders.new_path(spark, n) for n in ("series-files", "series-out", "series-state"))
    days = _daily(spark, d).select(F.lit("orders").alias("series"), "t", "y")
    low, high = days.agg(F.min("t"), F.max("t")).first()
    for k in range(4):
        inside = F.floor((F.col("t") - low) * 4 / (high - low + 1)) == k
        days.filter(inside).write.mode("append").parquet(path)
        stream = spark.readStream.schema("series string, t long, y double").parquet(path)
        aggregates.into_table(filters.filtered_stream(stream, filters.Kalman(_walk()), "y", "t", ["series"]), out, state).start().awaitTermination()
    return rounded(spark.read.parquet(out).select("t", "y", "predicted", "predicted_sd", "level", "level_sd"), 6)
