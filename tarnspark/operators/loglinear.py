"""Log-linear models: expected counts of a table's cells whose margins are the data's, by proportional fitting; and rates of a week."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnspark.functions.folders import new_path

#: Rounds between two looks at how far margins are off.
TOGETHER = 4


def cells(df: DataFrame, factors: Sequence[str], count: str | None = None, limit: int = 1_000_000) -> DataFrame:
    """factors, _n: every combination of the levels that occur, with its rows (or the sum of `count`); NULL is no level.

    Combinations come from the lists of levels, a row at a time; more than `limit` of them raise."""
    known = df.dropna(subset=list(factors))
    found = known.groupBy(*factors).agg((F.count("*") if count is None else F.sum(count)).cast("double").alias("_n"))
    levels = found.agg(*[F.sort_array(F.collect_set(f)).alias(f) for f in factors])
    sizes = levels.select(*[F.size(f) for f in factors]).first()
    if math.prod(sizes) > limit:
        raise ValueError(f"{math.prod(sizes)} cells are more than {limit}")
    whole = levels
    for f in factors:
        whole = whole.withColumn(f, F.explode(f))
    return whole.join(found, list(factors), "left").withColumn("_n", F.coalesce("_n", F.lit(0.0)))


def loglinear_fit(df: DataFrame, factors: Sequence[str], margins: Sequence[Sequence[str]], count: str | None = None, close: float = 1e-9, rounds: int = 1000) -> DataFrame:
    """factors, n, fitted: the counts that a log-linear model with these margins (and all below them) expects, by likelihood.

    Each round brings one margin after another to the data's, by a sum over the cells that share it. After TOGETHER rounds the
    cells are written to the shared folder; they are done once no margin is off by `close` of the largest, and raise after
    `rounds`. A cell whose margin is 0 is expected to be 0.
    """
    spark = df.sparkSession
    now = cells(df, factors, count).withColumn("_fit", F.lit(1.0))
    over = [Window.partitionBy(*m) if m else Window.partitionBy(F.lit(0)) for m in margins]
    now = now.withColumns({f"_m{k}": F.sum("_n").over(w) for k, w in enumerate(over)})
    for _ in range(max(1, rounds // TOGETHER)):
        for _ in range(TOGETHER):
            for k, w in enumerate(over):
                total = F.sum("_fit").over(w)
                now = now.withColumn("_fit", F.when(total > 0, F.col("_fit") * F.col(f"_m{k}") / total).otherwise(0.0))
        path = new_path(spark, "loglinear")
        now.write.parquet(path)
        now = spark.read.schema(now.schema).parquet(path)
        off = now.select(*[F.abs(F.sum("_fit").over(w) - F.col(f"_m{k}")).alias(f"o{k}") for k, w in enumerate(over)], *[F.col(f"_m{k}") for k in range(len(over))])
        row = off.agg(F.max(F.greatest(F.lit(0.0), *[F.col(f"o{k}") for k in range(len(over))])), F.max(F.greatest(F.lit(0.0), *[F.col(f"_m{k}") for k in range(len(over))]))).first()
        if (row[0] or 0.0) <= close * max(row[1] or 0.0, 1e-300):
            return now.select(*factors, F.col("_n").alias("n"), F.col("_fit").alias("fitted"))
    raise RuntimeError(f"no convergence in {rounds} rounds")


def deviance(fitted: DataFrame) -> DataFrame:
    """g2 and x2 of a fit: twice the log likelihood ratio against the counts themselves, and Pearson's sum."""
    n, m = F.col("n"), F.col("fitted")
    return fitted.agg(F.sum(2 * F.when(n > 0, n * F.ln(n / m)).otherwise(0.0) - 2 * (n - m)).alias("g2"), F.sum(F.when(m > 0, (n - m) ** 2 / m)).alias("x2"))


# --- the week ---


def week_exposure(windows: DataFrame, start: str, end: str, by: Sequence[str] = ()) -> DataFrame:
    """by, day (1 is Sunday), hour, exposure (hours): how long windows of time [start, end) lie in each hour of the week.

    A window is split at full hours; whole weeks in it are counted at once, so it gives 168 rows and those of a week at most.
    A window that ends before it starts, or misses an end, has no time."""
    s, e = F.unix_micros(F.col(start).cast("timestamp")), F.unix_micros(F.col(end).cast("timestamp"))
    hour = 3_600_000_000
    week = 168 * hour
    rows = windows.select(*by, s.alias("_s"), e.alias("_e")).filter("_s < _e").withColumn("_weeks", F.floor((F.col("_e") - F.col("_s")) / week)).withColumn("_s", F.col("_s") + F.col("_weeks") * week)
    first = F.floor(F.col("_s") / hour)
    part = rows.filter("_s < _e").select(*by, "_s", "_e", F.explode(F.sequence(first, F.floor((F.col("_e") - 1) / hour))).alias("_h"))
    part = part.select(*by, F.col("_h"), ((F.least("_e", (F.col("_h") + 1) * hour) - F.greatest("_s", F.col("_h") * hour)) / hour).alias("_x"))
    whole = rows.filter("_weeks > 0").groupBy(*by).agg(F.sum("_weeks").cast("double").alias("_x")).select(*by, F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(167).cast("bigint"))).alias("_h"), "_x")
    at = F.timestamp_seconds(F.col("_h") * 3600)
    both = part.unionByName(whole)
    return both.groupBy(*by, F.dayofweek(at).alias("day"), F.hour(at).alias("hour")).agg(F.sum("_x").alias("exposure"))


def weekly_rates(counts: DataFrame, exposures: DataFrame, close: float = 1e-12, rounds: int = 10_000) -> DataFrame:
    """day, hour, n, exposure, rate: a Poisson rate an hour that is the product of a day's effect and an hour's, the hours of
    Saturdays and Sundays apart from those of other days; by likelihood.

    counts: day, hour, n; exposures: day, hour, exposure: 168 rows each at most, which are all that comes to the driver. Effects
    are found in turns; each turn makes days', then hours' expected counts those of the data.
    """
    n, x = np.zeros((7, 24)), np.zeros((7, 24))
    for r in counts.select("day", "hour", "n").collect():
        n[r.day - 1, r.hour] += r.n
    for r in exposures.select("day", "hour", "exposure").collect():
        x[r.day - 1, r.hour] += r.exposure
    if (n[x <= 0] > 0).any():
        raise ValueError("events stand at hours that no window holds")
    free = np.array([True, *[False] * 5, True])
    day, hours = np.ones(7), np.ones((2, 24))
    share = lambda a, b: np.divide(a, b, out=np.zeros_like(a), where=b > 0)
    for _ in range(rounds):
        before = day[:, None] * hours[free.astype(int)]
        day = share(n.sum(axis=1), (x * hours[free.astype(int)]).sum(axis=1))
        for k, on in enumerate((~free, free)):
            hours[k] = share(n[on].sum(axis=0), (x[on] * day[on, None]).sum(axis=0))
        now = day[:, None] * hours[free.astype(int)]
        if np.abs(now - before).max() <= close * max(now.max(), 1e-300):
            rows = [(d + 1, h, float(n[d, h]), float(x[d, h]), float(now[d, h])) for d in range(7) for h in range(24)]
            return counts.sparkSession.createDataFrame(rows, "day int, hour int, n double, exposure double, rate double")
    raise RuntimeError(f"no convergence in {rounds} turns")
