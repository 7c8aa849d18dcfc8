"""Ordered sequences: differences, autocorrelation, transitions, fractional periods, runs, arrivals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _w(by: Sequence[str], order: Sequence[str]):
    return Window.partitionBy(*by).orderBy(*order)


def diff(df: DataFrame, x: str, by: Sequence[str], order: Sequence[str], leading_zero: bool = False) -> DataFrame:
    """df with `difference` from the row before; the first row of a series has 0, or is left out."""
    d = F.col(x) - F.lag(x).over(_w(by, order))
    out = df.withColumn("difference", F.coalesce(d, F.lit(0.0)) if leading_zero else d)
    return out if leading_zero else out.filter(F.col("difference").isNotNull())


def autocorrelation(df: DataFrame, x: str, by: Sequence[str], order: Sequence[str], lags: int, centred: bool = True) -> DataFrame:
    """lag, acf of each series for lags 0 to `lags`. centred=False: of the raw values, divided by the root of the lag-0 product, within -1 and 1."""
    mean = F.avg(x).over(Window.partitionBy(*by)) if centred else F.lit(0.0)
    rows = df.withColumn("_x", F.col(x) - mean)
    rows = rows.withColumns({f"_l{k}": F.lead("_x", k).over(_w(by, order)) for k in range(1, lags + 1)}).withColumn("_l0", F.col("_x"))
    sums = rows.groupBy(*by).agg(F.count("*").alias("_n"), *[F.sum(F.col("_x") * F.col(f"_l{k}")).alias(f"_s{k}") for k in range(lags + 1)])
    if centred:
        value = lambda k: F.try_divide(F.col(f"_s{k}"), F.col("_s0"))
    else:
        value = lambda k: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(F.col(f"_s{k}") / F.col("_n"), F.sqrt(F.col("_s0") / F.col("_n")))))
    return sums.select(*by, F.inline(F.array(*[F.struct(F.lit(k).alias("lag"), value(k).alias("acf")) for k in range(lags + 1)])))


def running_sum(df: DataFrame, x: str, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    return df.withColumn("running", F.sum(x).over(_w(by, order).rowsBetween(Window.unboundedPreceding, 0)))


def ranks(df: DataFrame, by: Sequence[str], order: Sequence) -> DataFrame:
    return df.withColumn("place", (F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1).cast("bigint"))


def transitions(df: DataFrame, state: str, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """previous, next, n over all adjacent pairs of each sequence."""
    rows = df.select(F.lag(state).over(_w(by, order)).alias("previous"), F.col(state).alias("next"))
    return rows.filter("previous IS NOT NULL AND next IS NOT NULL").groupBy("previous", "next").agg(F.count("*").alias("n"))


def initial_states(df: DataFrame, state: str, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    first = df.groupBy(*by).agg(F.min_by(state, F.struct(*order)).alias("state"))
    return first.groupBy("state").agg(F.count("*").alias("n"))


def top_transitions(counts: DataFrame, k: int, share: bool = True, drop_same: bool = False) -> DataFrame:
    """The k largest cells, as shares of their row if asked, without those that stay in a state if asked."""
    rows = counts.withColumn("value", F.col("n") / F.sum("n").over(Window.partitionBy("previous")) if share else F.col("n").cast("double"))
    if drop_same:
        rows = rows.filter("previous <> next")
    return rows.orderBy(F.desc("value"), "previous", "next").limit(k)


def fractional_periods(df: DataFrame, x: str, ends: str, fraction: str, by: Sequence[str], order: Sequence[str], trim: bool = False) -> DataFrame:
    """by, period (from 0), total: fine values summed into coarse periods.

    A row whose `ends` is true holds the end of a coarse period: `fraction` of it falls before the end, the rest into the
    next period. A last period is left out if the last row ends one with a fraction of .9999 or more; with trim, a first
    period is left out if any fraction is below 1, and a last one that is not ended.
    """
    w = _w(by, order)
    f = F.when(F.col(ends), F.col(fraction)).otherwise(1.0)
    rows = df.select(
        *by,
        F.coalesce(F.sum(F.col(ends).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("bigint").alias("_p"),
        F.col(x).alias("_x"),
        f.alias("_f"),
        F.col(ends).alias("_e"),
        (F.lead(F.lit(1)).over(w).isNull() & F.col(ends) & (F.col(fraction) >= 0.9999)).alias("_whole"),
    )
    parts = rows.select(*by, F.inline(F.array(F.struct(F.col("_p").alias("period"), (F.col("_f") * F.col("_x")).alias("v"), F.lit(True).alias("_keep"), "_f", F.col("_e").alias("_ended")), F.struct((F.col("_p") + 1).alias("period"), ((1 - F.col("_f")) * F.col("_x")).alias("v"), (F.col("_e") & ~F.col("_whole")).alias("_keep"), "_f", F.lit(False).alias("_ended")))))
    out = parts.filter("_keep").groupBy(*by, "period").agg(F.sum("v").alias("total"), F.max("_ended").alias("_ended"), F.min("_f").alias("_least"))
    if trim:
        everything = Window.partitionBy(*by)
        out = out.withColumn("_any", F.min("_least").over(everything) < 1).filter("_ended AND NOT (_any AND period = 0)").drop("_any")
    return out.drop("_ended", "_least")


def within_period_sums(df: DataFrame, x: str, ends: str, fraction: str, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """df with `cumulator`: the sum since the last coarse end, with what its row carried over."""
    w = _w(by, order)
    p = F.coalesce(F.sum(F.col(ends).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("bigint")
    f = F.when(F.col(ends), F.col(fraction)).otherwise(1.0)
    rows = df.withColumns({"_period": p, "_own": f * F.col(x), "_carried": F.coalesce(F.lag((1 - f) * F.col(x)).over(w), F.lit(0.0))})
    inside = Window.partitionBy(*by, "_period").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("cumulator", F.sum("_own").over(inside) + F.first("_carried").over(inside)).drop("_own", "_carried", "_period")


def runs(df: DataFrame, active: Column, by: Sequence[str], order: Sequence[str], place: str) -> DataFrame:
    """first, last place of each maximal run of rows where `active` holds."""
    w = _w(by, order)
    rows = df.withColumns({"_on": active, "_n": F.row_number().over(w)}).filter("_on")
    rows = rows.withColumn("_g", F.col("_n") - F.row_number().over(w))
    return rows.groupBy(*by, "_g").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count("*").alias("n")).drop("_g")


def merge_intervals(df: DataFrame, by: Sequence[str], begin: str, end: str) -> DataFrame:
    """Intervals that overlap or adjoin become one."""
    w = _w(by, [begin, end])
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = df.withColumn("_new", F.when(reach.isNull() | (F.col(begin) > reach), 1).otherwise(0))
    rows = rows.withColumn("_g", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*by, "_g").agg(F.min(begin).alias(begin), F.max(end).alias(end), F.count("*").alias("n")).drop("_g")


def interarrivals(df: DataFrame, ts: str, by: Sequence[str], begin: Column, end: Column) -> DataFrame:
    """by, k, seconds: from the window's begin to the first event, between events, and from the last to the window's end."""
    w = _w(by, [ts])
    s = lambda c: F.unix_micros(c.cast("timestamp"))
    inner = df.select(*by, (F.row_number().over(w) - 1).cast("bigint").alias("k"), ((s(F.col(ts)) - F.coalesce(F.lag(s(F.col(ts))).over(w), s(begin))) / 1e6).alias("seconds"))
    closing = df.groupBy(*by).agg(F.count("*").alias("k"), ((s(end) - F.max(s(F.col(ts)))) / 1e6).alias("seconds"))
    return inner.unionByName(closing)


def ends_with(df: DataFrame, state: str, last: str, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """by, valid: whether `last` stands at the end of the sequence, and only there."""
    rows = df.withColumn("_at_end", F.lead(F.lit(1)).over(_w(by, order)).isNull())
    return rows.groupBy(*by).agg(F.min(((F.col(state) == last) == F.col("_at_end"))).alias("valid"))
