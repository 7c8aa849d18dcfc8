"""Numbering, running sums and predecessors over all rows in one order, without sorting them in a single task.

A first aggregation finds approximate quantiles of the key; rows are dealt by the stretch between two of them, each
stretch is worked on by a window of its own, and a table of one row a stretch carries on what came before it. Stretches
go by the key's value, so rows of equal keys stay together, and both passes deal alike. A null key comes first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .folders import new_path

#: Stretches at most; the table of them is what gets broadcast.
MOST_STRETCHES = 1000


def beside(df: DataFrame, other: DataFrame, by: Sequence[str], both: Sequence[str] = ()) -> DataFrame:
    """df with the columns of `other`, which has one row a group of `by` (NULL is a group too) and of `both`."""
    named = other.withColumnsRenamed({c: f"_g_{c}" for c in [*by, *both]})
    on = [df[c].eqNullSafe(named[f"_g_{c}"]) for c in [*by, *both]]
    return df.join(named, on, "left").drop(*[f"_g_{c}" for c in [*by, *both]])


def _stretched(df: DataFrame, key: str, by: Sequence[str] = ()) -> DataFrame:
    """df with _b, the stretch of its key (within its group), 0 for the least. key: a number, date or timestamp."""
    n = min(MOST_STRETCHES, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cuts = df.groupBy(*by).agg(F.percentile_approx(key, [k / n for k in range(1, n)] or [0.5], max(100, 10 * n)).alias("_cuts"))
    inside = F.size(F.filter(F.coalesce("_cuts", F.array()), lambda c: c < F.col(key)))
    held = beside(df, cuts, by) if by else df.join(F.broadcast(cuts))
    return held.withColumn("_b", F.coalesce(inside, F.lit(0))).drop("_cuts")


def _carried(rows: DataFrame, what: Column, how, by: Sequence[str] = ()) -> DataFrame:
    """_b and _before: `how` (a function for a window) over what the stretches before it give."""
    each = rows.groupBy(*by, "_b").agg(what.alias("_each"))
    return each.select(*by, "_b", how("_each").over(Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))


def numbered(df: DataFrame, key: str, name: str, ties: Sequence[str] = ()) -> DataFrame:
    """df with the place of each row, from 1, by key and then ties."""
    rows = _stretched(df, key)
    own = F.row_number().over(Window.partitionBy("_b").orderBy(key, *ties))
    out = rows.join(F.broadcast(_carried(rows, F.count("*"), F.sum)), "_b")
    return out.withColumn(name, own + F.coalesce("_before", F.lit(0))).drop("_b", "_before")


def running(df: DataFrame, key: str, value: str, name: str, ties: Sequence[str] = (), by: Sequence[str] = ()) -> DataFrame:
    """df with the sum of value over all rows up to each, by key and then ties; within groups of `by`, each in its own stretches."""
    rows = _stretched(df, key, by)
    own = F.sum(value).over(Window.partitionBy(*by, "_b").orderBy(key, *ties).rowsBetween(Window.unboundedPreceding, 0))
    before = _carried(rows, F.sum(value), F.sum, by)
    out = beside(rows, before, by, ["_b"]) if by else rows.join(F.broadcast(before), "_b")
    return out.withColumn(name, F.coalesce(own, F.lit(0)) + F.coalesce("_before", F.lit(0))).drop("_b", "_before")


def previous(df: DataFrame, key: str, name: str) -> DataFrame:
    """df with the key of the row before each; null for the first."""
    rows = _stretched(df, key)
    own = F.lag(key).over(Window.partitionBy("_b").orderBy(key))
    out = rows.join(F.broadcast(_carried(rows, F.max(key), F.max)), "_b")
    return out.withColumn(name, F.coalesce(own, "_before")).drop("_b", "_before")


def coded(levels: DataFrame, x: str, name: str) -> DataFrame:
    """Distinct values of any type that sorts, with their places from 0. They are dealt by range and written once, so that
    both passes see the same stretches; each is numbered by itself."""
    path = new_path(levels.sparkSession, "levels")
    levels.repartitionByRange(x).select(x, F.spark_partition_id().alias("_b")).write.parquet(path)
    rows = levels.sparkSession.read.schema(f"`{x}` {levels.schema[x].dataType.simpleString()}, _b int").parquet(path)
    out = rows.join(F.broadcast(_carried(rows, F.count("*"), F.sum)), "_b")
    place = F.row_number().over(Window.partitionBy("_b").orderBy(x)) - 1 + F.coalesce("_before", F.lit(0))
    return out.select(x, place.cast("bigint").alias(name))
