"""Rows, joins, sets, order and sampling. Where order matters a key names it."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnspark.functions.ordered import coded, numbered, running


# --- rows and columns ---


def level_codes(df: DataFrame, x: str, name: str = "code") -> DataFrame:
    """df with the place of x among its sorted distinct values, from 0, of which no task sorts more than a range."""
    codes = coded(df.filter(F.col(x).isNotNull()).select(F.col(x).alias("_level")).distinct(), "_level", name)
    return df.join(codes, df[x] == codes["_level"], "left").drop("_level")


def set_cell(df: DataFrame, key: str, value, column: str, new) -> DataFrame:
    return df.withColumn(column, F.when(F.col(key) == value, F.lit(new)).otherwise(F.col(column)))


def bind_columns(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Columns of b beside those of a, row by row by an explicit key; names that clash get a suffix."""
    renamed = [F.col(c).alias(c if c not in a.columns else f"{c}_2") for c in b.columns if c != key]
    return a.join(b.select(key, *renamed), key)


def expand(part: DataFrame, full: DataFrame, key: str, column: str, fill) -> DataFrame:
    """A filtered column spread over the full index again, `fill` where it was filtered out."""
    return full.select(key).join(part.select(key, column), key, "left").select(key, F.coalesce(column, F.lit(fill)).alias(column))


def first_true(df: DataFrame, condition: Column, key: str) -> DataFrame:
    return df.agg(F.min(F.when(condition, F.col(key))).alias("first"))


def repeat_rows(df: DataFrame, n: Column) -> DataFrame:
    """Each row n times (none where n is below 1), with its number `copy` from 0."""
    return df.select("*", F.explode(F.sequence(F.lit(0), F.greatest(n, F.lit(0)).cast("int"))).alias("copy")).filter(F.col("copy") < n)


def permute(df: DataFrame, place: str, mapping: DataFrame) -> DataFrame:
    """Rows at mapping.source go to mapping.target."""
    return df.join(mapping, df[place] == mapping["source"]).drop(place, "source").withColumnRenamed("target", place)


def every_kth(df: DataFrame, key: str, k: int, burn: int = 0) -> DataFrame:
    """Rows after the first `burn` by key, every k-th of them."""
    return numbered(df, key, "_n").filter((F.col("_n") > burn) & ((F.col("_n") - burn) % k == 0)).drop("_n")


# --- joins ---


def find(needles: DataFrame, haystack: DataFrame, value: str, place: str) -> DataFrame:
    """place, found: where each value stands in the other table; its k-th repeat takes the k-th repeat there, -1 if there is none."""
    turn = lambda df: df.withColumn("_k", F.row_number().over(Window.partitionBy(value).orderBy(place)))
    right = turn(haystack).select(F.col(value).alias("_v"), F.col("_k").alias("_r"), F.col(place).alias("found"))
    left = turn(needles)
    return left.join(right, (left[value] == right["_v"]) & (left["_k"] == right["_r"]), "left").select(place, F.coalesce("found", F.lit(-1)).alias("found"))


def match_rows(a: DataFrame, b: DataFrame, columns: Sequence[str], place: str) -> DataFrame:
    """place in a, match in b: the first row of b that equals a's in all columns (NULL equals NULL); NULL where none does."""
    first = b.groupBy(*[F.col(c).alias(f"_{c}") for c in columns]).agg(F.min(place).alias("match"))
    on = reduce(lambda x, y: x & y, [a[c].eqNullSafe(first[f"_{c}"]) for c in columns])
    return a.join(first, on, "left").select(a[place], "match")


def lookup(df: DataFrame, names: DataFrame, key: str, value: str, default) -> DataFrame:
    """df with `value` of the other table by key, or the default; Spark broadcasts that table if it is small."""
    return df.join(names.select(key, value), key, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def within(df: DataFrame, day: Column, windows: DataFrame, width: int = 32) -> DataFrame:
    """df joined with the windows (name, first, last) that hold its day, however long they are.

    Windows are opened into stretches of `width` days for an equi-join; the days themselves decide. Windows that end before
    they begin, or have no end, hold nothing.
    """
    stretch = lambda c: F.floor(F.datediff(c, F.lit("1970-01-01").cast("date")) / width)
    opened = windows.filter("first <= last").select("name", "first", "last", F.explode(F.sequence(stretch("first"), stretch("last"))).alias("_stretch"))
    rows = df.withColumn("_day", day).withColumn("_stretch", stretch("_day"))
    return rows.join(opened, "_stretch").filter(F.col("_day").between(F.col("first"), F.col("last"))).drop("_day", "_stretch")


def factorial(spark, levels: dict[str, Sequence[str]]) -> DataFrame:
    """Every combination of the factors' levels, one row each."""
    out = None
    for name, values in levels.items():
        one = spark.createDataFrame([(v,) for v in values], f"`{name}` string")
        out = one if out is None else out.crossJoin(F.broadcast(one))  # level lists are given by the caller
    return out


def merge_counts(a: DataFrame, b: DataFrame, keys: Sequence[str], n: str) -> DataFrame:
    return a.select(*keys, n).unionByName(b.select(*keys, n)).groupBy(*keys).agg(F.sum(n).alias(n))


def multiply_potentials(a: DataFrame, b: DataFrame, keep: Sequence[str], weight: str = "p") -> DataFrame:
    """Product of two clique tables on their shared variables, summed over those that aren't kept."""
    on = [c for c in a.columns if c in b.columns and c != weight]
    joined = a.withColumnRenamed(weight, "_a").join(b.withColumnRenamed(weight, "_b"), on)
    return joined.groupBy(*keep).agg(F.sum(F.col("_a") * F.col("_b")).alias(weight))


# --- order, top and samples ---


def top(df: DataFrame, by: Sequence[Column], k: int) -> DataFrame:
    return df.orderBy(*by).limit(k)


def sample_rows(df: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """n rows without replacement: those of least keyed hash, the same for the same seed whatever the partitioning."""
    return df.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key).limit(n)


def resample(df: DataFrame, weight: str, key: str, n: int, seed: int = 0) -> DataFrame:
    """n draws with replacement, by weight: sorted cumulative weights meet evenly spaced jittered draws in an equi-join of steps.

    A NULL weight counts as 0; one below 0 fails the job. Each row's number of draws is how many of the n points fall into its stretch.
    """
    given = F.coalesce(F.col(weight).cast("double"), F.lit(0.0))
    w = F.when(given < 0, F.raise_error(F.concat(F.lit("a weight below 0: "), given.cast("string"))).cast("double")).otherwise(given)
    rows = df.withColumn("_w", w).filter("_w > 0")
    total = rows.agg(F.sum("_w").alias("_t"))
    jitter = (seed * 0.618033988749895) % 1.0
    points = lambda x: F.floor(x / F.col("_t") * n + jitter)
    counted = running(rows, key, "_w", "_c").join(F.broadcast(total)).withColumn("draws", (points(F.col("_c")) - points(F.col("_c") - F.col("_w"))).cast("bigint"))
    return counted.filter("draws > 0").drop("_w", "_c", "_t")


def importance_resample(df: DataFrame, log_target: str, log_proposal: str, key: str, n: int, seed: int = 0) -> DataFrame:
    """`resample` by the ratio of target to proposal, given as logs; the greatest ratio is taken out first, so none overflows."""
    ratio = F.col(log_target) - F.col(log_proposal)
    top = df.agg(F.max(ratio).alias("_top"))
    weighed = df.join(F.broadcast(top)).withColumn("_ratio", F.exp(ratio - F.col("_top"))).drop("_top")  # one row
    return resample(weighed, "_ratio", key, n, seed).drop("_ratio")


# --- sets ---


def stack(a: DataFrame, b: DataFrame) -> DataFrame:
    """All rows of both; the columns' names and types must match."""
    if dict(a.dtypes) != dict(b.dtypes):
        raise ValueError(f"columns differ: {a.dtypes} and {b.dtypes}")
    return a.unionByName(b)


def set_algebra(df: DataFrame, a: str, b: str, everything: Sequence) -> DataFrame:
    """df with union, intersection, exclusive_or, complement (of a), covers, disjoint of two array columns, sorted."""
    x, y = F.col(a), F.col(b)
    whole = F.array(*map(F.lit, everything))
    both = F.array_intersect(x, y)
    return df.withColumns(
        {
            "union": F.sort_array(F.array_union(x, y)),
            "intersection": F.sort_array(both),
            "exclusive_or": F.sort_array(F.array_except(F.array_union(x, y), both)),
            "complement": F.sort_array(F.array_except(whole, x)),
            "covers": F.size(F.array_except(y, x)) == 0,
            "disjoint": ~F.coalesce(F.arrays_overlap(x, y), F.lit(False)),
        }
    )


def distinct_in_order(df: DataFrame, x: str, place: str) -> DataFrame:
    """x, place: each distinct value where it first stands."""
    return df.groupBy(x).agg(F.min(place).alias(place))


# --- reshape ---


def long_to_wide(df: DataFrame, time: str, series: str, value: str, levels: Sequence[str], key: str) -> DataFrame:
    """One row a time, one column a level; of repeats the one of greatest key stays."""
    return df.groupBy(time).agg(*[F.max_by(F.when(F.col(series) == v, F.col(value)), F.when(F.col(series) == v, F.col(key))).alias(v) for v in levels])


def wide_to_long(df: DataFrame, time: str, columns: Sequence[str], drop_missing: bool = True) -> DataFrame:
    out = df.unpivot([time], list(columns), "series", "value")
    return out.filter(F.col("value").isNotNull()) if drop_missing else out


def series_arrays(df: DataFrame, series: str, time: str, values: Sequence[str]) -> DataFrame:
    """One row a series: its values as arrays in time order."""
    rows = df.groupBy(series).agg(F.sort_array(F.collect_list(F.struct(F.col(time), *[F.col(v) for v in values]))).alias("_r"))
    pick = lambda v: lambda r: r[v]
    return rows.select(series, *[F.transform("_r", pick(v)).alias(v) for v in values])
