"""Descriptive statistics: moments, quantiles, frequencies, tests. Each function takes a DataFrame and returns one, lazily."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnspark.functions import ordered
from tarnspark.functions.folders import new_path
from tarnspark.functions.shipping import ship

from .sufficient import chi_square_p


def clean(x: Column | str) -> Column:
    """A number with NaN as NULL."""
    c = F.col(x) if isinstance(x, str) else x
    return F.when(~F.isnan(c), c)


def moments(df: DataFrame, x: str, by: Sequence[str] = (), missing_code: float | None = None, observed: Column | None = None, empty: str = "zero") -> DataFrame:
    """n, mean, var, sd. Rows equal to missing_code or not observed are skipped; too few rows give 0 (empty='zero') or NULL."""
    v = clean(F.col(x).cast("double"))
    if missing_code is not None:
        v = F.when(v != missing_code, v)
    if observed is not None:
        v = F.when(observed, v)
    fill = (lambda c: F.coalesce(c, F.lit(0.0))) if empty == "zero" else (lambda c: c)
    return df.groupBy(*by).agg(F.count(v).alias("n"), fill(F.avg(v)).alias("mean"), fill(F.var_samp(v)).alias("var"), fill(F.stddev_samp(v)).alias("sd"))


def reductions(df: DataFrame, x: str, key: str) -> DataFrame:
    """Range, extremes and where they stand (the least key on ties), sums, product (by logarithms) and norms of a column."""
    v = F.col(x).cast("double")
    return df.agg(
        F.min(v).alias("min"),
        F.max(v).alias("max"),
        F.min_by(F.col(key), F.struct(v, F.col(key))).alias("argmin"),
        F.max_by(F.col(key), F.struct(v, -F.col(key))).alias("argmax"),
        F.sum(v).alias("sum"),
        F.sum(F.abs(v)).alias("abs_norm"),
        F.sum(v * v).alias("norm2"),
        F.sum(F.ln(F.when(v > 0, v))).alias("log_prod"),
    )


def correlation(x: Column, y: Column) -> Column:
    """cor(x, y): 0 for one row or no covariance, 1 if both are constant; an aggregate that never divides by zero.
    What has one value is constant: its variance, merged from the parts of tasks, can be just above 0."""
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    vx, vy, c = F.var_samp(x), F.var_samp(y), F.covar_samp(x, y)
    flat_x, flat_y = ((v == 0) | (F.max(z) - F.min(z) == 0) for v, z in ((vx, x), (vy, y)))
    return F.when(F.count(F.when(both, 1)) <= 1, 0.0).when(flat_x & flat_y, 1.0).when(flat_x | flat_y | (c == 0), 0.0).otherwise(F.try_divide(c, F.sqrt(vx * vy)))


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """i, j, covariance, correlation of each pair of columns: one aggregation of the pairs in one order, turned long."""
    columns = list(columns)
    pairs = [(a, b) for k, a in enumerate(columns) for b in columns[k:]]
    wide = df.agg(*[F.covar_samp(a, b).alias(f"v{k}") for k, (a, b) in enumerate(pairs)], *[correlation(F.col(a), F.col(b)).alias(f"r{k}") for k, (a, b) in enumerate(pairs)])
    cell = lambda i, j, k: F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"v{k}").alias("covariance"), F.col(f"r{k}").alias("correlation"))
    cells = [cell(i, j, k) for k, pair in enumerate(pairs) for i, j in dict.fromkeys([pair, pair[::-1]])]
    return wide.select(F.inline(F.array(*cells)))


def quantiles(df: DataFrame, x: str, probs: Sequence[float], by: Sequence[str] = (), approximate: bool = False, accuracy: int = 10000) -> DataFrame:
    """One row a probability: prob, quantile. Exact (type 7, from the counts of values, ranked in stretches) or by a sketch."""
    p = F.array(*[F.lit(float(q)) for q in probs])
    if approximate:
        found = df.groupBy(*by).agg(F.percentile_approx(x, list(map(float, probs)), accuracy).alias("v"))
    else:
        counts = df.filter(F.col(x).isNotNull()).groupBy(*by, F.col(x).cast("double").alias("_x")).agg(F.count("*").alias("_o"))
        found = _ranked(counts, by).groupBy(*by).agg(F.first("_n").alias("_n"), *_at_ranks(probs))
        found = found.filter("_n > 0").select(*by, F.array(*[_between(k, q, F.col("_n")) for k, q in enumerate(probs)]).alias("v"))
    return found.select(*by, F.posexplode("v").alias("k", "quantile")).select(*by, F.element_at(p, F.col("k") + 1).alias("prob"), "quantile")


def _ranked(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Distinct values _x and their numbers _o, with _n rows of the group in all, of them _upto up to _x, and the least _low.
    They are written first: four steps read them, and the rows that they count would be read as often."""
    path = new_path(counts.sparkSession, "counts")
    counts.write.parquet(path)
    counts = counts.sparkSession.read.schema(counts.schema).parquet(path)
    totals = counts.groupBy(*by).agg(F.sum("_o").alias("_n"), F.min("_x").alias("_low"))
    ranked = ordered.running(counts, "_x", "_o", "_upto", by=by)
    return ordered.beside(ranked, totals, by) if by else ranked.join(F.broadcast(totals))


def _at_ranks(probs: Sequence[float]) -> list[Column]:
    """Aggregates of `_ranked`: _a0, _b0, _a1, ..., the values on both sides of each probability's place."""
    out = []
    for k, p in enumerate(probs):
        place = F.floor((F.col("_n") - 1) * F.lit(float(p)))
        for name, rank in (("a", place), ("b", F.least(place + 1, F.col("_n") - 1))):
            out.append(F.max(F.when((F.col("_upto") - F.col("_o") <= rank) & (rank < F.col("_upto")), F.col("_x"))).alias(f"_{name}{k}"))
    return out


def _between(k: int, p: float, n: Column) -> Column:
    at = (n - 1) * F.lit(float(p))
    return F.col(f"_a{k}") + F.when(F.col(f"_a{k}") == F.col(f"_b{k}"), 0.0).otherwise((at - F.floor(at)) * (F.col(f"_b{k}") - F.col(f"_a{k}")))


def frequency_table(df: DataFrame, x: str, contiguous: bool = False, support: tuple[int, int] | None = None) -> DataFrame:
    """value, n, share. contiguous: integers between the least and greatest that don't occur count 0; support: those of a range."""
    counts = df.filter(F.col(x).isNotNull()).groupBy(F.col(x).alias("value")).agg(F.count("*").alias("n"))
    if support:
        grid = df.sparkSession.range(support[0], support[1] + 1).select(F.col("id").alias("value"))
    elif contiguous:
        grid = counts.agg(F.min("value").alias("a"), F.max("value").alias("b")).filter("a IS NOT NULL").select(F.explode(F.sequence("a", "b")).alias("value"))
    else:
        grid = None
    if grid is not None:
        counts = grid.join(counts, "value", "left").select("value", F.coalesce("n", F.lit(0)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(total)).select("value", "n", F.try_divide(F.col("n").cast("double"), F.col("total")).alias("share"))


def mode(df: DataFrame, x: str) -> DataFrame:
    """The most frequent value, the least on ties, with its count."""
    return df.groupBy(F.col(x).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(1)


def bucket(x: Column, cuts: Sequence[float]) -> Column:
    """The bucket (-inf, c1], (c1, c2], ..., (ck, inf) of x, from 0: closed on the right."""
    out = F.when(x <= cuts[0], 0)
    for k, c in enumerate(cuts[1:], 1):
        out = out.when(x <= c, k)
    return out.when(x.isNotNull(), len(cuts))


def bucketed_histogram(df: DataFrame, x: str, cuts: Sequence[float]) -> DataFrame:
    cuts = sorted(cuts)
    grid = df.sparkSession.range(len(cuts) + 1).select(F.col("id").cast("int").alias("bucket"))
    n = df.groupBy(bucket(F.col(x), cuts).alias("bucket")).agg(F.count("*").alias("n"))
    return grid.join(n, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))


def level_counts(df: DataFrame, x: str, levels: Sequence[str]) -> DataFrame:
    """level, n: the given levels (0 where none), others as [Other], NULL as [Missing]."""
    known = F.when(F.col(x).isNull(), "[Missing]").when(F.col(x).isin(*levels), F.col(x)).otherwise("[Other]")
    n = df.groupBy(known.alias("level")).agg(F.count("*").alias("n"))
    grid = df.sparkSession.createDataFrame([(v,) for v in [*levels, "[Other]", "[Missing]"]], "level string")
    return grid.join(n, "level", "left").select("level", F.coalesce("n", F.lit(0)).alias("n"))


def collapse_top(df: DataFrame, x: str, k: int, other: str = "[Other]") -> DataFrame:
    """level, n: levels whose count is among the k largest counts (ties stay), all the rest as one."""
    n = df.filter(F.col(x).isNotNull()).groupBy(F.col(x).alias("level")).agg(F.count("*").alias("n"))
    least = n.orderBy(F.desc("n")).limit(k).agg(F.min("n").alias("_least"))  # one row
    return n.join(F.broadcast(least)).groupBy(F.when(F.col("n") >= F.col("_least"), F.col("level")).otherwise(other).alias("level")).agg(F.sum("n").alias("n"))


def crosstab(df: DataFrame, a: str, b: str, levels: Sequence[str]) -> DataFrame:
    """Counts of a by b, one column a level of b; NULL is a level of a, and a column of b."""
    cells = [F.count_if(F.col(b) == v).alias(f"{b}_{v}") for v in levels]
    return df.groupBy(a).agg(*cells, F.count_if(F.col(b).isNull()).alias(f"{b}_missing"), F.count("*").alias("total"))


def margins(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Counts of every cell and every margin of the columns; NULL stands for a column summed over (grouping_id tells it from a value)."""
    return df.cube(*columns).agg(F.count("*").alias("n"), F.grouping_id().alias("grouping"))


def margin_tables(df: DataFrame, effects: Sequence[Sequence[str]]) -> DataFrame:
    """The cell counts of the requested effects only, each a set of columns."""
    columns = sorted({c for e in effects for c in e})
    sets = [[F.col(c) for c in e] for e in effects]
    return df.groupingSets(sets, *columns).agg(F.count("*").alias("n"), F.grouping_id().alias("grouping"))


def numeric_summary(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), quartiles: dict[str, float] | None = None) -> DataFrame:
    """One row a column and group: observed, missing, distinct, mean, sd, min, quantiles (by name; the quartiles), max.

    NaN and infinities are missing. Rows are counted by value first, on both sides of the shuffle; all else is made from
    the distinct values and their counts, ranked in stretches of their values, of which no task holds more than one. Quantiles are exact (type 7).
    """
    probs = {"q25": 0.25, "median": 0.5, "q75": 0.75} if quartiles is None else quartiles
    values = F.explode(F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast("double").alias("x")) for c in columns])).alias("v")
    long = df.select(*by, values).select(*by, "v.variable", F.when(F.abs("v.x") < float("inf"), F.col("v.x")).alias("x"))
    counts = long.groupBy(*by, "variable", F.col("x").alias("_x")).agg(F.count("*").alias("_c")).withColumn("_o", F.when(F.col("_x").isNotNull(), F.col("_c")).otherwise(0))
    y = F.col("_x") - F.col("_low")
    found = _ranked(counts, [*by, "variable"]).groupBy(*by, "variable").agg(
        F.sum("_o").alias("observed"),
        F.sum(F.col("_c") - F.col("_o")).alias("missing"),
        F.count("_x").alias("distinct_values"),
        F.sum(y * F.col("_o")).alias("_s"),
        F.sum(y * y * F.col("_o")).alias("_ss"),
        F.min("_x").alias("min"),
        F.max("_x").alias("max"),
        *_at_ranks(list(probs.values())),
    )
    n = F.col("observed")
    spread = F.greatest(F.lit(0.0), F.try_divide(F.col("_ss") - F.try_divide(F.col("_s") * F.col("_s"), n), n - 1))
    between = [_between(k, p, n).alias(c) for k, (c, p) in enumerate(probs.items())]
    sd = F.when(n > 1, F.sqrt(spread)).alias("sd")
    return found.select(*by, "variable", "observed", "missing", "distinct_values", (F.col("min") + F.try_divide(F.col("_s"), n)).alias("mean"), sd, "min", *between, "max")


#: The probabilities of a full summary.
TWENTIETHS = {f"q{5 * k:02d}": round(k / 20, 2) for k in range(1, 20)}


def summary(df: DataFrame) -> DataFrame:
    """variable, kind (numeric, categorical, datetime), statistic, value of each column by its type; other types are left out.

    Numeric: observed, missing, distinct_values, mean, sd, min, 19 quantiles, max. Categorical (strings and booleans): as
    `categorical_summary`, true as 1. Datetime: observed, missing, days, and first and last in seconds since 1970.
    """
    kinds: dict[str, list[str]] = {"numeric": [], "categorical": [], "datetime": []}
    for c, t in df.dtypes:
        if t in ("tinyint", "smallint", "int", "bigint", "float", "double") or t.startswith("decimal"):
            kinds["numeric"].append(c)
        elif t in ("string", "boolean"):
            kinds["categorical"].append(c)
        elif t in ("date", "timestamp", "timestamp_ntz"):
            kinds["datetime"].append(c)
    parts = []
    if kinds["numeric"]:
        parts.append(("numeric", numeric_summary(df, kinds["numeric"], quartiles=TWENTIETHS)))
    if kinds["categorical"]:
        parts.append(("categorical", categorical_summary(df, kinds["categorical"])))
    if kinds["datetime"]:
        parts.append(("datetime", datetime_columns(df, kinds["datetime"])))
    out = None
    for kind, wide in parts:
        names = [c for c in wide.columns if c != "variable"]
        cells = F.array(*[F.struct(F.lit(c).alias("statistic"), F.col(c).cast("double").alias("value")) for c in names])
        long = wide.select("variable", F.lit(kind).alias("kind"), F.inline(cells))
        out = long if out is None else out.unionByName(long)
    return out if out is not None else df.sparkSession.createDataFrame([], "variable string, kind string, statistic string, value double")


def datetime_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row a column: observed, missing, days (distinct dates), first and last in seconds since 1970."""
    seconds = lambda c: F.unix_micros(F.col(c).cast("timestamp")) / 1e6
    values = F.array(*[F.struct(F.lit(c).alias("variable"), F.to_date(c).alias("day"), seconds(c).alias("s")) for c in columns])
    by_day = df.select(F.inline(values)).groupBy("variable", "day").agg(F.count("s").alias("c"), F.count_if(F.col("s").isNull()).alias("m"), F.min("s").alias("a"), F.max("s").alias("b"))
    return by_day.groupBy("variable").agg(F.sum("c").alias("observed"), F.sum("m").alias("missing"), F.count("day").alias("days"), F.min("a").alias("first"), F.max("b").alias("last"))


def shape(df: DataFrame, x: str, far: float = 5.0) -> DataFrame:
    """Bias-corrected skewness and excess kurtosis, and how many rows lie more than `far` sd from the mean."""
    v = clean(F.col(x).cast("double"))
    n = F.count(v).cast("double")
    s = df.agg(n.alias("n"), F.skewness(v).alias("g1"), F.kurtosis(v).alias("g2"), F.avg(v).alias("m"), F.stddev_samp(v).alias("s"))
    out = df.join(F.broadcast(s)).agg(F.first("n").alias("n"), F.first("g1").alias("g1"), F.first("g2").alias("g2"), F.count_if(F.abs(v - F.col("m")) > far * F.col("s")).alias("outliers"))
    return out.select(
        F.try_divide(F.col("g1") * F.sqrt(F.col("n") * (F.col("n") - 1)), F.col("n") - 2).alias("skewness"),
        F.try_divide((F.col("n") - 1) * ((F.col("n") + 1) * F.col("g2") + 6), (F.col("n") - 2) * (F.col("n") - 3)).alias("kurtosis"),
        "outliers",
    )


def equal_bins(df: DataFrame, x: str, bins: int = 10) -> DataFrame:
    """bin, n: equal bins from the least to the greatest value, the last one closed."""
    v = F.col(x).cast("double")
    ends = df.agg(F.min(v).alias("a"), F.max(v).alias("b"))
    k = F.when(F.col("b") > F.col("a"), F.least(F.lit(bins - 1), F.floor((v - F.col("a")) / (F.col("b") - F.col("a")) * bins))).otherwise(0)
    n = df.filter(v.isNotNull()).join(F.broadcast(ends)).groupBy(k.cast("bigint").alias("bin")).agg(F.count("*").alias("n"))
    return df.sparkSession.range(bins).select(F.col("id").alias("bin")).join(n, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def missing_codes(df: DataFrame, x: str, more_than: int = 10, among: int = 100) -> DataFrame:
    """value, n: all-nines integers of three digits or more, of either sign, that occur more than so often and are among the most frequent values."""
    n = df.filter(F.col(x).isNotNull()).groupBy(F.col(x).alias("value")).agg(F.count("*").alias("n"))
    top = n.orderBy(F.desc("n"), "value").limit(among)
    return top.filter((F.col("n") > more_than) & (F.col("value") == F.floor("value")) & F.col("value").cast("bigint").cast("string").rlike("^-?9{3,}$"))


def categorical_summary(df: DataFrame, columns: Sequence[str], limit: int = 100) -> DataFrame:
    """One row a column: observed, missing, levels, is_binary, high_cardinality (over `limit` levels, and over the cube root of the rows)."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast("string").alias("x")) for c in columns])).alias("v")).select("v.*")
    out = long.groupBy("variable").agg(F.count("x").alias("observed"), F.count_if(F.col("x").isNull()).alias("missing"), F.countDistinct("x").alias("levels"))
    return out.withColumns({"is_binary": F.col("levels") == 2, "high_cardinality": F.col("levels") > F.greatest(F.lit(float(limit)), F.cbrt(F.col("observed").cast("double")))})


def repeat_counts(df: DataFrame, x: str) -> DataFrame:
    """repeats, values: how many values occur once, twice, and so on."""
    return df.filter(F.col(x).isNotNull()).groupBy(x).agg(F.count("*").alias("repeats")).groupBy("repeats").agg(F.count("*").alias("values"))


def tjur_r2(df: DataFrame, p: Column, y: Column) -> DataFrame:
    return df.agg(F.abs(F.coalesce(F.avg(F.when(y, p)), F.lit(1.0)) - F.coalesce(F.avg(F.when(~y, p)), F.lit(0.0))).alias("tjur_r2"))


def kl_divergence(df: DataFrame, p: str, q: str) -> DataFrame:
    """Sum of p * log(p / q): 0 where p is 0, infinite where only q is."""
    p_, q_ = F.col(p), F.col(q)
    return df.agg(F.sum(F.when(p_ <= 0, 0.0).when(q_ <= 0, float("inf")).otherwise(p_ * F.ln(F.try_divide(p_, q_)))).alias("kl"))


def chi_square_two_way(df: DataFrame, a: str, b: str) -> DataFrame:
    """statistic, df, valid (each expected count 5 at least) of a contingency table; only cells that occur are made."""
    cells = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count("*").alias("o"))
    ra, rb = cells.groupBy(a).agg(F.sum("o").alias("ra")), cells.groupBy(b).agg(F.sum("o").alias("rb"))
    o, ra_, rb_ = (F.col(c).cast("double") for c in ("o", "ra", "rb"))
    s = cells.join(ra, a).join(rb, b).agg(
        F.sum(o).alias("n"), F.sum(o * o / (ra_ * rb_)).alias("q"), F.countDistinct(a).alias("na"), F.countDistinct(b).alias("nb"), F.min(ra_).alias("ma"), F.min(rb_).alias("mb")
    )
    # the sum of (o - e)^2 / e over all cells, empty ones too, is n times (the sum of o^2 / (row * column) less 1)
    return s.select((F.col("n") * (F.col("q") - 1)).alias("statistic"), ((F.col("na") - 1) * (F.col("nb") - 1)).alias("df"), (F.col("ma") * F.col("mb") / F.col("n") >= 5).alias("valid"))


def with_chi_square_p(result: DataFrame) -> DataFrame:
    """A result of few rows with statistic and df, and p: the chance of a greater statistic."""

    @F.udf(returnType="double")
    def p(statistic, n):
        return None if statistic is None or not n or n < 1 else chi_square_p(max(0.0, statistic), n)

    ship(result.sparkSession)
    return result.withColumn("p", p("statistic", "df"))


def chi_square_one_way(df: DataFrame, x: str, expected: dict[str, float]) -> DataFrame:
    """statistic and df against expected shares."""
    grid = df.sparkSession.createDataFrame([(k, float(v)) for k, v in expected.items()], "level string, share double")
    n = df.groupBy(F.col(x).alias("level")).agg(F.count("*").alias("o"))
    cells = grid.join(n, "level", "left").select("share", F.coalesce("o", F.lit(0)).alias("o"))
    total = cells.agg(F.sum("o").cast("double").alias("t"))
    e = F.col("share") * F.col("t")
    return cells.join(F.broadcast(total)).agg(F.sum((F.col("o") - e) ** 2 / e).alias("statistic"), (F.count("*") - 1).alias("df"))


def ecdf(df: DataFrame, x: str) -> DataFrame:
    """value, at_most (share of rows <= value), below (share of rows < value), one row a distinct value."""
    n = df.filter(clean(F.col(x)).isNotNull()).groupBy(F.col(x).alias("value")).agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("_total"))
    c = F.col("_upto")
    return ordered.running(n, "value", "n", "_upto").join(F.broadcast(total)).select("value", (c / F.col("_total")).alias("at_most"), ((c - F.col("n")) / F.col("_total")).alias("below"))


def ecdf_at(df: DataFrame, x: str, points: Sequence[float]) -> DataFrame:
    """point, share of rows <= point: one aggregation."""
    wide = df.agg(*[F.avg((F.col(x) <= p).cast("double")).alias(f"p{k}") for k, p in enumerate(points)])
    return wide.select(F.inline(F.array(*[F.struct(F.lit(float(p)).alias("point"), F.col(f"p{k}").alias("share")) for k, p in enumerate(points)])))


def hexbin(df: DataFrame, x: str, y: str, gridsize: int = 10, rectangular: bool = False) -> DataFrame:
    """cx, cy, n: rows at the nearest centre of two staggered lattices (true hexagons), or of one (rectangular)."""
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    rows = df.filter(clean(a).isNotNull() & clean(b).isNotNull())
    ends = rows.agg(F.min(a).alias("x0"), F.max(a).alias("x1"), F.min(b).alias("y0"), F.max(b).alias("y1"))
    sx = F.when(F.col("x1") > F.col("x0"), (F.col("x1") - F.col("x0")) / gridsize).otherwise(1.0)
    sy = F.when(F.col("y1") > F.col("y0"), (F.col("y1") - F.col("y0")) / gridsize).otherwise(1.0)
    u, v = (a - F.col("x0")) / sx, (b - F.col("y0")) / sy
    i, j = F.floor(u + 0.5), F.floor(v + 0.5)
    k, m = F.floor(u) + 0.5, F.floor(v) + 0.5
    near = F.lit(True) if rectangular else ((u - i) ** 2 + 3 * (v - j) ** 2 <= (u - k) ** 2 + 3 * (v - m) ** 2)
    cx, cy = F.col("x0") + sx * F.when(near, i.cast("double")).otherwise(k), F.col("y0") + sy * F.when(near, j.cast("double")).otherwise(m)
    return rows.join(F.broadcast(ends)).groupBy(cx.alias("cx"), cy.alias("cy")).agg(F.count("*").alias("n"))


def kernel_density(df: DataFrame, x: str, bandwidth: float, low: float, high: float, points: int = 20) -> DataFrame:
    """point, density: a Gaussian kernel estimate on a fixed grid, in one aggregation of distinct values."""
    n = df.filter(clean(F.col(x)).isNotNull()).groupBy(F.col(x).cast("double").alias("v")).agg(F.count("*").alias("n"))
    step = (high - low) / (points - 1)
    grid = [low + k * step for k in range(points)]
    norm = 0.3989422804014327 / bandwidth
    wide = n.agg(*[F.sum(F.col("n") * F.exp(-0.5 * ((F.col("v") - g) / bandwidth) ** 2) * norm).alias(f"d{k}") for k, g in enumerate(grid)], F.sum("n").alias("t"))
    return wide.select(F.inline(F.array(*[F.struct(F.lit(g).alias("point"), F.try_divide(F.col(f"d{k}"), F.col("t")).alias("density")) for k, g in enumerate(grid)])))


def event_intensity(df: DataFrame, ts: str, hours: float, points: int = 20) -> DataFrame:
    """at, a_day: the number of events a day around each of some times from the first event to the last, by a Gaussian kernel of
    this many hours; the area under it is the number of events, but for what falls outside."""
    t = (F.unix_micros(F.col(ts).cast("timestamp")) / 86400e6).alias("_t")
    rows = df.filter(F.col(ts).isNotNull()).select(t)
    low, high, n = rows.agg(F.min("_t"), F.max("_t"), F.count("*")).first()
    if not n:
        return df.sparkSession.createDataFrame([], "at timestamp, a_day double")
    found = kernel_density(rows, "_t", hours / 24, low, high, points)
    return found.select(F.timestamp_micros(F.round(F.col("point") * 86400e6).cast("bigint")).alias("at"), (F.col("density") * n).alias("a_day"))


def optimal_arms(draws: DataFrame) -> DataFrame:
    """draws: draw, arm, value. arm, wins, probability of being best; ties go to the least arm."""
    best = draws.groupBy("draw").agg(F.max(F.struct("value", (-F.col("arm")).alias("m"))).alias("b")).select((-F.col("b.m")).alias("arm"))
    wins = best.groupBy("arm").agg(F.count("*").alias("wins"))
    total = wins.agg(F.sum("wins").alias("t"))
    return draws.select("arm").distinct().join(wins, "arm", "left").join(F.broadcast(total)).select("arm", F.coalesce("wins", F.lit(0)).alias("wins"), (F.coalesce("wins", F.lit(0)) / F.col("t")).alias("probability"))


def value_remaining(draws: DataFrame) -> DataFrame:
    """draw, remaining: the best arm's value less that of the arm that is best in most draws."""
    overall = optimal_arms(draws).orderBy(F.desc("wins"), "arm").limit(1).select("arm")
    top = draws.groupBy("draw").agg(F.max("value").alias("best"))
    return draws.join(F.broadcast(overall), "arm").join(top, "draw").select("draw", (F.col("best") - F.col("value")).alias("remaining"))


def coefficient_summary(draws: DataFrame) -> DataFrame:
    """draws: variable, value. mean, sd, the same given non-zero, inclusion probability."""
    v = F.col("value")
    some = F.when(v != 0, v)
    return draws.groupBy("variable").agg(F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"), F.avg(some).alias("mean_included"), F.stddev_samp(some).alias("sd_included"), F.avg((v != 0).cast("double")).alias("inclusion"))


def suggest_burn(draws: DataFrame, step: str, loglik: str, fraction: float = 0.1, q: float = 0.5) -> DataFrame:
    """burn: the first step whose log likelihood reaches the q-quantile of the last `fraction` of steps."""
    n = draws.agg(F.max(step).alias("last"), F.min(step).alias("first"))
    tail = draws.join(F.broadcast(n)).filter(F.col(step) > F.col("last") - fraction * (F.col("last") - F.col("first") + 1)).agg(F.percentile(loglik, F.lit(q)).alias("cut"))
    return draws.join(F.broadcast(tail)).filter(F.col(loglik) >= F.col("cut")).agg(F.min(step).alias("burn"))


def hosmer_lemeshow(df: DataFrame, p: str, y: str, key: str, groups: int = 10) -> DataFrame:
    """decile of p: n, mean predicted and observed. Deciles by value quantiles, so no global sort."""
    cuts = df.agg(F.percentile(p, F.array(*[F.lit(k / groups) for k in range(1, groups)])).alias("c"))
    g = F.size(F.filter("c", lambda c: c < F.col(p)))
    return df.join(F.broadcast(cuts)).groupBy(g.cast("bigint").alias("decile")).agg(F.count("*").alias("n"), F.avg(p).alias("predicted"), F.avg(y).alias("observed"))


# --- stored sketches ---


def sketch(df: DataFrame, x: str, by: Sequence[str], k: int = 800) -> DataFrame:
    """by, sketch (binary) of a column's values: a few KB a group, to be stored and merged."""
    v = clean(F.col(x).cast("double"))
    return df.filter(v.isNotNull()).groupBy(*by).agg(F.kll_sketch_agg_double(v, k).alias("sketch"))


def merge_sketches(sketches: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, sketch: as if made from all rows behind the sketches at once."""
    return sketches.groupBy(*by).agg(F.kll_merge_agg_double("sketch").alias("sketch"))


def sketch_quantiles(sketches: DataFrame, by: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """by, prob, quantile of stored sketches, with a rank error of about a half percent at k = 800."""
    p = F.array(*[F.lit(float(q)) for q in probs])
    found = sketches.select(*by, F.posexplode(F.kll_sketch_get_quantile_double("sketch", p)).alias("k", "quantile"))
    return found.select(*by, F.element_at(p, F.col("k") + 1).alias("prob"), "quantile")
