"""Queries of descriptive statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnspark.operators import aggregate as A

from .register import query, table


def rounded(df, n: int = 6):
    """Doubles rounded, as sums in another order differ in their last digits."""
    return df.select(*[F.round(f"`{c}`", n).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])


_SUMMARY = " UNION ALL ".join(
    f"""SELECT l_returnflag, l_linestatus, '{c}' AS variable, count({c}) AS observed, count(*) - count({c}) AS missing,
    count(DISTINCT {c}) AS distinct_values, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS sd, min({c}) AS min,
    round(quantile_cont({c}, 0.25), 6) AS q25, round(quantile_cont({c}, 0.5), 6) AS median, round(quantile_cont({c}, 0.75), 6) AS q75, max({c}) AS max
    FROM lineitem GROUP BY 1, 2"""
    for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
)


@query(_SUMMARY)
def numeric_summary(spark, d):
    return rounded(A.numeric_summary(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], ["l_returnflag", "l_linestatus"]))


@query("SELECT l_returnflag, count(l_discount) AS n, round(avg(l_discount), 6) AS mean, round(var_samp(l_discount), 8) AS var, round(stddev_samp(l_discount), 8) AS sd FROM lineitem GROUP BY 1")
def moments(spark, d):
    out = A.moments(table(spark, d, "lineitem"), "l_discount", ["l_returnflag"])
    return out.select("l_returnflag", "n", F.round("mean", 6).alias("mean"), F.round("var", 8).alias("var"), F.round("sd", 8).alias("sd"))


@query("SELECT count(x) AS n, coalesce(round(avg(x), 6), 0) AS mean, coalesce(round(var_samp(x), 8), 0) AS var, coalesce(round(stddev_samp(x), 8), 0) AS sd FROM (SELECT nullif(l_discount, 0) AS x FROM lineitem)")
def moments_missing_code(spark, d):
    out = A.moments(table(spark, d, "lineitem"), "l_discount", missing_code=0.0)
    return out.select("n", F.round("mean", 6).alias("mean"), F.round("var", 8).alias("var"), F.round("sd", 8).alias("sd"))


@query("SELECT count(*) AS n, round(avg(l_tax), 6) AS mean, round(var_samp(l_tax), 8) AS var, round(stddev_samp(l_tax), 8) AS sd FROM lineitem WHERE l_quantity > 25")
def moments_observed(spark, d):
    out = A.moments(table(spark, d, "lineitem"), "l_tax", observed=F.col("l_quantity") > 25)
    return out.select("n", F.round("mean", 6).alias("mean"), F.round("var", 8).alias("var"), F.round("sd", 8).alias("sd"))


@query("""SELECT min(o_totalprice) AS min, max(o_totalprice) AS max, (SELECT o_orderkey FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 1) AS argmin,
  (SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1) AS argmax, round(sum(o_totalprice), 2) AS sum,
  round(sum(abs(o_totalprice)), 2) AS abs_norm, round(sum(o_totalprice * o_totalprice) / 1e6, 2) AS norm2, round(sum(ln(o_totalprice)) FILTER (o_totalprice > 0), 4) AS log_prod FROM orders""")
def reductions(spark, d):
    out = A.reductions(table(spark, d, "orders"), "o_totalprice", "o_orderkey")
    return out.select("min", "max", "argmin", "argmax", F.round("sum", 2).alias("sum"), F.round("abs_norm", 2).alias("abs_norm"), F.round(F.col("norm2") / 1e6, 2).alias("norm2"), F.round("log_prod", 4).alias("log_prod"))


_NUM = ("l_quantity", "l_extendedprice", "l_discount")


@query(" UNION ALL ".join(f"SELECT '{a}' AS i, '{b}' AS j, round(covar_samp({a}, {b}), 3) AS covariance, round(corr({a}, {b}), 6) AS correlation FROM lineitem" for a in _NUM for b in _NUM))
def correlation_matrix(spark, d):
    out = A.correlation_matrix(table(spark, d, "lineitem"), _NUM)
    return out.select("i", "j", F.round("covariance", 3).alias("covariance"), F.round("correlation", 6).alias("correlation"))


@query("SELECT l_returnflag, CASE WHEN var_samp(l_tax * 0) = 0 THEN 0.0::DOUBLE END AS one_constant, 1.0::DOUBLE AS both_constant FROM lineitem GROUP BY 1")
def correlation_of_constants(spark, d):
    zero, two = F.col("l_tax") * 0.0, F.col("l_quantity") * 0.0 + 2.0
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(A.correlation(zero, F.col("l_quantity")).alias("one_constant"), A.correlation(zero, two).alias("both_constant"))


@query(" UNION ALL ".join(f"SELECT l_returnflag, {p}::DOUBLE AS prob, round(quantile_cont(l_extendedprice, {p}), 6) AS quantile FROM lineitem GROUP BY 1" for p in (0.05, 0.25, 0.5, 0.75, 0.95)))
def quantiles(spark, d):
    return rounded(A.quantiles(table(spark, d, "lineitem"), "l_extendedprice", [0.05, 0.25, 0.5, 0.75, 0.95], ["l_returnflag"]))


@query()
def quantile_sketch(spark, d):
    return A.quantiles(table(spark, d, "lineitem"), "l_extendedprice", [0.05, 0.25, 0.5, 0.75, 0.95], ["l_returnflag"], approximate=True)


@query("""WITH n AS (SELECT p_size::BIGINT AS value, count(*) AS n FROM part WHERE p_size % 7 <> 3 GROUP BY 1),
  g AS (SELECT unnest(range((SELECT min(value) FROM n), (SELECT max(value) FROM n) + 1)) AS value)
  SELECT value, coalesce(n, 0) AS n, round(coalesce(n, 0) / (SELECT sum(n) FROM n), 6)::DOUBLE AS share FROM g LEFT JOIN n USING (value)""")
def frequency_table(spark, d):
    part = table(spark, d, "part").filter("p_size % 7 <> 3").withColumn("p_size", F.col("p_size").cast("bigint"))
    return rounded(A.frequency_table(part, "p_size", contiguous=True))


@query("""WITH g AS (SELECT unnest(range(1, 61)) AS value), n AS (SELECT p_size::BIGINT AS value, count(*) AS n FROM part GROUP BY 1)
  SELECT value, coalesce(n, 0) AS n, round(coalesce(n, 0) / (SELECT sum(n) FROM n WHERE value BETWEEN 1 AND 60), 6)::DOUBLE AS share FROM g LEFT JOIN n USING (value)""")
def frequency_table_support(spark, d):
    return rounded(A.frequency_table(table(spark, d, "part").withColumn("p_size", F.col("p_size").cast("bigint")), "p_size", support=(1, 60)))


@query("SELECT p_brand AS value, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, value LIMIT 1")
def mode(spark, d):
    return A.mode(table(spark, d, "part"), "p_brand")


@query("""SELECT b::INT AS bucket, count(l_quantity) FILTER (CASE WHEN l_quantity <= 5 THEN 0 WHEN l_quantity <= 10 THEN 1 WHEN l_quantity <= 25 THEN 2 WHEN l_quantity <= 60 THEN 3 ELSE 4 END = b) AS n
  FROM range(5) AS r(b), lineitem GROUP BY 1""")
def bucketed_histogram(spark, d):
    return A.bucketed_histogram(table(spark, d, "lineitem"), "l_quantity", [5, 10, 25, 60])


@query("""SELECT level, count(l.v) AS n FROM (VALUES ('R'), ('A'), ('Z'), ('[Other]'), ('[Missing]')) AS g(level)
  LEFT JOIN (SELECT CASE WHEN l_returnflag IN ('R', 'A', 'Z') THEN l_returnflag WHEN l_returnflag IS NULL THEN '[Missing]' ELSE '[Other]' END AS v FROM lineitem) AS l ON l.v = g.level GROUP BY 1""")
def level_counts(spark, d):
    return A.level_counts(table(spark, d, "lineitem"), "l_returnflag", ["R", "A", "Z"])


@query("""WITH n AS (SELECT p_brand, count(*) AS c FROM part GROUP BY 1), r AS (SELECT *, rank() OVER (ORDER BY c DESC) AS k FROM n)
  SELECT CASE WHEN k <= 5 THEN p_brand ELSE '[Other]' END AS level, sum(c)::BIGINT AS n FROM r GROUP BY 1""")
def collapse_top(spark, d):
    return A.collapse_top(table(spark, d, "part"), "p_brand", 5)


@query("""SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS "o_orderstatus_F", count(*) FILTER (o_orderstatus = 'O') AS "o_orderstatus_O",
  count(*) FILTER (o_orderstatus = 'P') AS "o_orderstatus_P", count(*) FILTER (o_orderstatus IS NULL) AS o_orderstatus_missing, count(*) AS total FROM orders GROUP BY 1""")
def crosstab(spark, d):
    return A.crosstab(table(spark, d, "orders"), "o_orderpriority", "o_orderstatus", ["F", "O", "P"])


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, grouping_id(l_returnflag, l_linestatus)::BIGINT AS grouping FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def margins(spark, d):
    return A.margins(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"])


@query("SELECT l_linestatus, l_returnflag, count(*) AS n, grouping_id(l_linestatus, l_returnflag)::BIGINT AS grouping FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), (l_returnflag, l_linestatus))")
def margin_tables(spark, d):
    return A.margin_tables(table(spark, d, "lineitem"), [["l_returnflag"], ["l_linestatus"], ["l_returnflag", "l_linestatus"]])


@query("""WITH s AS (SELECT avg(value) AS m, stddev_samp(value) AS s FROM events)
  SELECT round((SELECT skewness(value) FROM events), 5) AS skewness, round((SELECT kurtosis(value) FROM events), 5) AS kurtosis, count(*) FILTER (abs(value - m) > 3 * s) AS outliers FROM events, s""")
def shape(spark, d):
    return rounded(A.shape(table(spark, d, "events"), "value", 3.0), 5)


@query("""WITH e AS (SELECT min(o_totalprice) AS a, max(o_totalprice) AS b FROM orders), n AS (SELECT least(9, floor((o_totalprice - a) / (b - a) * 10))::BIGINT AS bin, count(*) AS n FROM orders, e GROUP BY 1)
  SELECT g.bin::BIGINT AS bin, coalesce(n, 0) AS n FROM range(10) AS g(bin) LEFT JOIN n ON n.bin = g.bin""")
def equal_bins(spark, d):
    return A.equal_bins(table(spark, d, "orders"), "o_totalprice")


@query("SELECT CASE WHEN l_linenumber = 1 THEN -999 WHEN l_linenumber = 2 THEN 99 ELSE 9999 END AS value, count(*) AS n FROM lineitem WHERE l_linenumber <> 2 GROUP BY 1")
def missing_codes(spark, d):
    coded = table(spark, d, "lineitem").select(F.expr("CASE WHEN l_linenumber = 1 THEN -999 WHEN l_linenumber = 2 THEN 99 ELSE 9999 END").alias("x"))
    return A.missing_codes(coded, "x")


@query(" UNION ALL ".join(f"SELECT '{c}' AS variable, count({c}) AS observed, count(*) - count({c}) AS missing, count(DISTINCT {c}) AS levels, count(DISTINCT {c}) = 2 AS is_binary, count(DISTINCT {c}) > greatest(100, cbrt(count({c}))) AS high_cardinality FROM part" for c in ("p_name", "p_brand", "p_type")))
def categorical_summary(spark, d):
    return A.categorical_summary(table(spark, d, "part"), ["p_name", "p_brand", "p_type"])


@query('SELECT c AS repeats, count(*) AS "values" FROM (SELECT o_custkey, count(*) AS c FROM orders GROUP BY 1) GROUP BY 1')
def repeat_counts(spark, d):
    return A.repeat_counts(table(spark, d, "orders"), "o_custkey")


@query("SELECT round(abs(coalesce(avg(p) FILTER (y), 1) - coalesce(avg(p) FILTER (NOT y), 0)), 6) AS tjur_r2 FROM (SELECT CASE WHEN quality = 1 THEN 0.3 ELSE 0.6 END::DOUBLE AS p, toxic = 1 AS y FROM labels)")
def tjur_r2(spark, d):
    return rounded(A.tjur_r2(table(spark, d, "labels"), F.when(F.col("quality") == 1, 0.3).otherwise(0.6), F.col("toxic") == 1))


@query("""WITH a AS (SELECT l_returnflag AS k, count(*) / (SELECT count(*) FROM lineitem) AS p FROM lineitem GROUP BY 1), b AS (SELECT l_returnflag AS k, count(*) / (SELECT count(*) FROM lineitem WHERE l_quantity > 40) AS q FROM lineitem WHERE l_quantity > 40 GROUP BY 1)
  SELECT round(sum(p * ln(p / q)), 8) AS kl FROM a JOIN b USING (k)""")
def kl_divergence(spark, d):
    li = table(spark, d, "lineitem")
    n = li.groupBy("l_returnflag").agg(F.count("*").alias("p"), F.count_if(F.col("l_quantity") > 40).alias("q"))
    t = n.agg(F.sum("p").alias("tp"), F.sum("q").alias("tq"))
    return rounded(A.kl_divergence(n.join(F.broadcast(t)).select((F.col("p") / F.col("tp")).alias("p"), (F.col("q") / F.col("tq")).alias("q")), "p", "q"), 8)


@query("""WITH c AS (SELECT quality, toxic, count(*) AS o FROM labels GROUP BY 1, 2), a AS (SELECT quality, sum(o) AS ra FROM c GROUP BY 1), b AS (SELECT toxic, sum(o) AS rb FROM c GROUP BY 1),
  f AS (SELECT coalesce(o, 0) AS o, ra * rb / (SELECT sum(o) FROM c) AS e FROM a CROSS JOIN b LEFT JOIN c USING (quality, toxic))
  SELECT round(sum((o - e) ** 2 / e), 6) AS statistic, ((SELECT count(*) FROM a) - 1) * ((SELECT count(*) FROM b) - 1) AS df, min(e) >= 5 AS valid FROM f""")
def chi_square_two_way(spark, d):
    return rounded(A.chi_square_two_way(table(spark, d, "labels"), "quality", "toxic"))


@query("""WITH c AS (SELECT level, share, (SELECT count(*) FROM orders WHERE o_orderstatus = level) AS o FROM (VALUES ('F', 0.4), ('O', 0.4), ('P', 0.2)) AS g(level, share))
  SELECT round(sum((o - share * t) ** 2 / (share * t)), 4)::DOUBLE AS statistic, count(*) - 1 AS df FROM c, (SELECT sum(o)::DOUBLE AS t FROM c)""")
def chi_square_one_way(spark, d):
    return rounded(A.chi_square_one_way(table(spark, d, "orders"), "o_orderstatus", {"F": 0.4, "O": 0.4, "P": 0.2}), 4)


@query("SELECT l_discount AS value, round(max(c), 8) AS at_most, round(min(b), 8) AS below FROM (SELECT l_discount, cume_dist() OVER (ORDER BY l_discount) AS c, (rank() OVER (ORDER BY l_discount) - 1) / count(*) OVER () AS b FROM lineitem) GROUP BY 1")
def ecdf(spark, d):
    return rounded(A.ecdf(table(spark, d, "lineitem"), "l_discount"), 8)


@query("SELECT p::DOUBLE AS point, round(avg((l_quantity <= p)::INT), 8) AS share FROM (VALUES (5), (20), (50)) AS g(p), lineitem GROUP BY 1")
def ecdf_at(spark, d):
    return rounded(A.ecdf_at(table(spark, d, "lineitem"), "l_quantity", [5, 20, 50]), 8)


@query("""WITH e AS (SELECT min(l_quantity) AS x0, (max(l_quantity) - min(l_quantity)) / 10 AS sx, min(l_discount) AS y0, (max(l_discount) - min(l_discount)) / 10 AS sy FROM lineitem),
  u AS (SELECT *, (l_quantity - x0) / sx AS u, (l_discount - y0) / sy AS v FROM lineitem, e), p AS (SELECT *, (u - floor(u + 0.5)) ** 2 + 3 * (v - floor(v + 0.5)) ** 2 <= (u - floor(u) - 0.5) ** 2 + 3 * (v - floor(v) - 0.5) ** 2 AS near FROM u)
  SELECT round(x0 + sx * CASE WHEN near THEN floor(u + 0.5) ELSE floor(u) + 0.5 END, 6) AS cx, round(y0 + sy * CASE WHEN near THEN floor(v + 0.5) ELSE floor(v) + 0.5 END, 6) AS cy, count(*) AS n FROM p GROUP BY 1, 2""")
def hexbin(spark, d):
    return rounded(A.hexbin(table(spark, d, "lineitem"), "l_quantity", "l_discount"))


@query("""WITH n AS (SELECT l_quantity AS v, count(*) AS n FROM lineitem GROUP BY 1), g AS (SELECT 1 + k * (49.0::DOUBLE / 19) AS point FROM range(20) AS r(k))
  SELECT round(point, 6) AS point, round(sum(n * exp(-0.5 * ((v - point) / 3) ** 2) * 0.3989422804014327 / 3) / sum(n), 8) AS density FROM g, n GROUP BY 1""")
def kernel_density(spark, d):
    out = A.kernel_density(table(spark, d, "lineitem"), "l_quantity", 3.0, 1.0, 50.0)
    return out.select(F.round("point", 6).alias("point"), F.round("density", 8).alias("density"))


def _draws(spark, d):
    """Each order date's prices stand for a draw of five arms."""
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("draw"), F.col("l_linenumber").cast("bigint").alias("arm")).agg(F.max("l_extendedprice").alias("value"))


_DRAWS = "d AS (SELECT l_orderkey AS draw, l_linenumber::BIGINT AS arm, max(l_extendedprice) AS value FROM lineitem GROUP BY 1, 2), b AS (SELECT draw, arm FROM d QUALIFY row_number() OVER (PARTITION BY draw ORDER BY value DESC, arm) = 1), w AS (SELECT arm, count(*) AS wins FROM b GROUP BY 1)"


@query(f"WITH {_DRAWS} SELECT arm, coalesce(wins, 0) AS wins, round(coalesce(wins, 0) / (SELECT sum(wins) FROM w), 8)::DOUBLE AS probability FROM (SELECT DISTINCT arm FROM d) LEFT JOIN w USING (arm)")
def optimal_arms(spark, d):
    return rounded(A.optimal_arms(_draws(spark, d)), 8)


@query(f"WITH {_DRAWS}, o AS (SELECT arm FROM w ORDER BY wins DESC, arm LIMIT 1), t AS (SELECT draw, max(value) AS best FROM d GROUP BY 1) SELECT draw, round(best - value, 4) AS remaining FROM d JOIN o USING (arm) JOIN t USING (draw)")
def value_remaining(spark, d):
    return rounded(A.value_remaining(_draws(spark, d)), 4)


@query("""SELECT l_returnflag AS variable, round(avg(l_discount), 8) AS mean, round(stddev_samp(l_discount), 8) AS sd, round(avg(nullif(l_discount, 0)), 8) AS mean_included, round(stddev_samp(nullif(l_discount, 0)), 8) AS sd_included,
  round(avg((l_discount <> 0)::INT), 8) AS inclusion FROM lineitem GROUP BY 1""")
def coefficient_summary(spark, d):
    return rounded(A.coefficient_summary(table(spark, d, "lineitem").select(F.col("l_returnflag").alias("variable"), F.col("l_discount").alias("value"))), 8)


@query("""WITH n AS (SELECT max(event_id) AS b, min(event_id) AS a FROM events), c AS (SELECT quantile_cont(value, 0.5) AS cut FROM events, n WHERE event_id > b - 0.1 * (b - a + 1)) SELECT min(event_id) AS burn FROM events, c WHERE value >= cut""")
def suggest_burn(spark, d):
    return A.suggest_burn(table(spark, d, "events"), "event_id", "value")


@query("""WITH r AS (SELECT l_discount + l_quantity / 100 AS p, (l_returnflag = 'R')::INT::DOUBLE AS y FROM lineitem), c AS (SELECT quantile_cont(p, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS c FROM r)
  SELECT len(list_filter(c, lambda x: x < p)) AS decile, count(*) AS n, round(avg(p), 6) AS predicted, round(avg(y), 6) AS observed FROM r, c GROUP BY 1""")
def hosmer_lemeshow(spark, d):
    r = table(spark, d, "lineitem").select("l_orderkey", (F.col("l_discount") + F.col("l_quantity") / 100).alias("p"), (F.col("l_returnflag") == "R").cast("double").alias("y"))
    return rounded(A.hosmer_lemeshow(r, "p", "y", "l_orderkey"))


_ORDERS = {"numeric": ("o_orderkey", "o_custkey", "o_totalprice"), "categorical": ("o_orderstatus", "o_orderpriority")}
_NUMERIC = {"observed": "count({c})", "missing": "count(*) - count({c})", "distinct_values": "count(DISTINCT {c})", "mean": "avg({c})", "sd": "stddev_samp({c})", "min": "min({c})", **{n: f"quantile_cont({{c}}::DOUBLE, {p})" for n, p in A.TWENTIETHS.items()}, "max": "max({c})"}
_LEVELS = {"observed": "count({c})", "missing": "count(*) - count({c})", "levels": "count(DISTINCT {c})", "is_binary": "(count(DISTINCT {c}) = 2)::INT", "high_cardinality": "(count(DISTINCT {c}) > greatest(100, cbrt(count({c}))))::INT"}
_TIMES = {"observed": "count({c})", "missing": "count(*) - count({c})", "days": "count(DISTINCT {c}::DATE)", "first": "min(epoch_us({c})) / 1e6", "last": "max(epoch_us({c})) / 1e6"}


@query(
    " UNION ALL ".join(
        f"SELECT '{c}' AS variable, '{kind}' AS kind, '{s}' AS statistic, round(({e.format(c=c)})::DOUBLE, 4) AS value FROM orders"
        for kind, columns, statistics in (("numeric", _ORDERS["numeric"], _NUMERIC), ("categorical", _ORDERS["categorical"], _LEVELS), ("datetime", ("o_orderdate",), _TIMES))
        for c in columns
        for s, e in statistics.items()
    )
)
def summary(spark, d):
    return rounded(A.summary(table(spark, d, "orders")), 4)


@query("""WITH c AS (SELECT level, share, (SELECT count(*) FROM orders WHERE o_orderstatus = level) AS o FROM (VALUES ('F', 0.4), ('O', 0.4), ('P', 0.2)) AS g(level, share)),
  s AS (SELECT sum((o - share * t) ** 2 / (share * t))::DOUBLE AS s FROM c, (SELECT sum(o)::DOUBLE AS t FROM c)) SELECT round(s, 4) AS statistic, 2::BIGINT AS df, round(exp(-s / 2), 8) AS p FROM s""")
def chi_square_one_way_p(spark, d):
    found = A.with_chi_square_p(A.chi_square_one_way(table(spark, d, "orders"), "o_orderstatus", {"F": 0.4, "O": 0.4, "P": 0.2}))
    return found.select(F.round("statistic", 4).alias("statistic"), "df", F.round("p", 8).alias("p"))


@query()
def merged_sketches(spark, d):
    """Sketches of each day, stored as columns, merged to those of each type."""
    events = table(spark, d, "events").withColumn("day", F.to_date("ts"))
    daily = A.sketch(events, "value", ["event_type", "day"])
    return A.sketch_quantiles(A.merge_sketches(daily, ["event_type"]), ["event_type"], [0.05, 0.25, 0.5, 0.75, 0.95])
