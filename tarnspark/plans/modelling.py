"""Queries of encoders, sufficient statistics and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnspark.functions import mathx
from tarnspark.operators import encode as E
from tarnspark.operators import glm as G
from tarnspark.operators import latent as L
from tarnspark.operators import loglinear as LL
from tarnspark.operators import mixtures as X
from tarnspark.operators import models as M
from tarnspark.operators import sufficient as S
from tarnspark.operators import wide as W

from .profile import rounded
from .register import query, table

_SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


@query("SELECT c_custkey, " + ", ".join(f"""CASE WHEN c_mktsegment = '{s}' THEN 1.0 WHEN c_mktsegment = 'MACHINERY' THEN -1.0 ELSE 0.0 END::DOUBLE AS "c_mktsegment.{s}" """ for s in _SEGMENTS[:-1]) + " FROM customer")
def effects_coding(spark, d):
    return E.encode(table(spark, d, "customer"), E.Effects("c_mktsegment", _SEGMENTS), ["c_custkey"])


@query("SELECT c_custkey, " + ", ".join(f"""(c_mktsegment = '{s}')::INT::DOUBLE AS "c_mktsegment.{s}" """ for s in _SEGMENTS) + " FROM customer")
def one_hot(spark, d):
    return E.encode(table(spark, d, "customer"), E.OneHot("c_mktsegment", _SEGMENTS), ["c_custkey"])


@query("""SELECT o_orderkey, round(ln(o_totalprice), 8) AS "log.o_totalprice", round(sqrt(o_totalprice), 8) AS "sqrt.o_totalprice", (o_orderstatus IN ('F', 'P'))::INT::DOUBLE AS "o_orderstatus.success" FROM orders""")
def transform_encoders(spark, d):
    enc = E.Dataset((E.Transform("o_totalprice", "log"), E.Transform("o_totalprice", "sqrt"), E.Success("o_orderstatus", ("F", "P"))), intercept=False)
    return rounded(E.encode(table(spark, d, "orders"), enc, ["o_orderkey"]), 8)


@query("SELECT l_orderkey, l_linenumber, (nullif(l_discount, 0) IS NULL)::INT::DOUBLE AS \"x.missing\", l_discount AS x FROM lineitem")
def missing_dummy(spark, d):
    li = table(spark, d, "lineitem").withColumn("x", F.nullif("l_discount", F.lit(0.0)))
    return E.encode(li, E.MissingDummy(E.Transform("x")), ["l_orderkey", "l_linenumber"])


@query("""SELECT l_orderkey, l_linenumber, 1.0::DOUBLE AS "(Intercept)", r AS "l_returnflag.A", s AS "l_linestatus.F", r * s AS "l_returnflag.A:l_linestatus.F" FROM
  (SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'A' THEN 1.0 WHEN 'R' THEN -1.0 ELSE 0.0 END::DOUBLE AS r, CASE l_linestatus WHEN 'F' THEN 1.0 WHEN 'O' THEN -1.0 ELSE 0.0 END::DOUBLE AS s FROM lineitem)""")
def interaction_design(spark, d):
    a, b = E.Effects("l_returnflag", ("A", "R")), E.Effects("l_linestatus", ("F", "O"))
    enc = E.from_json(E.to_json(E.Dataset((a, b, E.Interaction(a, b)))))
    return E.encode(table(spark, d, "lineitem"), enc, ["l_orderkey", "l_linenumber"])


@query("""SELECT o_orderkey, 1.0::DOUBLE AS "(Intercept)", o::DOUBLE AS "o_orderstatus.O", p::DOUBLE AS "o_orderstatus.P", h::DOUBLE AS "late.1", (o * h)::DOUBLE AS "o_orderstatus.O:late.1", (p * h)::DOUBLE AS "o_orderstatus.P:late.1" FROM
  (SELECT o_orderkey, (o_orderstatus = 'O')::INT AS o, (o_orderstatus = 'P')::INT AS p, (year(o_orderdate) > 1998)::INT AS h FROM orders)""")
def factorial_columns(spark, d):
    o = table(spark, d, "orders").withColumn("late", (F.year("o_orderdate") > 1998).cast("int").cast("string"))
    return E.encode(o, E.factorial_columns({"o_orderstatus": ["F", "O", "P"], "late": ["0", "1"]}, 2), ["o_orderkey"])


@query("SELECT s_suppkey, " + ", ".join(f"""CASE s_nationkey % 5 WHEN {k} THEN 1.0 WHEN 4 THEN -1.0 ELSE 0.0 END::DOUBLE AS "code.{k}" """ for k in range(4)) + " FROM supplier")
def integer_effects(spark, d):
    return E.encode(table(spark, d, "supplier").withColumn("code", F.col("s_nationkey") % 5), E.integer_effects("code", 5), ["s_suppkey"])


@query("""SELECT l_orderkey, l_linenumber, 1.0::DOUBLE AS "(Intercept)", n AS "l_returnflag.N", r AS "l_returnflag.R", l_discount AS l_discount, round(ln(l_quantity), 8) AS "log.l_quantity", o AS "l_linestatus.O",
  n * l_discount AS "l_returnflag.N:l_discount", r * l_discount AS "l_returnflag.R:l_discount", l_discount * o AS "l_discount:l_linestatus.O" FROM
  (SELECT *, (l_returnflag = 'N')::INT::DOUBLE AS n, (l_returnflag = 'R')::INT::DOUBLE AS r, (l_linestatus = 'O')::INT::DOUBLE AS o FROM lineitem)""")
def formula_design(spark, d):
    li = table(spark, d, "lineitem")
    return rounded(E.encode(li, E.formula(li, "l_returnflag * l_discount + log(l_quantity) + l_linestatus + l_discount:l_linestatus"), ["l_orderkey", "l_linenumber"]), 8)


@query("""SELECT l_orderkey, l_linenumber, (l_returnflag = 'R')::INT::DOUBLE AS "l_returnflag.R", l_discount AS discount FROM lineitem
  WHERE l_discount <> 0 AND l_returnflag IN (SELECT l_returnflag FROM lineitem WHERE l_returnflag <> 'N')""")
def new_data_design(spark, d):
    """An encoder made on goods that were returned or accepted, for all rows: unknown flags and missing discounts leave rows out."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", F.nullif("l_discount", F.lit(0.0)).alias("discount"))
    made = E.from_json(E.to_json(E.formula(li.filter("l_returnflag <> 'N'"), ". - 1", omit=("l_orderkey", "l_linenumber"))))
    return E.predictor_matrix(li, made, ["l_orderkey", "l_linenumber"], unknown="drop")


@query("""SELECT c_custkey, color, size, 1.0::DOUBLE AS "(Intercept)", g AS "color.green", l AS "size.L", b AS "rich.yes", g * l AS "color.green:size.L", g * b AS "color.green:rich.yes", l * b AS "size.L:rich.yes" FROM
  (SELECT c_custkey, color, size, (color = 'green')::INT::DOUBLE AS g, (size = 'L')::INT::DOUBLE AS l, (c_acctbal > 5000)::INT::DOUBLE AS b FROM customer, (VALUES ('red'), ('green')) AS x(color), (VALUES ('S'), ('L')) AS y(size))""")
def bandit_design(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_acctbal") > 5000, "yes").otherwise("no").alias("rich"))
    arms = {"color": ["red", "green"], "size": ["S", "L"]}
    encoder = E.contextual_columns(arms, {"rich": ["no", "yes"]}, 2)
    return E.bandit_design(c, [{"color": a, "size": b} for a in arms["color"] for b in arms["size"]], encoder, ["c_custkey"])


@query("""SELECT l_returnflag, count(l_quantity) AS n, sum(l_quantity) AS sum, sum(l_quantity * l_quantity) AS sum2, round(sum(ln(l_quantity)), 4) AS sum_log, min(l_quantity) AS low, max(l_quantity) AS high,
  round(sum(l_tax), 4) AS sum_w, round(sum(l_tax * l_quantity), 4) AS w_sum, round(sum(l_tax * l_quantity * l_quantity), 4) AS w_sum2 FROM lineitem GROUP BY 1""")
def sufficient_statistics(spark, d):
    q, w = F.col("l_quantity"), F.col("l_tax")
    weighted = [c.alias(n) for c, n in zip(S.gaussian(q, w)[1:], ("sum_w", "w_sum", "w_sum2"), strict=True)]
    return rounded(table(spark, d, "lineitem").groupBy("l_returnflag").agg(*S.gaussian(q), S.gamma(q)[2], *S.uniform(q), *weighted), 4)


@query("SELECT l_returnflag, count(*) FILTER (l_discount > 0 AND l_discount < 1) AS n, round(sum(ln(l_discount)) FILTER (l_discount > 0), 4) AS sum_log, round(sum(ln(1 - l_discount)) FILTER (l_discount > 0), 6) AS sum_log1m FROM lineitem GROUP BY 1")
def beta_statistics(spark, d):
    out = table(spark, d, "lineitem").groupBy("l_returnflag").agg(*S.beta(F.col("l_discount")))
    return out.select("l_returnflag", "n", F.round("sum_log", 4).alias("sum_log"), F.round("sum_log1m", 6).alias("sum_log1m"))


@query("WITH c AS (SELECT c_custkey, count(o_orderkey) AS k FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1) SELECT count(*) FILTER (k = 0) AS zeros, count(*) FILTER (k > 0) AS positive, sum(k)::BIGINT AS sum FROM c")
def zero_inflated_counts(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    k = c.join(o, c["c_custkey"] == o["o_custkey"], "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("k"))
    return k.agg(*S.zero_inflated_poisson(F.col("k")))


@query("SELECT user_id, count(y) AS n, round(sum(y), 4) AS sum, round(sum(y * y), 4) AS sum2, round(sum(y * l), 4) AS cross FROM (SELECT user_id, value AS y, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS l FROM events) GROUP BY 1")
def ar1_statistics(spark, d):
    return rounded(S.ar1("value", ["user_id"], ["ts", "event_id"])(table(spark, d, "events")), 4)


@query("""WITH s AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a, regr_sxx(l_extendedprice, l_quantity) AS sxx, regr_syy(l_extendedprice, l_quantity) AS syy, regr_count(l_extendedprice, l_quantity) AS n, avg(l_quantity) AS m FROM lineitem),
  v AS (SELECT *, (syy - b * b * sxx) / (n - 2) AS s2 FROM s) SELECT '(Intercept)' AS term, round(a, 3) AS estimate, round(sqrt(s2 * (1 / n + m * m / sxx)), 3) AS se, round(a / sqrt(s2 * (1 / n + m * m / sxx)), 3) AS t FROM v UNION ALL SELECT 'l_quantity', round(b, 3), round(sqrt(s2 / sxx), 3), round(b / sqrt(s2 / sxx), 3) FROM v""")
def least_squares(spark, d):
    return rounded(S.least_squares(table(spark, d, "lineitem"), "l_extendedprice", {"(Intercept)": F.lit(1.0), "l_quantity": F.col("l_quantity")}), 3)


@query("""WITH s AS (SELECT regr_count(l_extendedprice, l_quantity) AS n, regr_syy(l_extendedprice, l_quantity) AS syy, regr_sxy(l_extendedprice, l_quantity) ** 2 / regr_sxx(l_extendedprice, l_quantity) AS ssm FROM lineitem)
  SELECT 'model' AS source, 1.0::DOUBLE AS df, round(ssm / 1e6, 2) AS ss_millions, round(ssm / ((syy - ssm) / (n - 2)), 2) AS f, round(ssm / syy, 8) AS r2, round(1 - (1 - ssm / syy) * (n - 1) / (n - 2), 8) AS adjusted_r2 FROM s
  UNION ALL SELECT 'residual', n - 2, round((syy - ssm) / 1e6, 2), NULL, NULL, NULL FROM s UNION ALL SELECT 'total', n - 1, round(syy / 1e6, 2), NULL, NULL, NULL FROM s""")
def lm_anova(spark, d):
    _, out = S.lm(table(spark, d, "lineitem"), "l_extendedprice", {"(Intercept)": F.lit(1.0), "l_quantity": F.col("l_quantity")})
    return out.select("source", "df", F.round(F.col("ss") / 1e6, 2).alias("ss_millions"), F.round("f", 2).alias("f"), F.round("r2", 8).alias("r2"), F.round("adjusted_r2", 8).alias("adjusted_r2"))


@query("SELECT label, i::INT AS i, j::INT AS j, count(*) AS n, round(avg(embedding[i + 1]), 5) AS mean_i, round(avg(embedding[j + 1]), 5) AS mean_j, round(covar_pop(embedding[i + 1]::DOUBLE, embedding[j + 1]::DOUBLE) * count(*), 4) AS s FROM embeddings, range(64) AS a(i), range(64) AS b(j) WHERE i <= j GROUP BY 1, 2, 3")
def mvn_statistics(spark, d):
    out = S.mvn(table(spark, d, "embeddings"), "embedding", ["label"], 64)
    return out.select("label", "i", "j", "n", F.round("mean_i", 5).alias("mean_i"), F.round("mean_j", 5).alias("mean_j"), F.round("s", 4).alias("s"))


@query("SELECT label, (i - 1)::INT AS i, count(*) AS n, round(avg(embedding[i]::DOUBLE), 6) AS mean, round(var_pop(embedding[i]::DOUBLE) * count(*), 5) AS ss FROM embeddings, range(1, 65) AS r(i) GROUP BY 1, 2")
def independent_mvn(spark, d):
    out = S.independent_mvn(table(spark, d, "embeddings"), "embedding", ["label"])
    return out.select("label", "i", "n", F.round("mean", 6).alias("mean"), F.round("ss", 5).alias("ss"))


@query("""SELECT l_linestatus, i, j, round(sum(w), 3) AS sum_w, round(sum(w * x) / sum(w), 8) AS mean_i, round(sum(w * y) / sum(w), 8) AS mean_j, round(sum(w * x * y) - sum(w * x) * sum(w * y) / sum(w), 3) AS s FROM
  (SELECT l_linestatus, l_quantity AS w, unnest(['l_discount', 'l_discount', 'l_tax']) AS i, unnest(['l_discount', 'l_tax', 'l_tax']) AS j, unnest([l_discount, l_discount, l_tax]) AS x, unnest([l_discount, l_tax, l_tax]) AS y FROM lineitem) GROUP BY 1, 2, 3""")
def weighted_mvn(spark, d):
    out = S.weighted_mvn(table(spark, d, "lineitem"), ["l_discount", "l_tax"], "l_quantity", ["l_linestatus"])
    return out.select("l_linestatus", "i", "j", F.round("sum_w", 3).alias("sum_w"), F.round("mean_i", 8).alias("mean_i"), F.round("mean_j", 8).alias("mean_j"), F.round("s", 3).alias("s"))


@query("""WITH s AS (SELECT l_returnflag, [l_quantity / 60, l_discount, 1 - l_quantity / 60 - l_discount] AS p FROM lineitem)
  SELECT l_returnflag, (i - 1)::INT AS i, count(*) AS n, round(sum(ln(p[i])), 4) AS sum_log FROM s, range(1, 4) AS r(i) WHERE p[1] > 0 AND p[2] > 0 AND p[3] > 0 GROUP BY 1, 2""")
def dirichlet_statistics(spark, d):
    a, b = F.col("l_quantity") / 60, F.col("l_discount")
    return rounded(S.dirichlet(table(spark, d, "lineitem").withColumn("p", F.array(a, b, 1 - a - b)), "p", ["l_returnflag"]), 4)


@query("""WITH m AS (SELECT o_custkey, 1 + var_pop(o_totalprice / 1e5) AS a, covar_pop(o_totalprice / 1e5, o_orderkey / 1e4) AS b, 1 + var_pop(o_orderkey / 1e4) AS c FROM orders GROUP BY 1)
  SELECT (i - 1)::INT AS cell, count(*) AS n, round(sum([a, b, b, c][i]), 3) AS sum, round(sum(ln(a * c - b * b)), 3) AS sum_log_det FROM m, range(1, 5) AS r(i) GROUP BY 1""")
def wishart_statistics(spark, d):
    """Of the scatter of each customer's orders, with one of unit variances added."""
    x, y = F.col("o_totalprice") / 1e5, F.col("o_orderkey") / 1e4
    b = F.covar_pop(x, y)
    m = table(spark, d, "orders").groupBy("o_custkey").agg(F.array(1 + F.var_pop(x), b, b, 1 + F.var_pop(y)).alias("m"))
    return S.wishart(m, "m", [], 2).select("cell", "n", F.round("sum", 3).alias("sum"), F.round("sum_log_det", 3).alias("sum_log_det"))


@query(" UNION ALL ".join(f"""SELECT '{y}' AS response, unnest(['one', 'quantity']) AS term, unnest([round(a, 5), round(b, 7)]) AS estimate, unnest([round(sqrt(v * (1 / n + m * m / sxx)), 5), round(sqrt(v / sxx), 7)]) AS se FROM
  (SELECT *, (syy - b * b * sxx) / (n - 2) AS v FROM (SELECT regr_intercept({y}, l_quantity) AS a, regr_slope({y}, l_quantity) AS b, regr_sxx({y}, l_quantity) AS sxx, regr_syy({y}, l_quantity) AS syy, regr_count({y}, l_quantity) AS n, avg(l_quantity) AS m FROM lineitem))""" for y in ("l_discount", "l_tax")))
def multivariate_regression(spark, d):
    out = S.multivariate_regression(table(spark, d, "lineitem"), ["l_discount", "l_tax"], {"one": F.lit(1.0), "quantity": F.col("l_quantity")})
    digits = lambda c: F.when(F.col("term") == "one", F.round(c, 5)).otherwise(F.round(c, 7)).alias(c)
    return out.select("response", "term", digits("estimate"), digits("se"))


@query("SELECT event_type, n, y + 1.0::DOUBLE AS a, n - y + 1.0::DOUBLE AS b, round((y + 1) / (n + 2), 8) AS mean, round(sqrt((y + 1) * (n - y + 1) / ((n + 2) * (n + 2) * (n + 3))), 8) AS sd FROM (SELECT event_type, count(*) FILTER (value > 50)::DOUBLE AS y, count(value) AS n FROM events GROUP BY 1)")
def beta_binomial_arms(spark, d):
    return rounded(S.beta_binomial(table(spark, d, "events"), ["event_type"], F.col("value") > 50), 8)


@query("SELECT user_id, n + 1.0::DOUBLE AS a, 31.0::DOUBLE AS b, round((n + 1) / 31, 8) AS mean, round(sqrt(n + 1.0::DOUBLE) / 31, 8) AS sd FROM (SELECT user_id, count(*) AS n FROM events GROUP BY 1)")
def gamma_poisson_rates(spark, d):
    n = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    return rounded(S.gamma_poisson(n, ["user_id"], F.col("n"), F.lit(30.0)), 8)


@query("""WITH s AS (SELECT o_orderpriority, count(*)::DOUBLE AS n, avg(o_totalprice / 1000) AS m, var_pop(o_totalprice / 1000) * count(*) AS ss FROM orders GROUP BY 1), k AS (SELECT *, 1 + n AS k, (100 + n * m) / (1 + n) AS mu, 2 + n / 2 AS a FROM s)
  SELECT o_orderpriority, round(mu, 5) AS mu, k, a, round(100 + ss / 2 + n * (m - 100) ** 2 / (2 * k), 3) AS b, round((100 + ss / 2 + n * (m - 100) ** 2 / (2 * k)) / (a - 1), 5) AS expected_variance FROM k""")
def normal_inverse_gamma(spark, d):
    out = S.normal_inverse_gamma(table(spark, d, "orders"), ["o_orderpriority"], F.col("o_totalprice") / 1000, 100.0, 1.0, 2.0, 100.0)
    return out.select("o_orderpriority", F.round("mu", 5).alias("mu"), "k", "a", F.round("b", 3).alias("b"), F.round("expected_variance", 5).alias("expected_variance"))


@query("WITH n AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2), f AS (SELECT u.user_id, l.event_type, coalesce(n, 0) AS n FROM (SELECT DISTINCT user_id FROM n) AS u CROSS JOIN (SELECT DISTINCT event_type FROM n) AS l LEFT JOIN n ON n.user_id = u.user_id AND n.event_type = l.event_type) SELECT *, round((n + 1.0::DOUBLE) / sum(n + 1.0::DOUBLE) OVER (PARTITION BY user_id), 8) AS posterior FROM f")
def dirichlet_multinomial(spark, d):
    return rounded(S.dirichlet_multinomial(table(spark, d, "events"), ["user_id"], "event_type"), 8)


@query("SELECT l_discount AS value, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 0.05 * (SELECT count(*) FROM lineitem) ORDER BY n DESC, value LIMIT 3")
def frequent_atoms(spark, d):
    return M.frequent_atoms(table(spark, d, "lineitem"), "l_discount")


@query("SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY l_returnflag, l_linestatus), 8)::DOUBLE AS probability FROM lineitem GROUP BY 1, 2, 3")
def conditional_table(spark, d):
    return rounded(M.conditional_table(table(spark, d, "lineitem"), "l_linenumber", ["l_returnflag", "l_linestatus"]), 8)


@query("SELECT p::DOUBLE AS point, round(avg(1 / (1 + exp(-(0.1 * p - l_discount * 10)))), 8) AS prediction FROM (VALUES (0), (5), (10)) AS g(p), lineitem GROUP BY 1")
def partial_dependence(spark, d):
    return rounded(M.partial_dependence(table(spark, d, "lineitem"), [0, 5, 10], lambda p: 1 / (1 + F.exp(-(0.1 * p - F.col("l_discount") * 10)))), 8)


def _design():
    return {"(Intercept)": F.lit(1.0), "quantity": F.col("l_quantity") / 10, "discount": F.col("l_discount") * 10, "tax": F.col("l_tax") * 10}


@query()
def spike_and_slab(spark, d):
    draws = M.spike_and_slab(table(spark, d, "lineitem"), "l_extendedprice", _design(), draws=200, burn=50)
    from tarnspark.operators.aggregate import coefficient_summary as summary

    return summary(draws.select(F.col("term").alias("variable"), "value"))


@query()
def logistic_regression(spark, d):
    return M.logistic(table(spark, d, "lineitem"), F.col("l_returnflag") == "R", _design())


@query()
def poisson_regression(spark, d):
    return M.poisson_regression(table(spark, d, "lineitem"), F.col("l_linenumber"), _design())


@query()
def local_level_filter(spark, d):
    return M.local_level(table(spark, d, "events"), "value", ["user_id"], ["ts", "event_id"], level_var=1.0, noise_var=100.0)


@query()
def gaussian_mixture(spark, d):
    return M.gaussian_mixture(table(spark, d, "orders"), "o_totalprice", 2)


@query()
def hidden_markov(spark, d):
    return M.hidden_markov(table(spark, d, "events"), "event_type", ("click", "error", "purchase", "signup", "view"), ["user_id"], ["ts", "event_id"], 2)


@query()
def probit_regression(spark, d):
    return G.probit(table(spark, d, "lineitem"), F.col("l_returnflag") == "R", _design())


@query()
def ordinal_logit(spark, d):
    design = {k: c for k, c in _design().items() if k != "(Intercept)"}
    return G.ordinal_logit(table(spark, d, "lineitem"), "l_returnflag", ("A", "N", "R"), design)


@query("""WITH n AS (SELECT l_returnflag AS f, l_linestatus AS s, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1, 2), w AS (SELECT f, max(n) FILTER (s = 'F') AS a, max(n) FILTER (s = 'O') AS b FROM n GROUP BY 1),
  k AS (SELECT w.f AS level, w.a, w.b, z.a AS za, z.b AS zb FROM w, w AS z WHERE z.f = 'A' AND w.f <> 'A')
  SELECT level, 'one' AS term, round(ln(a / za), 7) AS estimate, round(sqrt(1 / a + 1 / za), 7) AS se FROM k UNION ALL SELECT level, 'open', round(ln(b / zb) - ln(a / za), 7), round(sqrt(1 / a + 1 / za + 1 / b + 1 / zb), 7) FROM k""")
def multinomial_logit(spark, d):
    """On one truth value, where the fit is that of the counts."""
    design = {"one": F.lit(1.0), "open": (F.col("l_linestatus") == "O").cast("double")}
    return rounded(G.multinomial_logit(table(spark, d, "lineitem"), "l_returnflag", ("A", "N", "R"), design), 7)


@query("""WITH m AS (SELECT ln(avg(o_totalprice) FILTER (o_orderstatus <> 'F')) AS a, ln(avg(o_totalprice) FILTER (o_orderstatus = 'F')) AS b FROM orders)
  SELECT 'one' AS term, round(a, 7) AS estimate FROM m UNION ALL SELECT 'filled', round(b - a, 7) FROM m""")
def gamma_regression(spark, d):
    """On one truth value, where the fit is that of the means."""
    found, _ = G.gamma_regression(table(spark, d, "orders"), F.col("o_totalprice"), {"one": F.lit(1.0), "filled": (F.col("o_orderstatus") == "F").cast("double")})
    return found.select("term", F.round("estimate", 7).alias("estimate"))


@query("""WITH RECURSIVE c AS (SELECT c_nationkey, c_custkey, count(o_orderkey) AS k FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2),
  s AS (SELECT c_nationkey, count(*) FILTER (k = 0) AS zeros, count(*) FILTER (k > 0) AS positive, sum(k)::DOUBLE / count(*) FILTER (k > 0) AS m FROM c GROUP BY 1),
  h AS (SELECT *, 1e-9::DOUBLE AS low, m AS high, 0 AS step FROM s WHERE m > 1 UNION ALL SELECT c_nationkey, zeros, positive, m, CASE WHEN r / (1 - exp(-r)) < m THEN r ELSE low END, CASE WHEN r / (1 - exp(-r)) < m THEN high ELSE r END, step + 1 FROM (SELECT *, (low + high) / 2 AS r FROM h) WHERE step < 80)
  SELECT c_nationkey, zeros, positive, round(high, 7) AS rate, round(1 - positive::DOUBLE / ((zeros + positive) * (1 - exp(-high))), 7) AS extra FROM h WHERE step = 80""")
def zero_inflated_fit(spark, d):
    """Of the numbers of orders of customers, by nation; the SQL halves an interval."""
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    k = c.join(o, c["c_custkey"] == o["o_custkey"], "left").groupBy("c_nationkey", "c_custkey").agg(F.count("o_orderkey").alias("k"))
    return rounded(G.zero_inflated_fit(k, ["c_nationkey"], F.col("k")), 7)


@query("""WITH x AS (SELECT unnest(['discount', 'quantity', 'tax']) AS term, unnest([l_discount, l_quantity, l_tax]) AS x, l_extendedprice AS y FROM lineitem),
  s AS (SELECT term, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, regr_sxx(y, x) AS sxx, regr_syy(y, x) AS syy, regr_count(y, x) AS n, avg(x) AS m FROM x GROUP BY 1 ORDER BY abs(corr(y, x)) DESC LIMIT 1),
  v AS (SELECT *, (syy - b * b * sxx) / (n - 2) AS s2 FROM s) SELECT '(Intercept)' AS term, round(a, 3) AS estimate, round(sqrt(s2 * (1 / n + m * m / sxx)), 3) AS se FROM v UNION ALL SELECT term, round(b, 3), round(sqrt(s2 / sxx), 3) FROM v""")
def screened_regression(spark, d):
    candidates = {"discount": F.col("l_discount"), "quantity": F.col("l_quantity"), "tax": F.col("l_tax")}
    return rounded(S.screened_regression(table(spark, d, "lineitem"), "l_extendedprice", candidates, 1).drop("t"), 3)


@query("""SELECT l_orderkey, l_linenumber, round(-0.5 * q - 0.5 * ln(7.6e-7) - ln(2 * pi()), 6) AS normal, round(lgamma(3) - lgamma(2) - ln(4 * pi()) - 0.5 * ln(7.6e-7) - 3 * ln(1 + q / 4), 6) AS student FROM
  (SELECT l_orderkey, l_linenumber, (8e-4 * a * a - 4e-4 * a * b + 1e-3 * b * b) / 7.6e-7 AS q FROM (SELECT *, l_discount - 0.05 AS a, l_tax - 0.04 AS b FROM lineitem))""")
def multivariate_densities(spark, d):
    x, at = F.array("l_discount", "l_tax"), ([0.05, 0.04], [[1e-3, 2e-4], [2e-4, 8e-4]])
    return rounded(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", mathx.mvn_log_density(x, *at).alias("normal"), mathx.mvn_log_density(x, *at, df=4.0).alias("student")), 6)


@query("SELECT user_id, date_trunc('day', ts)::DATE AS day, count(value) AS n, round(avg(value), 9) AS mean, round(var_pop(value) * count(value), 7) AS ss FROM events GROUP BY 1, 2")
def multiplexed_series(spark, d):
    out = L.multiplexed(table(spark, d, "events").withColumn("day", F.to_date("ts")), ["user_id"], "day", "value")
    return out.select("user_id", "day", "n", F.round("mean", 9).alias("mean"), F.round("ss", 7).alias("ss"))


@query("""WITH n AS (SELECT l_linestatus AS s, l_returnflag AS f, l_linenumber AS m, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1, 2, 3),
  s AS (SELECT s, sum(n) AS ps FROM n GROUP BY 1), f AS (SELECT s, f, sum(n) / sum(sum(n)) OVER (PARTITION BY s) AS pf FROM n GROUP BY 1, 2), m AS (SELECT f, m, sum(n) / sum(sum(n)) OVER (PARTITION BY f) AS pm FROM n GROUP BY 1, 2)
  SELECT s.s AS l_linestatus, round(sum(ps * pf * pm) / sum(sum(ps * pf * pm)) OVER (), 9) AS p FROM s JOIN f ON f.s = s.s JOIN m ON m.f = f.f WHERE m.m = 1 GROUP BY 1""")
def net_posterior(spark, d):
    """The status of first lines in a chain: status, flag given status, number given flag."""
    li = table(spark, d, "lineitem")
    node = lambda child, parents: M.conditional_table(li, child, parents).drop("n").withColumnRenamed("probability", "p")
    first = li.groupBy("l_linestatus").agg(F.count("*").cast("double").alias("p"))
    found = L.eliminate([first, node("l_returnflag", ["l_linestatus"]), node("l_linenumber", ["l_returnflag"])], ["l_linestatus"], {"l_linenumber": 1})
    return rounded(found, 9)


@query()
def factor_analysis(spark, d):
    return L.factor_analysis(table(spark, d, "embeddings"), "embedding", 64, 2)


@query()
def rasch_items(spark, d):
    items = {"many": F.col("l_quantity") > 25, "cheap": F.col("l_discount") > 0.05, "taxed": F.col("l_tax") > 0.04, "back": F.col("l_returnflag") == "R", "open": F.col("l_linestatus") == "O"}
    return L.rasch(table(spark, d, "lineitem"), items)


@query()
def local_level_fit(spark, d):
    return L.local_level_fit(table(spark, d, "events"), "value", ["user_id"], ["ts", "event_id"])


@query()
def level_forecast(spark, d):
    return L.level_forecast(L.local_level_fit(table(spark, d, "events"), "value", ["user_id"], ["ts", "event_id"]), ["user_id"], 5)


@query()
def zero_inflated_regression(spark, d):
    """Line numbers of goods that came back, 0 for others."""
    one = {"(Intercept)": F.lit(1.0)}
    y = F.when(F.col("l_returnflag") == "R", F.col("l_linenumber")).otherwise(0)
    return L.zero_inflated_regression(table(spark, d, "lineitem"), y, one | {"quantity": F.col("l_quantity") / 10}, one | {"tax": F.col("l_tax") * 10})


@query("""WITH m AS (SELECT i, avg(embedding[i + 1]::DOUBLE) AS m FROM embeddings, range(64) AS r(i) GROUP BY 1)
  SELECT (a.i // 20)::INT AS tile_i, (b.i // 20)::INT AS tile_j, a.i::INT AS i, b.i::INT AS j, round(sum((embedding[a.i + 1]::DOUBLE - a.m) * (embedding[b.i + 1]::DOUBLE - b.m)), 6) AS s
  FROM embeddings, m AS a, m AS b WHERE a.i // 20 <= b.i // 20 GROUP BY 1, 2, 3, 4""")
def gramian_tiles(spark, d):
    """The products of all 64 components, in tiles of 20, four of which a task holds at a time."""
    out = W.gramian_tiles(table(spark, d, "embeddings"), "embedding", 64, block=20, cells=1600)
    return out.select("tile_i", "tile_j", "i", F.posexplode("values").alias("j", "s")).select("tile_i", "tile_j", "i", (F.col("j") + 20 * F.col("tile_j")).alias("j"), F.round("s", 6).alias("s"))


@query()
def wide_spike_and_slab(spark, d):
    """A sum of two components, with the label for noise, on all 64 components, screened in blocks of 16."""
    y = F.get("embedding", F.lit(3)) - F.get("embedding", F.lit(40)) / 2 + F.col("label") / 50
    return W.wide_spike_and_slab(table(spark, d, "embeddings"), y, "embedding", 64, block=16, draws=200, burn=50)


@query("""WITH n AS (SELECT l_returnflag, l_linestatus, l_linenumber, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1, 2, 3),
  c AS (SELECT f.x AS l_returnflag, s.x AS l_linestatus, m.x AS l_linenumber FROM (SELECT DISTINCT l_returnflag AS x FROM n) f, (SELECT DISTINCT l_linestatus AS x FROM n) s, (SELECT DISTINCT l_linenumber AS x FROM n) m),
  a AS (SELECT l_returnflag, l_linestatus, sum(n) AS a FROM n GROUP BY 1, 2), b AS (SELECT l_linestatus, l_linenumber, sum(n) AS b FROM n GROUP BY 1, 2), t AS (SELECT l_linestatus, sum(n) AS t FROM n GROUP BY 1)
  SELECT c.*, coalesce(n, 0.0)::DOUBLE AS n, round(coalesce(a, 0.0) * coalesce(b, 0.0) / t, 6) AS fitted FROM c LEFT JOIN n USING (l_returnflag, l_linestatus, l_linenumber) LEFT JOIN a USING (l_returnflag, l_linestatus) LEFT JOIN b USING (l_linestatus, l_linenumber) JOIN t USING (l_linestatus)""")
def loglinear_cells(spark, d):
    """Flag and line number are independent given the status: a model whose fit SQL can state."""
    return rounded(LL.loglinear_fit(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus", "l_linenumber"], [["l_returnflag", "l_linestatus"], ["l_linestatus", "l_linenumber"]]), 6)


@query("""WITH w AS (SELECT user_id, min(ts) AS s, max(ts) + INTERVAL 1 HOUR AS e FROM events GROUP BY 1),
  h AS (SELECT s, e, unnest(generate_series(date_trunc('hour', s), e - INTERVAL 1 MICROSECOND, INTERVAL 1 HOUR)) AS h FROM w)
  SELECT dayofweek(h)::INT + 1 AS day, hour(h)::INT AS hour, round(sum(epoch_us(least(e, h + INTERVAL 1 HOUR)) - epoch_us(greatest(s, h))) / 3.6e9, 6) AS exposure FROM h GROUP BY 1, 2""")
def weekly_exposure(spark, d):
    """Each user is watched from the first event to an hour after the last."""
    windows = table(spark, d, "events").groupBy("user_id").agg(F.min("ts").alias("s"), (F.max("ts") + F.expr("INTERVAL 1 HOUR")).alias("e"))
    return rounded(LL.week_exposure(windows, "s", "e"), 6)


@query()
def weekly_rates(spark, d):
    events = table(spark, d, "events")
    windows = events.groupBy("user_id").agg(F.min("ts").alias("s"), (F.max("ts") + F.expr("INTERVAL 1 HOUR")).alias("e"))
    counts = events.groupBy(F.dayofweek("ts").alias("day"), F.hour("ts").alias("hour")).agg(F.count("*").alias("n"))
    return rounded(LL.weekly_rates(counts, LL.week_exposure(windows, "s", "e")), 8)


@query("""SELECT l_orderkey, l_linenumber, 1.0::DOUBLE AS "(Intercept)", l_discount, round(ln(l_quantity + 1), 8) AS "log.l_quantity + 1", round(l_quantity * l_tax, 8) AS "l_quantity:l_tax", round(l_discount * l_quantity * l_tax, 8) AS "l_discount:l_quantity:l_tax" FROM lineitem""")
def formula_forms(spark, d):
    """Products of products, an expression inside a transform, and a term taken out again."""
    li = table(spark, d, "lineitem")
    return rounded(E.encode(li, E.formula(li, "l_discount * l_quantity:l_tax + log(l_quantity + 1) + (l_tax + l_quantity) - l_tax - l_quantity"), ["l_orderkey", "l_linenumber"]), 8)


@query()
def vector_mixture(spark, d):
    """Two components on all 64 numbers of the vectors."""
    e = table(spark, d, "embeddings")
    return X.fit_mixture(e, "embedding", 64, 2, prior_rows=200.0, close=1e-3).table(spark).select("component", "weight", F.posexplode("mean").alias("i", "mean"))


@query("SELECT label, ((SELECT max(label) FROM embeddings) - label)::INT AS code, count(*) AS n FROM embeddings GROUP BY 1, 2")
def matched_labels(spark, d):
    """Labels against the same labels counted from the other end."""
    e = table(spark, d, "embeddings")
    last = e.agg(F.max("label").alias("last"))
    coded = e.join(F.broadcast(last)).withColumn("code", (F.col("last") - F.col("label")).cast("int"))
    return X.match_labels(coded, "label", "code")


@query("SELECT o_orderpriority, count(*) AS n, sum(k)::BIGINT AS sum FROM (SELECT o_orderpriority, count(l_orderkey) AS k FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderpriority) GROUP BY 1")
def poisson_statistics(spark, d):
    """Of the numbers of lines of orders, by priority."""
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    k = o.join(li, o["o_orderkey"] == li["l_orderkey"], "left").groupBy("o_orderkey", "o_orderpriority").agg(F.count("l_orderkey").alias("k"))
    return k.groupBy("o_orderpriority").agg(*S.poisson(F.col("k")))
