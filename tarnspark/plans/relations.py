"""Queries of rows, joins, sets, order and shape."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnspark.operators import relations as R

from .profile import rounded
from .register import query, table


@query("SELECT p_partkey, p_brand, dense_rank() OVER (ORDER BY p_brand) - 1 AS code FROM part")
def level_codes(spark, d):
    return R.level_codes(table(spark, d, "part").select("p_partkey", "p_brand"), "p_brand")


@query("SELECT n_nationkey, CASE WHEN n_nationkey = 3 THEN 'NOWHERE' ELSE n_name END AS n_name FROM nation")
def set_cell(spark, d):
    return R.set_cell(table(spark, d, "nation").select("n_nationkey", "n_name"), "n_nationkey", 3, "n_name", "NOWHERE")


@query("SELECT a.c_custkey, a.c_name, b.c_acctbal, upper(b.c_name) AS c_name_2 FROM customer a JOIN customer b USING (c_custkey)")
def bind_columns(spark, d):
    c = table(spark, d, "customer")
    return R.bind_columns(c.select("c_custkey", "c_name"), c.select("c_custkey", "c_acctbal", F.upper("c_name").alias("c_name")), "c_custkey")


@query("SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_acctbal ELSE -1 END AS c_acctbal FROM customer")
def expand_filtered(spark, d):
    c = table(spark, d, "customer")
    return R.expand(c.filter("c_acctbal > 0"), c, "c_custkey", "c_acctbal", -1.0)


@query("SELECT min(o_orderkey) AS first FROM orders WHERE o_totalprice > 200000")
def first_true(spark, d):
    return R.first_true(table(spark, d, "orders"), F.col("o_totalprice") > 200000, "o_orderkey")


@query("SELECT n_nationkey, k::INT AS copy FROM nation, range(3) AS r(k) WHERE k < n_nationkey % 4")
def repeat_rows(spark, d):
    return R.repeat_rows(table(spark, d, "nation").select("n_nationkey"), F.col("n_nationkey") % 4)


@query("SELECT ((n_nationkey * 7 + 3) % 25)::BIGINT AS place, n_name FROM nation")
def permute(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("place"), "n_name")
    mapping = n.select(F.col("place").alias("source"), ((F.col("place") * 7 + 3) % 25).alias("target"))
    return R.permute(n, "place", mapping)


@query("SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) AS n FROM events) WHERE n > 100 AND (n - 100) % 7 = 0")
def burn_and_thin(spark, d):
    return R.every_kth(table(spark, d, "events").select("event_id"), "event_id", 7, 100)


@query("""WITH a AS (SELECT o_orderkey AS place, o_custkey % 50 AS v, row_number() OVER (PARTITION BY o_custkey % 50 ORDER BY o_orderkey) AS k FROM orders),
  b AS (SELECT c_custkey AS place, c_custkey % 60 AS v, row_number() OVER (PARTITION BY c_custkey % 60 ORDER BY c_custkey) AS k FROM customer)
  SELECT a.place, coalesce(b.place, -1) AS found FROM a LEFT JOIN b USING (v, k)""")
def find(spark, d):
    a = table(spark, d, "orders").select(F.col("o_orderkey").alias("place"), (F.col("o_custkey") % 50).alias("v"))
    b = table(spark, d, "customer").select(F.col("c_custkey").alias("place"), (F.col("c_custkey") % 60).alias("v"))
    return R.find(a, b, "v", "place")


@query("""WITH a AS (SELECT p_partkey AS place, p_brand, nullif(p_size, 7) AS p_size FROM part WHERE p_partkey % 3 = 0), b AS (SELECT p_brand, nullif(p_size, 7) AS p_size, min(p_partkey) AS match FROM part WHERE p_partkey % 3 <> 0 GROUP BY 1, 2)
  SELECT place, match FROM a LEFT JOIN b ON a.p_brand IS NOT DISTINCT FROM b.p_brand AND a.p_size IS NOT DISTINCT FROM b.p_size""")
def match_rows(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("place"), "p_brand", F.nullif(F.col("p_size"), F.lit(7)).alias("p_size"))
    return R.match_rows(p.filter("place % 3 = 0"), p.filter("place % 3 <> 0"), ["p_brand", "p_size"], "place")


@query("SELECT c_custkey, c_nationkey, coalesce(n_name, 'Other') AS n_name FROM customer LEFT JOIN (SELECT n_nationkey, n_name FROM nation WHERE n_nationkey < 20) ON n_nationkey = c_nationkey")
def lookup_default(spark, d):
    names = table(spark, d, "nation").filter("n_nationkey < 20").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return R.lookup(table(spark, d, "customer").select("c_custkey", "c_nationkey"), names, "c_nationkey", "n_name", "Other")


@query("SELECT s_suppkey, r_name FROM supplier CROSS JOIN region")
def context_by_arms(spark, d):
    return table(spark, d, "supplier").select("s_suppkey").crossJoin(F.broadcast(table(spark, d, "region").select("r_name")))  # arms: a fixed short table


@query("SELECT a AS position, b AS color, c AS size FROM (VALUES ('Left'), ('Right')) AS x(a), (VALUES ('Red'), ('Blue'), ('Green')) AS y(b), (VALUES ('S'), ('L')) AS z(c)")
def factorial_design(spark, d):
    return R.factorial(spark, {"position": ["Left", "Right"], "color": ["Red", "Blue", "Green"], "size": ["S", "L"]})


@query("SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def merge_visits(spark, d):
    n = lambda e: e.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    e = table(spark, d, "events")
    return R.merge_counts(n(e.filter("event_id % 2 = 0")), n(e.filter("event_id % 2 = 1")), ["user_id", "event_type"], "n")


@query("""WITH a AS (SELECT l_returnflag AS x, l_linestatus AS y, count(*)::DOUBLE AS p FROM lineitem GROUP BY 1, 2), b AS (SELECT l_linestatus AS y, l_linenumber AS z, count(*)::DOUBLE AS p FROM lineitem GROUP BY 1, 2)
  SELECT x, z, sum(a.p * b.p) AS p FROM a JOIN b USING (y) GROUP BY 1, 2""")
def multiply_potentials(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("x"), F.col("l_linestatus").alias("y"), F.col("l_linenumber").alias("z"))
    a, b = (li.groupBy(*k).agg(F.count("*").cast("double").alias("p")) for k in (("x", "y"), ("y", "z")))
    return R.multiply_potentials(a, b, ["x", "z"])


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def top_k(spark, d):
    return R.top(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.asc("o_orderkey")], 25)


@query()
def sample_rows(spark, d):
    return R.sample_rows(table(spark, d, "orders").select("o_orderkey"), 100, "o_orderkey", 17)


@query("""WITH r AS (SELECT p_partkey, p_size, sum(p_size::DOUBLE) OVER (ORDER BY p_partkey) AS c, sum(p_size::DOUBLE) OVER () AS t FROM part), x AS (SELECT p_partkey, p_size, floor(c / t * 500) - floor((c - p_size) / t * 500) AS draws FROM r)
  SELECT p_partkey, p_size, draws::BIGINT AS draws FROM x WHERE draws > 0""")
def resample(spark, d):
    return R.resample(table(spark, d, "part").select("p_partkey", "p_size"), "p_size", "p_partkey", 500)


@query("SELECT c_custkey AS k, c_name AS name FROM customer UNION ALL SELECT s_suppkey, s_name FROM supplier")
def stack(spark, d):
    return R.stack(table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name")), table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name")))


@query("""WITH u AS (SELECT user_id, list_distinct(list(event_type) FILTER (event_id % 2 = 0)) AS a, list_distinct(list(event_type) FILTER (event_id % 2 = 1)) AS b FROM events GROUP BY 1)
  SELECT user_id, list_sort(list_distinct(list_concat(coalesce(a, []), coalesce(b, [])))) AS "union", list_sort(list_intersect(coalesce(a, []), coalesce(b, []))) AS intersection,
  list_sort(list_filter(list_distinct(list_concat(coalesce(a, []), coalesce(b, []))), lambda x: NOT (list_contains(coalesce(a, []), x) AND list_contains(coalesce(b, []), x)))) AS exclusive_or,
  list_sort(list_filter(['click', 'error', 'purchase', 'signup', 'view'], lambda x: NOT list_contains(coalesce(a, []), x))) AS complement, list_has_all(coalesce(a, []), coalesce(b, [])) AS covers, NOT list_has_any(coalesce(a, []), coalesce(b, [])) AS disjoint FROM u""")
def set_algebra(spark, d):
    kinds = lambda r: F.collect_set(F.when(F.col("event_id") % 2 == r, F.col("event_type")))
    u = table(spark, d, "events").groupBy("user_id").agg(kinds(0).alias("a"), kinds(1).alias("b"))
    return R.set_algebra(u, "a", "b", ["click", "error", "purchase", "signup", "view"]).drop("a", "b")


@query("SELECT event_type, min(event_id) AS event_id FROM events GROUP BY 1")
def distinct_in_order(spark, d):
    return R.distinct_in_order(table(spark, d, "events"), "event_type", "event_id")


_KINDS = ("click", "error", "purchase", "signup", "view")
_WIDE = "SELECT ts::DATE::VARCHAR AS day, " + ", ".join(f"round(max_by(value, event_id) FILTER (event_type = '{k}'), 6) AS {k}" for k in _KINDS) + " FROM events GROUP BY 1"


@query(_WIDE)
def long_to_wide(spark, d):
    return rounded(R.long_to_wide(table(spark, d, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd")), "day", "event_type", "value", _KINDS, "event_id"))


@query(f"SELECT day, series, value FROM (UNPIVOT ({_WIDE}) ON {', '.join(_KINDS)} INTO NAME series VALUE value)")
def wide_to_long(spark, d):
    return rounded(R.wide_to_long(long_to_wide(spark, d), "day", _KINDS))


@query("SELECT user_id, list(event_id ORDER BY ts, event_id) AS event_id, list(event_type ORDER BY ts, event_id) AS event_type FROM events GROUP BY 1")
def series_arrays(spark, d):
    return R.series_arrays(table(spark, d, "events"), "user_id", "ts", ["event_id", "event_type"])


@query("SELECT o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def semi_join(spark, d):
    c = table(spark, d, "customer").filter(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"))
    o = table(spark, d, "orders")
    return o.join(c, o["o_custkey"] == c["c_custkey"], "left_semi").select("o_orderkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def anti_join(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    return c.join(o, c["c_custkey"] == o["o_custkey"], "left_anti").select("c_custkey")


@query("SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY 1")
def revenue_by_nation(spark, d):
    li, o, c, n = (table(spark, d, t) for t in ("lineitem", "orders", "customer", "nation"))
    j = li.join(o, li["l_orderkey"] == o["o_orderkey"]).join(c, F.col("o_custkey") == c["c_custkey"]).join(n, F.col("c_nationkey") == n["n_nationkey"])
    return j.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))
