"""Queries for scalar functions, sources and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnspark.functions import dates, folders, mathx, text
from tarnspark.sources import delimited
from tarnspark.streaming import aggregates

from .profile import rounded
from .register import query, table


@query("""SELECT p_partkey, replace(p_brand, ' ', '') AS no_space, regexp_replace(p_type, '[RX]', '', 'g') AS stripped,
  p_brand || '/' || p_type || '/' || CASE WHEN p_size = 7 THEN 'NA' ELSE p_size::VARCHAR END AS pasted, p_brand LIKE 'x%' AS white FROM part""")
def string_functions(spark, d):
    size = F.when(F.col("p_size") != 7, F.col("p_size"))
    return table(spark, d, "part").select(
        "p_partkey",
        text.strip_white_space(F.col("p_brand")).alias("no_space"),
        text.strip(F.col("p_type"), "RX").alias("stripped"),
        text.paste("p_brand", "p_type", size, sep="/").alias("pasted"),
        text.is_all_white(F.col("p_brand")).alias("white"),
    )


@query("SELECT n_regionkey, string_agg(n_name, '|' ORDER BY n_nationkey) AS n_name FROM nation GROUP BY 1")
def paste_rows(spark, d):
    return text.paste_rows(table(spark, d, "nation"), "n_name", ["n_nationkey"], ["n_regionkey"], "|")


@query("SELECT c_custkey, ltrim(substr(c_name, 1 + (SELECT max(k) FROM range(1, 40) AS r(k) WHERE (SELECT count(DISTINCT substr(c_name, 1, k)) FROM customer) = 1)::INT)) AS c_name FROM customer")
def shorten(spark, d):
    return text.shorten(table(spark, d, "customer").select("c_custkey", "c_name"), "c_name")


@query("SELECT r_regionkey, CASE WHEN r_regionkey = 0 THEN [1, 2, 3, 7] ELSE [r_regionkey, r_regionkey + 1, 40] END::BIGINT[] AS numbers FROM region")
def parse_range(spark, d):
    asked = F.when(F.col("r_regionkey") == 0, F.lit("1-3,7")).otherwise(F.concat(F.col("r_regionkey").cast("string"), F.lit("-"), (F.col("r_regionkey") + 1).cast("string"), F.lit(",40")))
    return table(spark, d, "region").select("r_regionkey", text.parse_range(asked).alias("numbers"))


@query("""WITH k AS (SELECT unnest(['purchase', 'purge', 'view', 'error']) AS legal)
  SELECT event_id, (SELECT CASE WHEN count(*) FILTER (legal = p) = 1 THEN p WHEN count(*) = 1 THEN max(legal) END FROM k WHERE starts_with(legal, p)) AS matched
  FROM (SELECT event_id, substr(event_type, 1, 1 + (event_id % 8)::INT) AS p FROM events)""")
def unique_match(spark, d):
    short = F.substring("event_type", F.lit(1), (1 + F.col("event_id") % 8).cast("int"))
    return table(spark, d, "events").select("event_id", text.unique_match(short, ["purchase", "purge", "view", "error"]).alias("matched"))


@query("SELECT page_id, regexp_extract(url, '^(.*)/[^/]*$', 1) AS parent, regexp_extract(url, '([^/]*)$', 1) AS last, regexp_replace(url, '[/\\s]', '_', 'g') AS file FROM pages")
def path_functions(spark, d):
    parent, last = delimited.split_path(F.col("url"))
    return table(spark, d, "pages").select("page_id", parent.alias("parent"), last.alias("last"), text.legal_file_name(F.col("url")).alias("file"))


@query("""SELECT l_orderkey, l_linenumber, round(CASE WHEN l_discount > 0 THEN ln(l_discount / (1 - l_discount)) END, 8) AS logit,
  round(1 / (1 + exp(-(l_quantity - 25))), 8) AS inverse, round(greatest(l_quantity - 25, 0) + ln(1 + exp(-abs(l_quantity - 25))), 8) AS lope FROM lineitem""")
def logit_functions(spark, d):
    x = F.col("l_quantity") - 25
    return rounded(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", mathx.logit(F.col("l_discount")).alias("logit"), mathx.logit_inv(x).alias("inverse"), mathx.lope(x).alias("lope")), 8)


@query("""SELECT s_suppkey, round(1 / z, 8) AS p0, round(exp(a) / z, 8) AS p1, round(exp(b) / z, 8) AS p2 FROM
  (SELECT s_suppkey, s_acctbal / 2000 AS a, -s_acctbal / 5000 AS b, 1 + exp(s_acctbal / 2000) + exp(-s_acctbal / 5000) AS z FROM supplier)""")
def multinomial_logit(spark, d):
    p = mathx.multinomial_logit_inv(F.array(F.col("s_acctbal") / 2000, -F.col("s_acctbal") / 5000))
    return rounded(table(spark, d, "supplier").select("s_suppkey", p.alias("p")).select("s_suppkey", *[F.get("p", F.lit(k)).alias(f"p{k}") for k in range(3)]), 8)


@query("SELECT l_returnflag, round(max(m) + ln(sum(exp(l_quantity - m))), 6) AS lse FROM (SELECT *, max(l_quantity) OVER (PARTITION BY l_returnflag) AS m FROM lineitem) GROUP BY 1")
def log_sum_exp(spark, d):
    return rounded(mathx.log_sum_exp(table(spark, d, "lineitem"), "l_quantity", ["l_returnflag"]))


@query("SELECT o_orderpriority, p::BIGINT AS size, round(n / sum(n) OVER (PARTITION BY o_orderpriority), 8)::DOUBLE AS share FROM (SELECT o_orderpriority, o_custkey % 4 AS p, count(*) AS n FROM orders GROUP BY 1, 2)")
def normalized_shares(spark, d):
    n = table(spark, d, "orders").groupBy("o_orderpriority", (F.col("o_custkey") % 4).alias("size")).agg(F.count("*").alias("n"))
    return rounded(mathx.normalize(n, "n", ["o_orderpriority"], "share"), 8).drop("n")


@query("""SELECT p_partkey, round(-0.5 * ((p_size - 25) / 10.0) ** 2 - ln(10) - 0.5 * ln(2 * pi()), 6) AS normal,
  round(2 * ln(0.1) - lgamma(2) + ln(p_size) - 0.1 * p_size, 6) AS gamma, round(p_size * ln(20) - 20 - lgamma(p_size + 1), 6) AS poisson,
  round(lgamma(61) - lgamma(p_size + 1) - lgamma(61 - p_size) + p_size * ln(0.4) + (60 - p_size) * ln(0.6), 6) AS binomial,
  round(lgamma(2.5) - lgamma(2) - 0.5 * ln(4 * pi()) - 2.5 * ln(1 + p_size * p_size / 4.0), 6) AS student FROM part""")
def log_densities(spark, d):
    x = F.col("p_size").cast("double")
    kinds = {"normal": (25, 10), "gamma": (2, 0.1), "poisson": (20,), "binomial": (60, 0.4), "student": (4,)}
    return rounded(table(spark, d, "part").select("p_partkey", *[mathx.log_density(k, x, *p).alias(k) for k, p in kinds.items()]))


@query()
def spline_basis(spark, d):
    return mathx.bspline(table(spark, d, "part").select("p_partkey", "p_size"), "p_size", [1, 10, 25, 50])


@query("SELECT o_orderkey::DOUBLE AS o_orderkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders")
def delimited_round_trip(spark, d):
    """orders written as delimited text, and read back with types inferred from all values."""
    path = folders.new_path(spark, "orders-csv")
    delimited.write_delimited(table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("o_orderdate"), "o_orderpriority"), path)
    return delimited.read_delimited(spark, path, header=True)


@query("SELECT event_id, event_type, CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS value FROM events")
def json_round_trip(spark, d):
    rows = table(spark, d, "events").select("event_id", "event_type", F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("value"))
    return delimited.from_json_lines(delimited.to_json_lines(rows), "event_id long, event_type string, value double")


@query("SELECT event_type AS parameter, max(event_id) AS iteration, arg_max(value, event_id) AS value FROM events GROUP BY 1")
def last_draws(spark, d):
    """events as a log of draws, written in two goes; of each parameter the last draw."""
    path = folders.new_path(spark, "draws")
    draws = table(spark, d, "events").select(F.col("event_type").alias("parameter"), F.col("event_id").alias("iteration"), "value")
    delimited.append_draws(draws.filter("iteration % 2 = 0"), path)
    delimited.append_draws(draws.filter("iteration % 2 = 1"), path)
    return delimited.last_draw(spark, path)


def _streamed(spark, d, f):
    """f of events as a stream of four chunks in order of time, each of many files and worked through before the next is there.
    A last row two days later, of nothing but its time, closes all windows."""
    path, out, state = (folders.new_path(spark, n) for n in ("event-files", "stream-out", "stream-state"))
    events = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    at = F.unix_micros("ts")
    cuts = events.select(F.percentile_approx(at, [0.25, 0.5, 0.75]).alias("q")).first().q or []
    bounds = zip([None, *cuts], [*cuts, None], strict=True)
    chunks = [events.filter((F.lit(True) if low is None else at > low) & (F.lit(True) if high is None else at <= high)) for low, high in bounds]
    later = F.max("ts") + F.expr("INTERVAL 2 DAYS")
    last = events.agg(later.alias("ts")).select(*[F.col(c.name) if c.name == "ts" else F.lit(None).cast(c.dataType).alias(c.name) for c in events.schema])
    for chunk in [*chunks, last]:
        chunk.write.mode("append").parquet(path)
        aggregates.into_table(f(spark.readStream.schema(events.schema).parquet(path)), out, state).start().awaitTermination()
    return spark.read.parquet(out)


@query("""SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(value) AS n, round(sum(value), 4) AS sum, round(sum(value * value), 3) AS sum2 FROM events GROUP BY 1, 2""")
def windowed_moments(spark, d):
    return aggregates.windowed_moments(table(spark, d, "events"), "ts", "value", by=["event_type"]).withColumns({"start": F.col("start").cast("timestamp_ntz"), "sum": F.round("sum", 4), "sum2": F.round("sum2", 3)})


@query("""WITH k AS (SELECT date_trunc('day', ts)::TIMESTAMP AS start, count(value) AS n, round(sum(value), 4) AS sum FROM events GROUP BY 1)
  SELECT start, n, sum FROM k""")
def streamed_moments(spark, d):
    done = _streamed(spark, d, lambda events: aggregates.windowed_moments(events, "ts", "value"))
    return done.select(F.col("start").cast("timestamp_ntz").alias("start"), "n", F.round("sum", 4).alias("sum"))


@query("""WITH s AS (SELECT event_type AS next, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM events)
  SELECT previous, next, count(*) AS n FROM s WHERE previous IS NOT NULL GROUP BY 1, 2""")
def streamed_transitions(spark, d):
    """Chunks of each user's events stitch together over micro-batches, which come in order of time."""
    moves = _streamed(spark, d, lambda events: aggregates.transitions(events, "user_id", "ts", "event_type", "event_id"))
    return moves.groupBy("previous", "next").agg(F.sum("n").alias("n"))


@query("""WITH a AS (SELECT user_id, ts, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS gap FROM events), b AS (SELECT *, sum((gap IS NULL OR gap >= INTERVAL 6 HOUR)::INT) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM a)
  SELECT user_id, min(ts)::TIMESTAMP AS start, (max(ts) + INTERVAL 6 HOUR)::TIMESTAMP AS "end", count(*) AS n FROM b GROUP BY user_id, k""")
def event_sessions(spark, d):
    found = aggregates.sessions(table(spark, d, "events"), "ts", ["user_id"], gap="6 hours")
    return found.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


@query("""WITH c AS (SELECT l_orderkey, l_linenumber, l_quantity AS q, greatest(q - 5, 0) ** 3 AS c5, greatest(q - 15, 0) ** 3 AS c15, greatest(q - 30, 0) ** 3 AS c30, greatest(q - 45, 0) ** 3 AS c45 FROM lineitem)
  SELECT l_orderkey, l_linenumber, q AS b0, round((c5 - c45) / 40 - (c30 - c45) / 15, 6) AS b1, round((c15 - c45) / 30 - (c30 - c45) / 15, 6) AS b2 FROM c""")
def natural_spline(spark, d):
    rows = table(spark, d, "lineitem").withColumn("b", mathx.natural_spline(F.col("l_quantity"), [5, 15, 30, 45]))
    return rows.select("l_orderkey", "l_linenumber", *[F.round(F.get("b", F.lit(k)), 6).alias(f"b{k}") for k in range(3)])


@query("""SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2""")
def windowed_counts(spark, d):
    found = aggregates.windowed_counts(table(spark, d, "events"), "ts", "event_type")
    return found.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""SELECT DISTINCT o_orderdate::DATE AS day, CASE WHEN quarter(o_orderdate::DATE - 6) = quarter(o_orderdate::DATE) THEN 1.0 ELSE round(1 - day(o_orderdate) / 7.0, 8) END::DOUBLE AS share,
  quarter(o_orderdate::DATE + 1) <> quarter(o_orderdate::DATE - 6) AS ends FROM orders""")
def quarter_shares(spark, d):
    """Of weeks that end on each day with an order: how much lies in the first quarter, and whether one ends there."""
    days = table(spark, d, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    return days.select("day", F.round(dates.share_in_first_quarter(F.col("day")), 8).alias("share"), dates.ends_quarter(F.col("day")).alias("ends"))


@query("""SELECT page_id, '/pages/' || regexp_extract(url, '[^/]*$') AS path, regexp_extract(url, '[^/]*$') AS last FROM pages""")
def joined_paths(spark, d):
    last = text.strip_path(F.col("url"))
    return table(spark, d, "pages").select("page_id", text.join_path(F.lit("/pages/"), last).alias("path"), last.alias("last"))
