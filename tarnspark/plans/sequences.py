"""Queries of ordered sequences, calendars and events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tarnspark.functions import dates as D
from tarnspark.operators import aggregate as A
from tarnspark.operators import windows as W

from .profile import rounded
from .register import ORACLES, query, table

_BY, _ORDER = ["user_id"], ["ts", "event_id"]


def _iso(c):
    return F.date_format(c, "yyyy-MM-dd")


def _events(spark, d):
    return table(spark, d, "events").select("event_id", "ts", "user_id", "event_type", "value")


@query("SELECT event_id, round(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 6) AS difference FROM events QUALIFY difference IS NOT NULL")
def diff(spark, d):
    return rounded(W.diff(_events(spark, d), "value", _BY, _ORDER).select("event_id", "difference"))


_ACF = "WITH c AS (SELECT user_id, ts, event_id, {x} AS x FROM events), l AS (SELECT user_id, k, sum(x * y) AS s, max(n) AS n FROM (SELECT user_id, k, x, lead(x, k) OVER (PARTITION BY user_id, k ORDER BY ts, event_id) AS y, count(*) OVER (PARTITION BY user_id, k) AS n FROM c, range(4) AS r(k)) GROUP BY 1, 2)"


@query(_ACF.format(x="value - avg(value) OVER (PARTITION BY user_id)") + " SELECT user_id, l.k::INT AS lag, round(l.s / nullif(z.s, 0), 6) AS acf FROM l JOIN (SELECT user_id, s FROM l WHERE k = 0) AS z USING (user_id)")
def acf(spark, d):
    return rounded(W.autocorrelation(_events(spark, d), "value", _BY, _ORDER, 3))


@query(_ACF.format(x="value") + " SELECT user_id, l.k::INT AS lag, round(greatest(-1, least(1, (l.s / l.n) / nullif(sqrt(z.s / z.n), 0))), 6) AS acf FROM l JOIN (SELECT user_id, s, n FROM l WHERE k = 0) AS z USING (user_id)")
def acf_uncentred(spark, d):
    return rounded(W.autocorrelation(_events(spark, d), "value", _BY, _ORDER, 3, centred=False))


@query("SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 6) AS running FROM events")
def running_sum(spark, d):
    return rounded(W.running_sum(_events(spark, d), "value", _BY, _ORDER).select("event_id", "running"))


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) - 1 AS place FROM events")
def ranks(spark, d):
    return W.ranks(_events(spark, d), _BY, [F.desc("value"), F.asc("event_id")]).select("event_id", "place")


_TRANS = "p AS (SELECT lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous, event_type AS next FROM events), c AS (SELECT previous, next, count(*) AS n FROM p WHERE previous IS NOT NULL GROUP BY 1, 2)"


@query(f"WITH {_TRANS} SELECT * FROM c")
def transitions(spark, d):
    return W.transitions(_events(spark, d), "event_type", _BY, _ORDER)


@query("SELECT event_type AS state, count(*) AS n FROM (SELECT event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1) GROUP BY 1")
def initial_states(spark, d):
    return W.initial_states(_events(spark, d), "event_type", _BY, _ORDER)


@query(f"WITH {_TRANS} SELECT previous, next, n, round(value, 8)::DOUBLE AS value FROM (SELECT *, n / sum(n) OVER (PARTITION BY previous) AS value FROM c) WHERE previous <> next ORDER BY value DESC, previous, next LIMIT 6")
def top_transitions(spark, d):
    return rounded(W.top_transitions(transitions(spark, d), 6, drop_same=True), 8)


def _weeks(spark, d):
    """Weekly totals of order prices, by the Saturday that ends the week."""
    o = table(spark, d, "orders").withColumn("week", D.nth_weekday(F.to_date("o_orderdate"), "SA", 1))
    week = F.date_add(F.to_date("o_orderdate"), D.days_until(F.to_date("o_orderdate"), "SA"))
    o = table(spark, d, "orders").groupBy(week.alias("week")).agg(F.sum("o_totalprice").alias("x"))
    return o.withColumns({"ends": D.ends_month(F.col("week")), "fraction": D.share_in_first_month(F.col("week")), "one": F.lit(1)})


_WEEKS = """w AS (SELECT (o_orderdate::DATE + ((6 - dayofweek(o_orderdate::DATE)) % 7)::INT) AS week, sum(o_totalprice) AS x FROM orders GROUP BY 1),
  f AS (SELECT week, x, month(week + 1) <> month(week - 6) AS ends, CASE WHEN month(week - 6) = month(week) THEN 1.0 ELSE 1 - day(week) / 7 END AS fraction FROM w),
  p AS (SELECT *, coalesce(sum(ends::INT) OVER (ORDER BY week ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS period, CASE WHEN ends THEN fraction ELSE 1 END AS fr, week = (SELECT max(week) FROM w) AND ends AND fraction >= 0.9999 AS whole FROM f)"""


@query(f"WITH {_WEEKS} SELECT period, round(sum(v), 2) AS total FROM (SELECT period, fr * x AS v FROM p UNION ALL SELECT period + 1, (1 - fr) * x FROM p WHERE ends AND NOT whole) GROUP BY 1")
def weeks_to_months(spark, d):
    return rounded(W.fractional_periods(_weeks(spark, d), "x", "ends", "fraction", [], ["week"]), 2)


@query(f"""WITH {_WEEKS}, t AS (SELECT period, sum(v) AS total, max(e) AS ended FROM (SELECT period, fr * x AS v, ends::INT AS e FROM p UNION ALL SELECT period + 1, (1 - fr) * x, 0 FROM p WHERE ends AND NOT whole) GROUP BY 1)
  SELECT period, round(total, 2) AS total FROM t WHERE ended = 1 AND NOT (period = 0 AND (SELECT min(fr) FROM p) < 1)""")
def weeks_to_months_trimmed(spark, d):
    return rounded(W.fractional_periods(_weeks(spark, d), "x", "ends", "fraction", [], ["week"], trim=True), 2)


@query(f"""WITH {_WEEKS}, c AS (SELECT week, period, fr * x AS own, coalesce(lag((1 - fr) * x) OVER (ORDER BY week), 0) AS carried FROM p)
  SELECT strftime(week, '%Y-%m-%d') AS week, round(sum(own) OVER (PARTITION BY period ORDER BY week ROWS UNBOUNDED PRECEDING) + first_value(carried) OVER (PARTITION BY period ORDER BY week), 2) AS cumulator FROM c""")
def within_period_sums(spark, d):
    return W.within_period_sums(_weeks(spark, d), "x", "ends", "fraction", [], ["week"]).select(_iso("week").alias("week"), F.round("cumulator", 2).alias("cumulator"))


@query("""WITH n AS (SELECT user_id, event_id, value > 50 AS up, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events), g AS (SELECT *, n - row_number() OVER (PARTITION BY user_id ORDER BY n) AS g FROM n WHERE up)
  SELECT user_id, min(event_id) AS first, max(event_id) AS last, count(*) AS n FROM g GROUP BY user_id, g""")
def runs(spark, d):
    return W.runs(_events(spark, d), F.col("value") > 50, _BY, _ORDER, "event_id")


@query("""WITH i AS (SELECT user_id, epoch_us(ts) // 1000000 AS a, epoch_us(ts) // 1000000 + 7200 AS b FROM events), m AS (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM i),
  g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS g FROM m) SELECT user_id, min(a)::BIGINT AS a, max(b)::BIGINT AS b, count(*) AS n FROM g GROUP BY user_id, g""")
def merge_intervals(spark, d):
    s = F.unix_seconds(F.col("ts").cast("timestamp"))
    return W.merge_intervals(_events(spark, d).select("user_id", s.alias("a"), (s + 7200).alias("b")), _BY, "a", "b")


@query("""WITH k AS (SELECT user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS k FROM events)
  SELECT user_id, k, round((t - coalesce(lag(t) OVER (PARTITION BY user_id ORDER BY t, k), epoch_us(TIMESTAMP '2024-01-01'))) / 1e6, 6) AS seconds FROM k
  UNION ALL SELECT user_id, count(*), round((epoch_us(TIMESTAMP '2024-02-01') - max(t)) / 1e6, 6) FROM k GROUP BY 1""")
def interarrivals(spark, d):
    return rounded(W.interarrivals(_events(spark, d), "ts", _BY, F.lit("2024-01-01").cast("timestamp"), F.lit("2024-02-01").cast("timestamp")), 6)


@query("SELECT user_id, bool_and((event_type = 'purchase') = (lead_id IS NULL)) AS valid FROM (SELECT *, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS lead_id FROM events) GROUP BY 1")
def sequence_validity(spark, d):
    return W.ends_with(_events(spark, d), "event_type", "purchase", _BY, _ORDER)


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events")
def counting_process(spark, d):
    return _events(spark, d).select("event_id", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("bigint").alias("n"))


_DATE = "o_orderdate::DATE"


@query(f"""SELECT DISTINCT strftime(d, '%Y-%m-%d') AS day, year(d) AS year, month(d) AS month, day(d) AS dom, dayofweek(d) AS dow, dayofyear(d) AS doy,
  day(last_day(d)) AS days_in_month, datediff('day', d, last_day(d)) AS left_in_month, CASE WHEN (year(d) % 4 = 0 AND year(d) % 100 <> 0) OR year(d) % 400 = 0 THEN 366 ELSE 365 END - dayofyear(d) AS left_in_year,
  (8 - dayofweek(d)) % 7 AS until_monday, (dayofweek(d) + 6) % 7 AS after_monday, strftime(date_trunc('month', d) + INTERVAL 1 MONTH, '%Y-%m-%d') AS next_month, strftime(date_trunc('month', d) - INTERVAL 1 DAY, '%Y-%m-%d') AS previous_end,
  year(d) + (quarter(d) - 1) / 4 AS decimal_quarter, 12 * (year(d) - 1995) + month(d) - 1 AS months, dayname(d) AS weekday, monthname(d) AS month_name FROM (SELECT {_DATE} AS d FROM orders)""")
def date_parts(spark, d):
    day = F.col("d")
    rows = table(spark, d, "orders").select(F.to_date("o_orderdate").alias("d")).distinct()
    big = lambda c: c.cast("bigint")
    return rows.select(
        _iso(day).alias("day"),
        big(F.year(day)).alias("year"),
        big(F.month(day)).alias("month"),
        big(F.dayofmonth(day)).alias("dom"),
        big(D.day_of_week(day)).alias("dow"),
        big(F.dayofyear(day)).alias("doy"),
        big(D.days_in_month(day)).alias("days_in_month"),
        big(D.days_left_in_month(day)).alias("left_in_month"),
        D.days_left_in_year(day).alias("left_in_year"),
        big(D.days_until(day, "MO")).alias("until_monday"),
        big(D.days_after(day, "MO")).alias("after_monday"),
        _iso(D.start_next_month(day)).alias("next_month"),
        _iso(D.end_previous_month(day)).alias("previous_end"),
        D.decimal_quarter(day).alias("decimal_quarter"),
        big(D.month_distance(F.make_date(F.lit(1995), F.lit(1), F.lit(1)), day)).alias("months"),
        F.date_format(day, "EEEE").alias("weekday"),
        F.date_format(day, "MMMM").alias("month_name"),
    )


@query(f"""SELECT strftime(m, '%Y-%m-%d') AS month, strftime(m + ((8 - dayofweek(m)) % 7)::INT + 7, '%Y-%m-%d') AS second_monday, strftime(last_day(m) - ((dayofweek(last_day(m)) + 6) % 7)::INT, '%Y-%m-%d') AS last_monday
  FROM (SELECT DISTINCT date_trunc('month', {_DATE})::DATE AS m FROM orders)""")
def weekdays_of_month(spark, d):
    m = table(spark, d, "orders").select(F.trunc("o_orderdate", "MM").alias("m")).distinct()
    return m.select(_iso("m").alias("month"), _iso(D.nth_weekday(F.col("m"), "MO", 2)).alias("second_monday"), _iso(D.last_weekday(F.col("m"), "MO")).alias("last_monday"))


_HOLIDAYS = """h(name, day) AS (SELECT n, make_date(y, m, k) FROM ys, (VALUES ('NewYearsDay', 1, 1), ('ValentinesDay', 2, 14), ('SaintPatricksDay', 3, 17), ('USIndependenceDay', 7, 4), ('Halloween', 10, 31), ('VeteransDay', 11, 11), ('ChristmasDay', 12, 25)) AS f(n, m, k)
  UNION ALL SELECT n, make_date(y, m, 1) + ((7 + dow - dayofweek(make_date(y, m, 1))) % 7)::INT + 7 * (k - 1) FROM ys, (VALUES ('MartinLutherKingDay', 1, 1, 3), ('PresidentsDay', 2, 1, 3), ('USMothersDay', 5, 0, 2), ('LaborDay', 9, 1, 1), ('ColumbusDay', 10, 1, 2), ('Thanksgiving', 11, 4, 4), ('USDaylightSavingsTimeBegins', 3, 0, 2), ('USDaylightSavingsTimeEnds', 11, 0, 1)) AS f(n, m, dow, k)
  UNION ALL SELECT 'SuperBowlSunday', make_date(y, 2, 1) + ((7 - dayofweek(make_date(y, 2, 1))) % 7)::INT + CASE WHEN y <= 2021 THEN 0 ELSE 7 END FROM ys
  UNION ALL SELECT 'MemorialDay', make_date(y, 5, 31) - ((dayofweek(make_date(y, 5, 31)) + 6) % 7)::INT FROM ys
  UNION ALL SELECT e.n, s + e.o FROM (VALUES (1995, DATE '1995-04-16'), (1996, DATE '1996-04-07'), (1997, DATE '1997-03-30'), (1998, DATE '1998-04-12'), (1999, DATE '1999-04-04'), (2000, DATE '2000-04-23'), (2001, DATE '2001-04-15')) AS t(y, s), (VALUES ('EasterSunday', 0), ('GoodFriday', -2)) AS e(n, o))"""


@query(f"WITH ys AS (SELECT k::INT AS y FROM range(1995, 2002) AS r(k)), {_HOLIDAYS} SELECT name, strftime(day, '%Y-%m-%d') AS day FROM h")
def holiday_calendar(spark, d):
    return D.holidays(spark, 1995, 2001).select("name", _iso("day").alias("day"))


@query(f"WITH ys AS (SELECT k::INT AS y FROM range(1995, 2002) AS r(k)), {_HOLIDAYS} SELECT name, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN h ON o_orderdate::DATE BETWEEN day - 2 AND day + 2 GROUP BY 1")
def orders_in_holiday_windows(spark, d):
    from tarnspark.operators import relations as R

    windows = D.holiday_windows(D.holidays(spark, 1995, 2001), 2, 2)
    joined = R.within(table(spark, d, "orders"), F.to_date("o_orderdate"), windows, 8)
    return joined.groupBy("name").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query(f"""WITH ys AS (SELECT k::INT AS y FROM range(1995, 2002) AS r(k)), {_HOLIDAYS}, x AS (SELECT g::DATE AS g, EXISTS (SELECT 1 FROM h WHERE name = 'MemorialDay' AND g::DATE BETWEEN day - 2 AND day + 2) AS active FROM range(DATE '1995-01-01', DATE '2002-01-01', INTERVAL 1 DAY) AS r(g)),
  k AS (SELECT g, g - row_number() OVER (ORDER BY g)::INT AS i FROM x WHERE active) SELECT strftime(min(g), '%Y-%m-%d') AS first, strftime(max(g), '%Y-%m-%d') AS last, count(*) AS n FROM k GROUP BY i""")
def holiday_ranges(spark, d):
    days = spark.sql("SELECT explode(sequence(DATE'1995-01-01', DATE'2001-12-31')) AS g")
    windows = D.holiday_windows(D.holidays(spark, 1995, 2001).filter("name = 'MemorialDay'"), 2, 2)
    from tarnspark.operators import relations as R

    on = R.within(days, F.col("g"), windows, 8).select("g", F.lit(True).alias("active"))
    full = days.join(on, "g", "left").withColumn("active", F.coalesce("active", F.lit(False)))
    out = W.runs(full, F.col("active"), [], ["g"], "g")
    return out.select(_iso("first").alias("first"), _iso("last").alias("last"), "n")


@query("SELECT DISTINCT CASE WHEN mn = 1 AND mx = 1 THEN 'day' WHEN mn = 7 AND mx = 7 THEN 'week' WHEN mn >= 28 AND mx <= 32 THEN 'month' ELSE 'other' END AS scale FROM (SELECT min(g) AS mn, max(g) AS mx FROM (SELECT datediff('day', lag(m) OVER (ORDER BY m), m) AS g FROM (SELECT DISTINCT date_trunc('month', o_orderdate) AS m FROM orders)))")
def time_scale(spark, d):
    return D.time_scale(table(spark, d, "orders").select(F.trunc("o_orderdate", "MM").alias("m")), "m")


@query("""WITH x AS (SELECT ts::DATE AS d FROM events), g AS (SELECT datediff('day', lag(d) OVER (ORDER BY d), d) AS g FROM (SELECT DISTINCT d FROM x))
  SELECT (SELECT count(*) FROM x) AS n, (SELECT count(DISTINCT d) FROM x) AS days, (SELECT count(*) = count(DISTINCT d) FROM x) AS no_duplicates, coalesce(max(g) < 1.8 * min(g), true) AS no_gaps, (SELECT count(*) = count(DISTINCT d) FROM x) AND coalesce(max(g) < 1.8 * min(g), true) AS is_regular FROM g""")
def regularity(spark, d):
    return D.regularity(_events(spark, d).select(F.to_date("ts").alias("d")), "d")


query(ORACLES["regularity"], "regularity_all")(regularity)


@query("""WITH x AS (SELECT o_orderdate::DATE AS d, count(*) AS n FROM orders GROUP BY 1), g AS (SELECT unnest(range((SELECT min(d) FROM x), (SELECT max(d) FROM x) + 1, INTERVAL 1 DAY))::DATE AS d)
  SELECT strftime(d, '%Y-%m-%d') AS day, row_number() OVER (ORDER BY d) - 1 AS place, n, n IS NOT NULL AS observed FROM g LEFT JOIN x USING (d)""")
def regularize(spark, d):
    x = table(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("d")).agg(F.count("*").alias("n"))
    return D.regularize(x, "d").select(_iso("d").alias("day"), F.col("place").cast("bigint").alias("place"), "n", "observed")


query(ORACLES["regularize"], "regularize_all")(regularize)


@query("SELECT k, strftime(CASE WHEN last_day(d) = d THEN last_day(d + to_months(k::INT)) ELSE d + to_months(k::INT) END, '%Y-%m-%d') AS day FROM (SELECT last_day(max(o_orderdate::DATE)) AS d FROM orders), range(1, 13) AS r(k)")
def extend_months(spark, d):
    ends = table(spark, d, "orders").select(F.last_day("o_orderdate").alias("day"))
    return D.extend_time(ends, "day", 12, "month").select("k", _iso("day").alias("day"))


@query("""WITH g AS (SELECT t - lag(t) OVER (ORDER BY t) AS g FROM (SELECT DISTINCT epoch_us(ts) AS t FROM events)), c AS (SELECT g, count(*) AS c FROM g WHERE g IS NOT NULL GROUP BY 1)
  SELECT round((max(epoch_us(ts)) - min(epoch_us(ts))) / 1e6, 3) AS seconds, (SELECT min(g) / 1e6 FROM c) AS granularity, round((SELECT max(c) / sum(c) FROM c), 8)::DOUBLE AS modal_share, round(count(*) * 86400e6 / (max(epoch_us(ts)) - min(epoch_us(ts))), 6) AS a_day FROM events""")
def datetime_summary(spark, d):
    out = D.datetime_summary(_events(spark, d), "ts")
    return out.select(F.round("seconds", 3).alias("seconds"), "granularity", F.round("modal_share", 8).alias("modal_share"), F.round("a_day", 6).alias("a_day"))


@query("""WITH t AS (SELECT o_orderkey, o_orderdate::DATE AS d, month(o_orderdate) AS m, day(o_orderdate) AS k, year(o_orderdate) AS y FROM orders)
  SELECT o_orderkey, d::VARCHAR AS us, CASE WHEN k > 12 OR k = m THEN d ELSE make_date(y, k, m) END::VARCHAR AS european, CASE WHEN k > 12 OR k = m THEN d ELSE make_date(y, k, m) END::VARCHAR AS iso, NULL::VARCHAR AS short FROM t""")
def guessed_dates(spark, d):
    o, day = table(spark, d, "orders"), F.col("o_orderdate")
    forms = {"us": ("M/d/yyyy", "/"), "european": ("dd.MM.yyyy", "."), "iso": ("yyyy-MM-dd", "-"), "short": ("M/d/", "/")}
    return o.select("o_orderkey", *[D.guessed_date(F.date_format(day, form), by).cast("string").alias(c) for c, (form, by) in forms.items()])


@query("""WITH t AS (SELECT event_id, epoch_us(ts) - epoch_us(date_trunc('day', ts)) AS s FROM events)
  SELECT event_id, s AS into_day, 86400000000 - s AS to_next_day, 3600000000 - s % 3600000000 AS left_in_hour, (86400000000 - s) % 86400000000 AS remaining FROM t""")
def times_of_day(spark, d):
    """All as whole microseconds."""
    t = F.col("ts")
    parts = {"into_day": D.seconds_into_day(t), "to_next_day": D.seconds_to_next_day(t), "left_in_hour": D.seconds_left_in_hour(t)}
    return table(spark, d, "events").select("event_id", *[F.round(c * 1e6).cast("bigint").alias(n) for n, c in parts.items()], F.round(D.fraction_of_day_remaining(t) * 86400e6).cast("bigint").alias("remaining"))


@query("""SELECT 'orders' AS source, strftime(o_orderdate, '%Y') AS period, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'events', strftime(ts, '%Y-%m-%d'), count(*) FROM events GROUP BY 2
  UNION ALL SELECT 'lines', strftime(date_trunc('week', ts), '%Y-%m-%d'), count(*) FROM (SELECT ts FROM events UNION ALL SELECT ts + INTERVAL 30 DAY FROM events) GROUP BY 2
  UNION ALL SELECT 'hours', strftime(TIMESTAMP '2024-01-01' + (ts - date_trunc('hour', ts)), '%H:%M:%S'), count(*) FROM events GROUP BY 2""")
def grouped_timestamps(spark, d):
    e = _events(spark, d)
    later = e.select("ts").unionByName(e.select((F.col("ts") + F.expr("INTERVAL 30 DAYS")).alias("ts")))
    minutes = e.select((F.lit("2024-01-01").cast("timestamp_ntz") + (F.col("ts") - F.date_trunc("hour", "ts"))).alias("ts"))
    parts = {"orders": table(spark, d, "orders").select(F.col("o_orderdate").cast("timestamp_ntz").alias("ts")), "events": e.select("ts"), "lines": later, "hours": minutes}
    out = [D.group_timestamps(p, "ts").groupBy("period").agg(F.count("*").alias("n")).select(F.lit(s).alias("source"), "period", "n") for s, p in parts.items()]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


@query("""WITH t AS (SELECT epoch_us(ts) / 86400e6 AS t FROM events), e AS (SELECT min(t) AS a, max(t) AS b FROM t), g AS (SELECT a + k * ((b - a) / 11) AS p FROM e, range(12) AS r(k))
  SELECT round(p, 6) AS day, round(sum(exp(-0.5 * ((t - p) / 0.25) ** 2)) * 0.3989422804014327 / 0.25, 4) AS a_day FROM g, t GROUP BY 1""")
def event_intensity(spark, d):
    found = A.event_intensity(table(spark, d, "events"), "ts", 6.0, 12)
    return found.select(F.round(F.unix_micros("at") / 86400e6, 6).alias("day"), F.round("a_day", 4).alias("a_day"))


@query("""WITH g AS (SELECT 'weekday' AS part, k AS slot FROM range(7) AS r(k) UNION ALL SELECT p, k FROM (VALUES ('weekday_hour'), ('weekend_hour')) AS x(p), range(24) AS r(k)),
  n AS (SELECT 'weekday' AS part, dayofweek(ts) AS slot FROM events UNION ALL SELECT CASE WHEN dayofweek(ts) IN (0, 6) THEN 'weekend_hour' ELSE 'weekday_hour' END, hour(ts) FROM events)
  SELECT g.part, g.slot, count(n.slot) AS n FROM g LEFT JOIN n ON n.part = g.part AND n.slot = g.slot GROUP BY 1, 2""")
def weekly_profile(spark, d):
    return D.weekly_profile(_events(spark, d), "ts")


@query("SELECT user_id, count(*) AS n, round(count(*) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 3600e6), 8) AS an_hour, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 3600e6, 6) AS exposure_hours FROM events GROUP BY 1 HAVING count(DISTINCT ts) > 1")
def event_rates(spark, d):
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    p = _events(spark, d).groupBy("user_id").agg(F.count("*").alias("n"), ((F.max(t) - F.min(t)) / 3600e6).alias("exposure_hours")).filter("exposure_hours > 0")
    return p.select("user_id", "n", F.round(F.col("n") / F.col("exposure_hours"), 8).alias("an_hour"), F.round("exposure_hours", 6).alias("exposure_hours"))


@query("SELECT round(sum(n) / sum(e), 8)::DOUBLE AS pooled_rate, round(avg(e), 6) AS mean_exposure FROM (SELECT count(*) AS n, (epoch_us(max(ts)) - epoch_us(min(ts))) / 3600e6 AS e FROM events GROUP BY user_id)")
def pooled_rate(spark, d):
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    p = _events(spark, d).groupBy("user_id").agg(F.count("*").alias("n"), ((F.max(t) - F.min(t)) / 3600e6).alias("e"))
    return p.agg(F.round(F.sum("n") / F.sum("e"), 8).alias("pooled_rate"), F.round(F.avg("e"), 6).alias("mean_exposure"))


@query("SELECT user_id, count(*) + 1 AS size FROM events GROUP BY 1")
def session_sizes(spark, d):
    e = _events(spark, d).select("user_id", "event_type")
    ends = e.select("user_id").distinct().select("user_id", F.lit("<end>").alias("event_type"))
    return e.unionByName(ends).groupBy("user_id").agg(F.count("*").alias("size"))


@query("SELECT strftime(date_trunc('week', ts), '%Y-%m-%d') AS week, round(quantile_cont(value, 0.1), 6) AS q10, round(quantile_cont(value, 0.5), 6) AS q50, round(quantile_cont(value, 0.9), 6) AS q90 FROM events GROUP BY 1")
def quantiles_by_week(spark, d):
    q = F.percentile("value", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    out = _events(spark, d).groupBy(_iso(F.date_trunc("week", "ts")).alias("week")).agg(q.alias("q"))
    return rounded(out.select("week", *[F.get("q", F.lit(k)).alias(n) for k, n in enumerate(("q10", "q50", "q90"))]))
