"""Calendar arithmetic as Column functions, and operators on time grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import previous

#: Days of the week for next_day, Sunday first.
DAYS = ("SU", "MO", "TU", "WE", "TH", "FR", "SA")


def day_of_week(d: Column) -> Column:
    """0 for Sunday to 6 for Saturday."""
    return F.dayofweek(d) - 1


def is_leap_year(y: Column) -> Column:
    return (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))


def days_in_month(d: Column) -> Column:
    return F.dayofmonth(F.last_day(d))


def days_left_in_month(d: Column) -> Column:
    return F.datediff(F.last_day(d), d)


def days_left_in_year(d: Column) -> Column:
    return F.when(is_leap_year(F.year(d)), 366).otherwise(365) - F.dayofyear(d)


def days_until(d: Column, day: str) -> Column:
    """Days to the next `day`, 0 if d is one."""
    return F.datediff(F.next_day(F.date_sub(d, 1), day), d)


def days_after(d: Column, day: str) -> Column:
    """Days since the last `day`, 0 if d is one."""
    return (7 - days_until(d, day)) % 7


def start_next_month(d: Column) -> Column:
    return F.add_months(F.trunc(d, "MM"), 1)


def end_previous_month(d: Column) -> Column:
    return F.date_sub(F.trunc(d, "MM"), 1)


def nth_weekday(d: Column, day: str, n: int) -> Column:
    """The n-th `day` of d's month."""
    return F.date_add(F.next_day(F.date_sub(F.trunc(d, "MM"), 1), day), 7 * (n - 1))


def last_weekday(d: Column, day: str) -> Column:
    return F.next_day(F.date_sub(F.last_day(d), 7), day)


def easter(year: Column) -> Column:
    """Easter Sunday of the Gregorian calendar, by whole-number arithmetic on the year."""
    y = year.cast("int")
    a, b, c = y % 19, F.floor(y / 100), y % 100
    h = (19 * a + b - F.floor(b / 4) - F.floor((b - F.floor((b + 8) / 25) + 1) / 3) + 15) % 30
    m = (32 + 2 * (b % 4) + 2 * F.floor(c / 4) - h - c % 4) % 7
    k = h + m - 7 * F.floor((a + 11 * h + 22 * m) / 451) + 114
    return F.make_date(y, F.floor(k / 31).cast("int"), (k % 31 + 1).cast("int"))


#: Fixed dates (month, day), n-th weekdays (month, weekday, n; -1: last) and days from Easter.
FIXED = {"NewYearsDay": (1, 1), "ValentinesDay": (2, 14), "SaintPatricksDay": (3, 17), "USIndependenceDay": (7, 4), "Halloween": (10, 31), "VeteransDay": (11, 11), "ChristmasDay": (12, 25)}
FLOATING = {"MartinLutherKingDay": (1, "MO", 3), "PresidentsDay": (2, "MO", 3), "USMothersDay": (5, "SU", 2), "MemorialDay": (5, "MO", -1), "LaborDay": (9, "MO", 1), "ColumbusDay": (10, "MO", 2), "Thanksgiving": (11, "TH", 4), "USDaylightSavingsTimeBegins": (3, "SU", 2), "USDaylightSavingsTimeEnds": (11, "SU", 1)}
FROM_EASTER = {"EasterSunday": 0, "GoodFriday": -2}


def holidays(spark, first_year: int, last_year: int) -> DataFrame:
    """name, day: the calendar above and Super Bowl Sunday (first of February until 2021, then the second)."""
    years = spark.range(first_year, last_year + 1).select(F.col("id").cast("int").alias("y"))
    y = F.col("y")
    days = [F.struct(F.lit(n).alias("name"), F.make_date(y, F.lit(m), F.lit(d)).alias("day")) for n, (m, d) in FIXED.items()]
    for n, (m, day, k) in FLOATING.items():
        start = F.make_date(y, F.lit(m), F.lit(1))
        days.append(F.struct(F.lit(n).alias("name"), (last_weekday(start, day) if k < 0 else nth_weekday(start, day, k)).alias("day")))
    days += [F.struct(F.lit(n).alias("name"), F.date_add(easter(y), k).alias("day")) for n, k in FROM_EASTER.items()]
    feb = F.make_date(y, F.lit(2), F.lit(1))
    days.append(F.struct(F.lit("SuperBowlSunday").alias("name"), F.when(y <= 2021, nth_weekday(feb, "SU", 1)).otherwise(nth_weekday(feb, "SU", 2)).alias("day")))
    return years.select(F.inline(F.array(*days)))


def guessed_date(text: Column, delimiter: str = "/") -> Column:
    """The date in a text of three numbers. The year is the one over 31: the last, else the first, else the second; the others
    are read as month and day, as day and month if only that can be. A leading year is followed by the day, if both orders can
    be. NULL where no number is over 31, or where that is no date."""
    parts = F.transform(F.split(F.trim(text), rf"\Q{delimiter}\E"), lambda v: F.try_to_number(F.trim(v), F.lit("9999")).cast("int"))
    a, b, c = (F.get(parts, F.lit(k)) for k in range(3))
    late = c > 31
    year = F.when(late, c).when(a > 31, a).when(b > 31, b)
    first = F.when(late | (a <= 31), a).otherwise(c)
    second = F.when(late | (a > 31), b).otherwise(c)
    month, day = F.when(first > 12, second).otherwise(first), F.when(first > 12, first).otherwise(second)
    return F.when(F.size(parts) == 3, F.try_to_timestamp(F.format_string("%04d-%02d-%02d", year, month, day), F.lit("yyyy-MM-dd")).cast("date"))


def seconds_into_day(ts: Column) -> Column:
    return F.hour(ts) * 3600.0 + F.minute(ts) * 60.0 + F.date_part(F.lit("SECOND"), ts).cast("double")


def seconds_to_next_day(ts: Column) -> Column:
    """More than 0, to 86400 at the start of a day."""
    return 86400.0 - seconds_into_day(ts)


def seconds_left_in_hour(ts: Column) -> Column:
    """More than 0, to 3600 at the start of an hour."""
    return 3600.0 - seconds_into_day(ts) % 3600.0


def fraction_of_day_remaining(ts: Column) -> Column:
    """From 0, at the start of a day, to less than 1."""
    return (seconds_to_next_day(ts) / 86400.0) % 1.0


def group_timestamps(df: DataFrame, ts: str, name: str = "period") -> DataFrame:
    """df with a label of the period each timestamp belongs to, which sorts as time does.

    Years if all span more than 5 of 365 days, months over 365 days, weeks (their Monday) over 30 days, days over one; else
    the time of day, behind its date if there are two. NULL where the timestamp is.
    """
    t = F.col(ts)
    ends = df.agg(F.min(ts).alias("_a"), F.max(ts).alias("_b"))
    span = F.floor((F.unix_micros(F.col("_b").cast("timestamp")) - F.unix_micros(F.col("_a").cast("timestamp"))) / 86400e6)
    form = lambda pattern, c=t: F.date_format(c, pattern)
    label = (
        F.when(span > 5 * 365, form("yyyy")).when(span > 365, form("yyyy-MM")).when(span > 30, form("yyyy-MM-dd", F.date_trunc("week", t))).when(span > 1, form("yyyy-MM-dd"))
        .when(F.to_date("_a") == F.to_date("_b"), form("HH:mm:ss")).otherwise(form("yyyy-MM-dd HH:mm:ss"))
    )
    return df.join(F.broadcast(ends)).withColumn(name, label).drop("_a", "_b")  # one row


def holiday_windows(calendar: DataFrame, before: int, after: int) -> DataFrame:
    return calendar.select("name", F.date_sub("day", before).alias("first"), F.date_add("day", after).alias("last"))


def share_in_first_month(week_end: Column) -> Column:
    """The share of the week ending here that falls into the month it begins in."""
    return F.when(F.month(F.date_sub(week_end, 6)) == F.month(week_end), 1.0).otherwise(1 - F.dayofmonth(week_end) / 7)


def share_in_first_quarter(week_end: Column) -> Column:
    return F.when(F.quarter(F.date_sub(week_end, 6)) == F.quarter(week_end), 1.0).otherwise(1 - F.dayofmonth(week_end) / 7)


def ends_month(week_end: Column) -> Column:
    return F.month(F.date_add(week_end, 1)) != F.month(F.date_sub(week_end, 6))


def ends_quarter(week_end: Column) -> Column:
    return F.quarter(F.date_add(week_end, 1)) != F.quarter(F.date_sub(week_end, 6))


def month_distance(a: Column, b: Column) -> Column:
    return 12 * (F.year(b) - F.year(a)) + F.month(b) - F.month(a)


def decimal_quarter(d: Column) -> Column:
    return F.year(d) + (F.quarter(d) - 1) / 4


def _gaps(df: DataFrame, day: str) -> DataFrame:
    days = df.filter(F.col(day).isNotNull()).select(day).distinct()
    return days.select(F.datediff(day, F.lag(day).over(Window.orderBy(day))).alias("gap")).filter("gap IS NOT NULL")


def time_scale(df: DataFrame, day: str) -> DataFrame:
    """scale: day, week, month, quarter, year or other, by the least and greatest gap."""
    a, b = F.min("gap"), F.max("gap")
    scale = F.when((a == 1) & (b == 1), "day").when((a == 7) & (b == 7), "week").when((a >= 28) & (b <= 32), "month").when((a >= 87) & (b <= 93), "quarter").when((a >= 364) & (b <= 366), "year").otherwise("other")
    return _gaps(df, day).agg(scale.alias("scale"))


def regularity(df: DataFrame, day: str) -> DataFrame:
    """n, distinct days, no_duplicates, no_gaps (no gap of 1.8 times the least or more), is_regular."""
    g = _gaps(df, day).agg(F.coalesce(F.max("gap") < 1.8 * F.min("gap"), F.lit(True)).alias("no_gaps"))
    n = df.filter(F.col(day).isNotNull()).agg(F.count("*").alias("n"), F.countDistinct(day).alias("days"))
    return n.crossJoin(g).select("n", "days", (F.col("n") == F.col("days")).alias("no_duplicates"), "no_gaps", ((F.col("n") == F.col("days")) & F.col("no_gaps")).alias("is_regular"))


def regularize(df: DataFrame, day: str, step: str = "1 day") -> DataFrame:
    """The full grid of days from first to last, with df's rows where they stand; `observed` tells which are there, `place` numbers the grid."""
    ends = df.agg(F.min(day).alias("a"), F.max(day).alias("b"))
    grid = ends.filter("a IS NOT NULL").select(F.posexplode(F.sequence("a", "b", F.expr(f"interval {step}"))).alias("place", day))
    return grid.join(df.withColumn("observed", F.lit(True)), day, "left").withColumn("observed", F.coalesce("observed", F.lit(False)))


def off_grid(df: DataFrame, day: str, step: str) -> DataFrame:
    """The rows that don't stand on the grid."""
    return df.join(regularize(df.select(day).distinct(), day, step).select(day), day, "left_anti")


def extend_time(df: DataFrame, day: str, periods: int, scale: str) -> DataFrame:
    """The next periods after the last day; month ends stay month ends."""
    last = df.agg(F.max(day).alias("d"))
    k = F.explode(F.sequence(F.lit(1), F.lit(periods))).alias("k")
    months = {"month": 1, "quarter": 3, "year": 12}.get(scale)
    if months:
        moved = F.add_months("d", F.col("k") * months)
        at = F.when(F.last_day("d") == F.col("d"), F.last_day(moved)).otherwise(moved)
    else:
        at = F.date_add("d", F.col("k") * {"day": 1, "week": 7}[scale])
    return last.select("d", k).select(F.col("k").cast("bigint").alias("k"), at.alias(day))


def datetime_summary(df: DataFrame, ts: str) -> DataFrame:
    """first, last, seconds between, least positive gap in seconds, share of the modal gap, events a day."""
    t = df.filter(F.col(ts).isNotNull()).select(F.unix_micros(F.col(ts).cast("timestamp")).alias("t"))
    n = t.agg(F.min("t").alias("a"), F.max("t").alias("b"), F.count("*").alias("n"))
    times = t.distinct()
    g = previous(times, "t", "p").select((F.col("t") - F.col("p")).alias("g")).filter("g IS NOT NULL").groupBy("g").agg(F.count("*").alias("c"))
    m = g.agg(F.min("g").alias("least"), (F.max("c") / F.sum("c")).alias("modal_share"))
    return n.crossJoin(m).select(F.timestamp_micros("a").alias("first"), F.timestamp_micros("b").alias("last"), ((F.col("b") - F.col("a")) / 1e6).alias("seconds"), (F.col("least") / 1e6).alias("granularity"), "modal_share", F.try_divide(F.col("n") * 86400e6, F.col("b") - F.col("a")).alias("a_day"))


def weekly_profile(df: DataFrame, ts: str) -> DataFrame:
    """part (weekday, weekday_hour, weekend_hour), slot, n: counts by day (0 Sunday), and by hour of working days and of weekends, with zeros."""
    spark = df.sparkSession
    d = day_of_week(F.col(ts))
    weekend = d.isin(0, 6)
    n = df.filter(F.col(ts).isNotNull()).select(F.inline(F.array(F.struct(F.lit("weekday").alias("part"), d.cast("bigint").alias("slot")), F.struct(F.when(weekend, "weekend_hour").otherwise("weekday_hour").alias("part"), F.hour(ts).cast("bigint").alias("slot"))))).groupBy("part", "slot").agg(F.count("*").alias("n"))
    grid = spark.range(7).select(F.lit("weekday").alias("part"), F.col("id").alias("slot"))
    for part in ("weekday_hour", "weekend_hour"):
        grid = grid.unionByName(spark.range(24).select(F.lit(part).alias("part"), F.col("id").alias("slot")))
    return grid.join(n, ["part", "slot"], "left").select("part", "slot", F.coalesce("n", F.lit(0)).alias("n"))
