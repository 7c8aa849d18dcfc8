"""String functions as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def strip_white_space(c: Column) -> Column:
    """All white space goes, inner too."""
    return F.regexp_replace(c, r"\s+", "")


def strip(c: Column, bad: str) -> Column:
    return F.translate(c, bad, "")


def is_all_white(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s", " ")) == ""


def paste(*columns: Column | str, sep: str = " ") -> Column:
    """The values joined by sep; a missing one reads NA."""
    return F.concat_ws(sep, *[F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("NA")) for c in columns])


def paste_rows(df: DataFrame, value: str, order: Sequence[str], by: Sequence[str] = (), sep: str = " ") -> DataFrame:
    """All values of a group joined by sep, in order. A group must fit in memory, as its text does."""
    rows = df.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(*order, value))).alias("v"))
    return rows.select(*by, F.array_join(F.transform("v", lambda x: x[value].cast("string")), sep).alias(value))


def common_prefix(df: DataFrame, c: str) -> str:
    """What all values begin with: that of the least and the greatest, which one aggregation finds."""
    r = df.agg(F.min(c).alias("a"), F.max(c).alias("b")).first()
    n = 0
    for x, y in zip(r.a or "", r.b or "", strict=False):
        if x != y:
            break
        n += 1
    return (r.a or "")[:n]


def common_suffix(df: DataFrame, c: str) -> str:
    return common_prefix(df.select(F.reverse(c).alias(c)), c)[::-1]


def shorten(df: DataFrame, c: str) -> DataFrame:
    """df with c without what all its values begin and end with; where these overlap in a value, it becomes empty."""
    a, b = len(common_prefix(df, c)), len(common_suffix(df, c))
    return df.withColumn(c, F.substring(c, F.lit(a + 1), F.greatest(F.length(c) - a - b, F.lit(0))))


def unique_match(c: Column, legal: Sequence[str]) -> Column:
    """The one legal value that begins with c; null if there is none or more than one. A whole match counts alone."""
    names = F.array(*map(F.lit, legal))
    found = F.filter(names, lambda x: x.startswith(c))
    return F.when(F.array_contains(names, c), c).when(F.size(found) == 1, F.get(found, F.lit(0)))


def parse_range(c: Column) -> Column:
    """"1-3,7" as the array 1, 2, 3, 7."""

    def one(part: Column) -> Column:
        ends = F.transform(F.split(part, "-"), lambda x: F.trim(x).cast("bigint"))
        return F.sequence(F.get(ends, F.lit(0)), F.element_at(ends, -1))

    return F.when(F.trim(c) == "", F.array().cast("array<bigint>")).otherwise(F.flatten(F.transform(F.split(c, ","), one)))


def legal_file_name(c: Column) -> Column:
    """Slashes and white space become underscores."""
    return F.regexp_replace(c, r"[/\s]", "_")


def strip_path(c: Column) -> Column:
    return F.substring_index(c, "/", -1)


def join_path(*parts: Column) -> Column:
    return F.regexp_replace(F.concat_ws("/", *parts), "/{2,}", "/")
