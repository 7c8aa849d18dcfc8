"""Text sources and sinks: typed delimited files, scans of numbers, lines, draw logs and JSON."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A number as the delimited scan takes it; inf, nan and NA of any case count as numbers.
NUMBER = r"^\s*[+-]?(?:(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?|(?i:inf|infinity|nan|na))\s*$"
DATE = r"^\s*\d{4}-\d{2}-\d{2}(?:[ T]\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?)?\s*$"


def is_numeric(c: Column) -> Column:
    return c.rlike(NUMBER)


def infer_kinds(df: DataFrame, columns: Sequence[str] | None = None, many: int = 20) -> dict[str, str]:
    """numeric, datetime, categorical or high_cardinality for each string column, from one aggregation over all rows.

    A column is numeric if all of its non-empty values are numbers, datetime if all are dates, and else categorical, or
    high_cardinality if over `many` different values occur and they are more than a tenth of the rows. Columns without
    values are numeric. The number of different values is estimated by a sketch.
    """
    columns = list(columns or df.columns)
    value = {c: F.when(F.trim(F.col(c)) != "", F.col(c)) for c in columns}
    facts = []
    for k, c in enumerate(columns):
        facts += [
            F.count(value[c]).alias(f"n{k}"),
            F.count_if(is_numeric(value[c])).alias(f"num{k}"),
            F.count_if(value[c].rlike(DATE)).alias(f"date{k}"),
            F.approx_count_distinct(value[c]).alias(f"d{k}"),
        ]
    seen = df.agg(*facts).first()
    out = {}
    for k, c in enumerate(columns):
        n = seen[f"n{k}"]
        if seen[f"num{k}"] == n:
            out[c] = "numeric"
        elif seen[f"date{k}"] == n:
            out[c] = "datetime"
        else:
            out[c] = "high_cardinality" if seen[f"d{k}"] > max(many, 0.1 * n) else "categorical"
    return out


def _typed(c: str, kind: str) -> Column:
    text = F.trim(F.col(c))
    if kind == "numeric":
        return F.when(F.lower(text).isin("na", "nan", ""), None).otherwise(text.try_cast("double")).alias(c)
    if kind == "datetime":
        return text.try_cast("timestamp").alias(c)
    return F.when(text != "", text).alias(c)


def read_delimited(spark: SparkSession, path: str, *, header: bool = False, sep: str = ",", kinds: dict[str, str] | None = None) -> DataFrame:
    """A delimited text file as typed columns; without a header they are V.0, V.1 and so on.

    Types come from all values (`infer_kinds`) unless kinds gives them, which saves one pass. Quotes are stripped and
    outer white space trimmed; an empty field is missing; a number that reads NA or NaN is missing.
    """
    raw = spark.read.csv(path, header=header, sep=sep, inferSchema=False, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    if not header:
        raw = raw.toDF(*[f"V.{k}" for k in range(len(raw.columns))])
    plain = raw.toDF(*[f"c{k}" for k in range(len(raw.columns))])
    found = {f"c{k}": (kinds or {}).get(c) for k, c in enumerate(raw.columns)}
    open_ = [c for c, kind in found.items() if kind is None]
    found |= infer_kinds(plain, open_) if open_ else {}
    return plain.select(*[_typed(c, found[c]) for c in plain.columns]).toDF(*raw.columns)


def write_delimited(df: DataFrame, path: str, *, sep: str = ",", header: bool = True) -> None:
    df.write.csv(path, sep=sep, header=header)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """value: one row a line, in no given order."""
    return spark.read.text(path)


def numbered_lines(spark: SparkSession, path: str, blank: bool = True) -> DataFrame:
    """value, file, line (from 1 in each file): lines are counted in each block that a task reads, and blocks by where they begin.

    blank: whether lines of white space alone are kept and counted.
    """
    block = ["file", "_start"]
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_at"))
    lines = lines if blank else lines.filter("trim(value) <> ''")
    sizes = lines.groupBy(*block).agg(F.count("*").alias("_n"))
    before = sizes.select(*block, F.coalesce(F.sum("_n").over(Window.partitionBy("file").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(*block).orderBy("_at"))
    return lines.withColumn("_k", inside).join(before, block).select("value", "file", (F.col("_before") + F.col("_k")).alias("line"))


def scan(spark: SparkSession, path: str, *, sep: str | None = None, kind: str = "double", skip: int = 0, nmax: int = 0) -> DataFrame:
    """value: all fields of a text file, cast to one type; fields are parted by white space unless sep is given.

    skip: the lines to pass over at the start of each file; nmax: the lines to read after them, if above 0.
    """
    lines = spark.read.text(path)
    if skip or nmax > 0:
        lines = numbered_lines(spark, path).filter((F.col("line") > skip) & (F.col("line") <= skip + nmax if nmax > 0 else F.lit(True)))
    parts = F.split(F.trim("value"), r"\s+" if sep is None else rf"\Q{sep}\E")
    return lines.select(F.explode(parts).alias("value")).filter("value <> ''").select(F.trim("value").cast(kind).alias("value"))


def matrix_scan(spark: SparkSession, path: str, n_columns: int, *, row: str | None = None, burn: int = 0, thin: int = 1, sep: str = r"\s+") -> DataFrame:
    """Rows of n_columns numbers, V1 to Vn; of them those after the first `burn`, then every thin-th.

    row: the name of a column that numbers the rows in the file (its first), which then gives the order; else rows go by
    their place among the lines of their file that aren't blank.
    """
    parts = F.split(F.trim("value"), sep)
    if row is None and (burn or thin > 1):
        lines = numbered_lines(spark, path, blank=False).withColumnRenamed("line", "_at")
    else:
        lines = spark.read.text(path).filter("trim(value) <> ''").withColumn("_at", F.get(parts, F.lit(0)).cast("bigint") if row else F.lit(None).cast("bigint"))
    kept = lines.filter((F.col("_at") > burn) & ((F.col("_at") - burn) % thin == 0)) if burn or thin > 1 or row else lines
    return kept.select(*[F.get(parts, F.lit(k)).cast("double").alias(f"V{k + 1}") for k in range(n_columns)])


def split_path(c: Column) -> tuple[Column, Column]:
    """Parent and last part of a path; the parent of a single part is empty."""
    return F.regexp_extract(c, r"^(.*)/[^/]*$", 1), F.regexp_extract(c, r"([^/]*)$", 1)


def append_draws(draws: DataFrame, path: str, *, parameter: str = "parameter") -> None:
    """Adds draws (parameter, iteration, value) to a log of Parquet files, a folder a parameter."""
    draws.write.mode("append").partitionBy(parameter).parquet(path)


def last_draw(spark: SparkSession, path: str, *, parameter: str = "parameter", iteration: str = "iteration", value: str = "value") -> DataFrame:
    log = spark.read.parquet(path)
    return log.groupBy(parameter).agg(F.max(iteration).alias(iteration), F.max_by(value, iteration).alias(value))


def to_json_lines(df: DataFrame, column: str = "json") -> DataFrame:
    """One JSON object a row; numbers that are nan become the string "nan", nulls stay as null."""
    fields = [F.when(F.isnan(c), F.lit("nan")).otherwise(F.col(c).cast("string")).alias(c) if kind in ("double", "float") else F.col(c) for c, kind in df.dtypes]
    return df.select(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias(column))


def from_json_lines(df: DataFrame, schema: str, column: str = "json") -> DataFrame:
    """The rows that `to_json_lines` wrote; schema: DDL of the columns that went in."""
    wanted = df.sparkSession.createDataFrame([], schema).dtypes
    as_text = ", ".join(f"`{c}` {'string' if kind in ('double', 'float') else kind}" for c, kind in wanted)
    parsed = df.select(F.from_json(column, as_text).alias("x"))
    return parsed.select(*[F.col("x").getField(c).cast(kind).alias(c) for c, kind in wanted])


def fake_table(spark: SparkSession, n: int, *, numeric: int = 1, levels: dict[str, Sequence[str]] | None = None, dates: int = 0, ids: int = 0, seed: int = 8675309) -> DataFrame:
    """n random rows: normal columns X1.., a uniform column for each list of levels, dates D1.. of 2000 to 2020, random ids U1... The seed fixes them."""
    out = spark.range(n)
    for k in range(numeric):
        out = out.withColumn(f"X{k + 1}", F.randn(seed + k))
    for k, (name, values) in enumerate((levels or {}).items()):
        out = out.withColumn(name, F.element_at(F.array(*map(F.lit, values)), (F.floor(F.rand(seed + 100 + k) * len(values)) + 1).cast("int")))
    for k in range(dates):
        out = out.withColumn(f"D{k + 1}", F.date_add(F.lit("2000-01-01").cast("date"), F.floor(F.rand(seed + 200 + k) * 7305).cast("int")))
    for k in range(ids):
        out = out.withColumn(f"U{k + 1}", F.sha2(F.concat_ws("/", F.lit(seed + k), "id"), 256).substr(1, 12))
    return out
