"""Correlations with constants in more than one part: merged from parts, a constant's variance need not be 0."""

import oracle
import pytest
from pyspark.sql import functions as F

from tarnspark.operators import aggregate as A
from tarnspark.plans.catalogue import ORACLES, QUERIES

#: Rows of a part for which 2 / ROWS * ROWS isn't 2.
ROWS = 49


@pytest.fixture
def parts(spark):
    k = F.col("id")
    return spark.range(0, 4 * ROWS, 1, 4).select(F.lit("R").alias("g"), k.alias("x"), (k * 0.0 + 2.0).alias("two"), (k * 0).alias("nought"), F.when(k != 5, k * 0.0 + 2.0).alias("some"), F.when(k == 5, k).alias("single"))


def test_constants_in_parts(parts):
    assert parts.agg(F.var_samp("two")).first()[0] > 0
    near_one = pytest.approx(1.0, abs=1e-12)
    want = {"two nought": 1.0, "two two": 1.0, "two x": 0.0, "x two": 0.0, "x nought": 0.0, "some x": 0.0, "some two": 1.0, "single x": 0.0, "x x": near_one}
    cells = [A.correlation(*map(F.col, pair.split())).alias(pair) for pair in want]
    assert parts.agg(*cells).first().asDict() == want
    assert parts.groupBy("g").agg(*cells).first().asDict() == {"g": "R"} | want
    matrix = {(r.i, r.j): r.correlation for r in A.correlation_matrix(parts, ["x", "two"]).collect()}
    assert matrix == {("x", "x"): near_one, ("x", "two"): 0.0, ("two", "x"): 0.0, ("two", "two"): 1.0}


def test_correlation_of_constants_in_parts(spark, parts, tmp_path, monkeypatch):
    lineitem = parts.select(F.col("g").alias("l_returnflag"), F.col("x").cast("double").alias("l_quantity"), (F.col("x") / 100.0).alias("l_tax"))
    lineitem.write.parquet(str(tmp_path / "lineitem.parquet"))
    monkeypatch.setattr(oracle, "TABLES", ["lineitem"])
    assert not oracle.difference(QUERIES["correlation_of_constants"](spark, str(tmp_path)), str(tmp_path), ORACLES["correlation_of_constants"])


def test_correlation_of_infinities_and_nan(spark):
    inf, nan = float("inf"), float("nan")
    df = spark.createDataFrame([(1.0, inf, nan, 1), (2.0, inf, nan, 2**62), (4.0, inf, nan, -(2**62) - 2**60)], "x double, i double, n double, k bigint")
    got = df.agg(*[A.correlation(F.col("x"), F.col(c)).alias(c) for c in "ink"], A.correlation(F.col("i"), F.col("i")).alias("ii")).first()
    assert got.i != got.i and got.n != got.n and got.ii != got.ii and -1 <= got.k < 0
