"""Sources, scalar functions and streams on small inputs."""

import math

import numpy as np
from pyspark.sql import functions as F

from tarnspark.functions import mathx, text
from tarnspark.sources import delimited
from tarnspark.streaming import aggregates


def test_types_are_inferred_from_all_values(spark, tmp_path):
    (tmp_path / "t.csv").write_text('1,a,2020-01-02,"x, y"\nNA, b ,2020-02-03 04:05:06,z\n-3e2,a,,\n')
    df = delimited.read_delimited(spark, str(tmp_path / "t.csv"))
    assert dict(df.dtypes) == {"V.0": "double", "V.1": "string", "V.2": "timestamp", "V.3": "string"}
    rows = sorted(map(tuple, df.collect()), key=lambda r: (r[0] is None, r[0] or 0))
    assert [r[0] for r in rows] == [-300.0, 1.0, None]
    assert rows[2][1] == "b" and rows[1][3] == "x, y" and rows[0][2] is None


def test_empty_and_missing_files_of_values(spark, tmp_path):
    (tmp_path / "e.csv").write_text("a,b\n")
    df = delimited.read_delimited(spark, str(tmp_path / "e.csv"), header=True)
    assert df.columns == ["a", "b"] and df.count() == 0


def test_scans(spark, tmp_path):
    (tmp_path / "n.txt").write_text("1 2.5\n\n3   4\n")
    assert sorted(r.value for r in delimited.scan(spark, str(tmp_path / "n.txt")).collect()) == [1.0, 2.5, 3.0, 4.0]
    (tmp_path / "m.txt").write_text("".join(f"{k} {k * k}\n" for k in range(1, 11)))
    kept = delimited.matrix_scan(spark, str(tmp_path / "m.txt"), 2, burn=3, thin=2).collect()
    assert sorted(tuple(r) for r in kept) == [(5.0, 25.0), (7.0, 49.0), (9.0, 81.0)]


def test_json_keeps_nan_and_null(spark):
    df = spark.createDataFrame([(1, float("nan")), (2, None), (3, 0.5)], "k long, x double")
    back = {r.k: r.x for r in delimited.from_json_lines(delimited.to_json_lines(df), "k long, x double").collect()}
    assert math.isnan(back[1]) and back[2] is None and back[3] == 0.5


def test_fake_table_is_fixed_by_its_seed(spark):
    make = lambda: delimited.fake_table(spark, 50, numeric=2, levels={"c": ["a", "b"]}, dates=1, ids=1).orderBy("id").collect()
    assert make() == make() and {r.c for r in make()} == {"a", "b"}


def test_text_functions(spark):
    df = spark.createDataFrame([("pre-a-post",), ("pre-bcd-post",)], "s string")
    assert text.common_prefix(df, "s") == "pre-" and text.common_suffix(df, "s") == "-post"
    assert sorted(r.s for r in text.shorten(df, "s").collect()) == ["a", "bcd"]
    one = spark.createDataFrame([("a b\t",), (" \n",), (None,), ("",)], "s string")
    got = one.select(text.is_all_white(F.col("s")).alias("w"), text.strip_white_space(F.col("s")).alias("n"), text.parse_range(F.lit("2-4, 9")).alias("r")).collect()
    assert [r.w for r in got] == [False, True, None, True] and got[0].n == "ab" and got[0].r == [2, 3, 4, 9]


def test_spline_basis_sums_to_one():
    x = np.linspace(1, 50, 99)
    basis = mathx.bspline_basis(x, [1, 10, 25, 50])
    assert basis.shape == (99, 6) and np.allclose(basis.sum(axis=1), 1) and (basis >= 0).all()
    assert not mathx.bspline_basis(np.array([0.0, 51.0]), [1, 10, 25, 50]).any()


def test_normal_cdf_and_lgamma(spark):
    df = spark.createDataFrame([(0.5,), (3.7,), (40.0,)], "x double")
    for r in df.select("x", mathx.lgamma(F.col("x")).alias("g"), mathx.normal_cdf(F.col("x")).alias("c")).collect():
        assert math.isclose(r.g, math.lgamma(r.x), rel_tol=1e-12, abs_tol=1e-12)
        assert math.isclose(r.c, 0.5 * math.erfc(-r.x / math.sqrt(2)), rel_tol=1e-12)


def test_streamed_transitions_stitch_chunks(spark, tmp_path):
    schema = "u long, ts timestamp, s string"
    rows = [(1, "2024-01-01 00:00:00", "a"), (1, "2024-01-01 00:01:00", "b"), (2, "2024-01-01 00:00:30", "a"), (1, "2024-01-01 00:02:00", None), (1, "2024-01-01 00:03:00", "a")]
    source = str(tmp_path / "in")
    for k, part in enumerate((rows[:1], rows[1:])):
        spark.createDataFrame(part, "u long, ts string, s string").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        aggregates.into_table(aggregates.transitions(stream, "u", "ts", "s"), str(tmp_path / "out"), str(tmp_path / "state")).start().awaitTermination()
    got = {(r.u, r.previous, r.next): r.n for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(1, "a", "b"): 1, (1, "b", "a"): 1}


def test_lines_are_numbered_over_many_blocks(spark, tmp_path):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        for name, n in (("a", 400), ("b", 3)):
            (tmp_path / f"{name}.txt").write_text("".join(f"{k} {k * k}\n" + ("\n" if k % 50 == 0 else "") for k in range(1, n + 1)))
        lines = delimited.numbered_lines(spark, str(tmp_path), blank=False).collect()
        assert len(lines) == 403 and all(r.value.split()[0] == str(r.line) for r in lines)
        assert delimited.numbered_lines(spark, str(tmp_path)).count() == 411
        assert sorted(r.value for r in delimited.scan(spark, str(tmp_path / "a.txt"), skip=2, nmax=2).collect()) == [3, 4, 9, 16]
        assert sorted(r.value for r in delimited.scan(spark, str(tmp_path / "b.txt"), skip=1).collect()) == [2, 3, 4, 9]
        assert [r.V1 for r in delimited.matrix_scan(spark, str(tmp_path / "a.txt"), 2, burn=100, thin=150).orderBy("V1").collect()] == [250, 400]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
        spark.conf.set("spark.sql.files.openCostInBytes", old[1])
