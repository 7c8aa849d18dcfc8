"""Filters of streams: many micro-batches end as one batch does, and as the scan over stretches."""

import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnspark.operators import structural as T
from tarnspark.streaming import aggregates, filters

MODEL = T.Model(T.Structure(slope=True, season=4), {"noise": 0.5, "level": 0.2, "slope": 0.01, "season": 0.03}, (1.0, *[0.0] * 4), (4.0, 1.0, *[2.0] * 3))


def _rows(n=60, seed=1):
    rng = np.random.default_rng(seed)
    out = []
    for who in ("a", "b", "c"):
        level = np.cumsum(rng.normal(0, 0.4, n)) + 5
        for t in range(n):
            if who == "c" and 20 <= t < 26:
                continue  # steps without a row
            out.append((who, t, None if t % 11 == 5 else float(level[t] + rng.normal(0, 0.7))))
    return out


def _streamed(spark, rows, schema, cuts, make):
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    path, out, state = (f"{folder}/{n}" for n in ("in", "out", "state"))
    for low, high in zip(cuts, cuts[1:]):
        spark.createDataFrame([r for r in rows if low <= r[1] < high], schema).repartition(3).write.mode("append").parquet(path)
        aggregates.into_table(make(spark.readStream.schema(schema).parquet(path)), out, state).start().awaitTermination()
    return spark.read.parquet(out)


def _by_step(df):
    return {(r.g, r.t, r.kind): tuple(None if v is None else round(v, 9) for v in r[2:7]) for r in df.collect()}


def test_batch_equals_the_scan_over_stretches(spark):
    rows = [r for r in _rows() if r[0] != "c"]
    df = spark.createDataFrame(rows, "g string, t long, y double")
    scan = {(r.g, r.t): r for r in T.rows_of(T.packed(df, "y", "t", ["g"], stretch=9), MODEL, ["g"]).collect()}
    for r in filters.filtered(df, filters.Kalman(MODEL), "y", "t", ["g"]).collect():
        assert np.isclose(r.predicted, scan[r.g, r.t].predicted) and np.isclose(r.predicted_sd, scan[r.g, r.t].predicted_sd)
        if r.t == 59:  # the last filtered level is the smoothed one
            assert np.isclose(r.level, scan[r.g, r.t].level) and np.isclose(r.level_sd, scan[r.g, r.t].level_sd)


@pytest.mark.parametrize("filter_", [filters.Kalman(MODEL), filters.Particles(5.0, 2.0, (0.2, 0.5), n=200)], ids=["kalman", "particles"])
def test_micro_batches_end_as_a_batch(spark, filter_):
    rows, schema = _rows(), "g string, t long, y double"
    whole = _by_step(filters.filtered(spark.createDataFrame(rows, schema), filter_, "y", "t", ["g"]))
    parts = _by_step(_streamed(spark, rows, schema, [0, 7, 8, 31, 60], lambda s: filters.filtered_stream(s, filter_, "y", "t", ["g"])))
    assert len(whole) == len(rows) and whole == parts


def test_late_rows_and_idle_series(spark):
    rows = [("a", t, 1.0, 60 * t) for t in range(10)] + [("a", 3, 9.0, 600)] + [("b", t, 1.0, 60 * t) for t in range(3)] + [("z", t, 0.0, 60 * t) for t in (100, 101)]
    schema = "g string, t long, y double, s long"
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    make = lambda s: filters.filtered_stream(s.withColumn("ts", F.timestamp_seconds(F.col("s") + 1_700_000_000)), filters.Kalman(MODEL), "y", "t", ["g"], ts="ts", late="1 minute", idle=600)
    for part in ([r for r in rows if r[3] < 600 and r[0] != "z"], [r for r in rows if r[3] == 600], [r for r in rows if r[0] == "z"], [("y", 200, 0.0, 12000)]):
        spark.createDataFrame(part, schema).write.mode("append").parquet(f"{folder}/in")
        aggregates.into_table(make(spark.readStream.schema(schema).parquet(f"{folder}/in")), f"{folder}/out", f"{folder}/state").start().awaitTermination()
    got = spark.read.parquet(f"{folder}/out").collect()
    kinds = {}
    for r in got:
        kinds.setdefault(r.g, []).append((r.t, r.kind))
    assert (3, "late") in kinds["a"] and sorted(t for t, k in kinds["a"] if k == "row") == list(range(10))
    assert (9, "idle") in kinds["a"] and (2, "idle") in kinds["b"]


def test_particles_find_level_and_variances(spark):
    rng = np.random.default_rng(7)
    level = 5 + np.cumsum(rng.normal(0, 0.5, 400))
    df = spark.createDataFrame([("a", t, float(level[t] + rng.normal(0, 1.0))) for t in range(400)], "g string, t long, y double")
    known = T.Model(T.Structure(), {"noise": 1.0, "level": 0.25}, (5.0,), (4.0,))
    exact = {r.t: r for r in filters.filtered(df, filters.Kalman(known), "y", "t", ["g"]).collect()}
    found = {r.t: r for r in filters.filtered(df, filters.Particles(5.0, 2.0, (0.1, 2.0), n=3000), "y", "t", ["g"]).collect()}
    gap = np.array([found[t].level - exact[t].level for t in range(50, 400)])
    assert np.abs(gap).mean() < 0.15 and 0.8 < np.mean([found[t].predicted_sd / exact[t].predicted_sd for t in range(200, 400)]) < 1.25
