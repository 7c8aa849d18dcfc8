"""Order over all rows in stretches, against a plain sort."""

import random

import pytest
from pyspark.sql import functions as F

from tarnspark.functions import ordered


@pytest.mark.parametrize("keys", [[], [5], [3, 3, 3, 3], list(range(500)), [random.Random(1).randrange(40) for _ in range(300)], [None, 2, None, 1]])
def test_numbering_and_sums(spark, keys):
    df = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k long, i long").repartition(5)
    want = sorted(((k is not None, k or 0, i) for i, k in enumerate(keys)))
    got = {r.i: r.n for r in ordered.numbered(df, "k", "n", ["i"]).collect()}
    assert got == {i: n for n, (_, _, i) in enumerate(want, 1)}
    sums, total = {}, 0
    for _, _, i in want:
        total += i
        sums[i] = total
    assert {r.i: r.s for r in ordered.running(df, "k", "i", "s", ["i"]).collect()} == sums


def test_predecessors(spark):
    keys = random.Random(2).sample(range(10_000), 400)
    df = spark.createDataFrame([(k,) for k in keys], "k long").withColumn("k", F.timestamp_seconds("k"))
    got = {r.k: r.p for r in ordered.previous(df, "k", "p").selectExpr("unix_seconds(k) AS k", "unix_seconds(p) AS p").collect()}
    ends = sorted(keys)
    assert got == dict(zip(ends, [None, *ends[:-1]], strict=True))
