"""Percentiles of any range of values against sorting them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cinderlog.operators.quantiles import exact_percentiles

WANTED = {"p0": 0.0, "p50": 50.0, "p90": 90.0, "p99": 99.0, "p100": 100.0}


def check(spark, groups, most):
    rows = [(k, float(v)) for k, values in groups.items() for v in values]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    got = {r.k: r for r in exact_percentiles(df, ["k"], F.col("v"), WANTED, most).collect()}
    assert set(got) == {k for k, values in groups.items() if len(values)}
    for k, values in groups.items():
        for name, p in WANTED.items():
            if len(values):
                assert got[k][name] == pytest.approx(np.percentile(np.sort(values), p), rel=1e-12, abs=1e-300), (k, name)


@pytest.mark.parametrize("most", [10_000, 20, 1])
def test_any_range(spark, most):
    draw = np.random.default_rng(1)
    tiny = 2.0 ** draw.integers(-60, 60, 200)
    check(spark, {
        "seconds": draw.random(800), "close": 1.0 + draw.random(500) * 1e-9, "tiny": np.concatenate([tiny, -tiny, tiny * (1 + 2**-50)]),
        "signs": draw.normal(size=400), "same": np.full(50, 7.25), "one": np.array([3.0]), None: draw.integers(0, 5, 300),
        "whole": draw.integers(0, 100_000, 500), "zero": np.concatenate([np.zeros(30), draw.normal(size=30)]),
    }, most)


def test_extremes(spark):
    rows = [(float("inf"),), (float("-inf"),), (0.0,), (5e-324,), (-5e-324,), (1.5,), (None,)]
    got = exact_percentiles(spark.createDataFrame(rows, "v double"), [], F.col("v"), {"a": 0.0, "m": 50.0, "z": 100.0}).first()
    assert (got.a, got.z) == (float("-inf"), float("inf")) and abs(got.m) < 1e-300
    assert exact_percentiles(spark.createDataFrame([], "v double"), [], F.col("v"), {"a": 0.0}).count() == 0


def test_no_task_orders_many_values(spark):
    """A third of a million different values below a second: the opened buckets stay small."""
    df = spark.range(300_000).select((F.rand(3) * 0.9).alias("v"))
    values = df.toPandas()["v"].to_numpy()
    got = exact_percentiles(df, [], F.col("v"), {"m": 50.0, "p99": 99.0}, most_values=100).first()
    assert got.m == pytest.approx(np.percentile(values, 50), rel=1e-12) and got.p99 == pytest.approx(np.percentile(values, 99), rel=1e-12)
