"""Columns whose names are also used in results, and null keys."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vitalstream.config import ForecastConfig
from vitalstream.operators import ensemble, forecast, reconstruct, windows
from vitalstream.plans import profile

NAMES = ["n", "v", "i", "t", "us", "y", "total", "column", "value", "rate", "share", "y_scale", "a", "b", "g", "ds", "series"]


@pytest.mark.parametrize("name", NAMES)
def test_value_counts_of_any_column(spark, name):
    got = profile.value_counts(spark.range(40).select((F.col("id") % 2).alias(name)), name)
    shown = "value" if name in ("n", "share") else name
    assert got.columns == [shown, "n", "share"]
    assert sorted(map(tuple, got.collect())) == [(0, 20, 0.5), (1, 20, 0.5)]


@pytest.mark.parametrize("name", ["column", "value", "q1", "median", "n", "anomaly"])
def test_box_stats_by_any_column(spark, name):
    df = spark.range(40).select((F.col("id") % 2).alias(name), F.col("id").cast("double").alias("x"))
    got = profile.box_stats(df, ["x"], name).collect()
    assert sorted((r[0], r["column"], r["median"], r["n"]) for r in got) == [(0, "x", 19.0, 20), (1, "x", 20.0, 20)]


@pytest.mark.parametrize("name", ["n", "us", "rate", "y", "y_scale", "i", "t0", "ds", "series"])
def test_forecast_of_any_key(spark, name):
    df = spark.range(120).select(
        (F.col("id") % 2).alias("k"), F.expr("timestamp_ntz'2024-01-01' + make_interval(0,0,0,0,0,id,0)").alias("timestamp"),
        (F.col("id") * 0.5).alias("x"),
    )
    cfg = ForecastConfig(n_changepoints=3, fourier_order=1)
    plain, _ = forecast.forecast_all(df, ["x"], cfg, keys=["k"])
    named, status = forecast.forecast_all(df.withColumnRenamed("k", name), ["x"], cfg, keys=[name])
    shown = name if name in named.columns and f"key_{name}" not in named.columns else f"key_{name}"
    pick = lambda d, k: sorted((r[k], r["pos"], round(r["yhat"], 9)) for r in d.collect())
    assert pick(named, shown) == pick(plain, "k")
    assert status.count() == 2


def test_null_keys_stay_in_joins(spark):
    rows = [(None, 1, 0), ("a", 1, 1)]
    df = spark.createDataFrame(rows, "k string, timestamp int, anomaly int")
    merged = ensemble.align_results({"x": df.withColumn("split", F.lit("train")), "z": df}, ["k"])
    assert sorted(map(str, map(tuple, merged.collect()))) == ["('a', 1, 'train', 1, 1)", "(None, 1, 'train', 0, 0)"]
    clean = spark.createDataFrame([(None, 1, 5.0), ("a", 1, 6.0)], "k string, timestamp int, x double")
    assert reconstruct.window_result(df, clean, ["k"]).count() == 2
    scores = spark.createDataFrame([(None, 0, 0.5), ("a", 0, 0.7)], "k string, window_index long, mse double")
    lines = spark.createDataFrame([(None, 2, 1.0), ("a", 2, 2.0)], "k string, pos long, x double")
    assert windows.align_windows(scores, lines, 3, ["k"]).count() == 2


def test_forecast_keeps_null_keys(spark):
    df = spark.range(60).select(
        F.when(F.col("id") % 2 == 0, "a").alias("k"),
        F.expr("timestamp_ntz'2024-01-01' + make_interval(0,0,0,0,0,id,0)").alias("timestamp"), F.col("id").cast("double").alias("x"),
    )
    found, status = forecast.forecast_all(df, ["x"], ForecastConfig(n_changepoints=2, fourier_order=1), keys=["k"])
    assert {r.k for r in found.collect()} == {None, "a"}
    assert sorted((str(r.k), r.status) for r in status.collect()) == [("None", "ok"), ("a", "ok")]


def test_correlations_pairwise_complete(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(1e6, 1.0, (500, 4))
    x[:, 1] += x[:, 0]
    x[:, 3] = 7.25
    hidden = rng.random(x.shape) < 0.3
    rows = [[None if h else float(v) for v, h in zip(*r)] for r in zip(x, hidden)]
    df = spark.createDataFrame(rows, "n double, column double, r double, b double").repartition(5)
    got = {(r.col_a, r.col_b): r.r for r in profile.correlations(df, df.columns).collect()}
    assert len(got) == 16
    for a, i in zip(df.columns, range(4)):
        for b, j in zip(df.columns, range(4)):
            both = ~hidden[:, i] & ~hidden[:, j]
            if 3 in (i, j):
                assert got[a, b] is None
            else:
                assert math.isclose(got[a, b], np.corrcoef(x[both, i], x[both, j])[0, 1], abs_tol=1e-9)


def test_correlations_of_nothing_and_of_nan(spark):
    empty = spark.createDataFrame([], "a double, b double")
    assert [r.r for r in profile.correlations(empty, ["a", "b"]).collect()] == [None] * 4
    odd = spark.createDataFrame([(1.0, 2.0, None), (2.0, float("nan"), 1.0), (3.0, None, 3.0)], "a double, b double, c double")
    got = {(r.col_a, r.col_b): r.r for r in profile.correlations(odd, ["a", "b", "c"]).collect()}
    assert got["a", "c"] == 1.0 and math.isnan(got["a", "b"]) and math.isnan(got["b", "c"])
