import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from helpers import frame, same, series
from vitalstream.operators import features as FT
from vitalstream.operators import scaling as SC
from vitalstream.operators.blocks import number_rows, with_halo
from vitalstream.operators.split import filter_split, label_split, label_window_split, split_frames
from vitalstream.operators.windows import build_windows, load_windows, save_windows


def table(n=500, seed=0):
    rng = np.random.default_rng(seed)
    pdf = series(n, a=rng.normal(50, 10, n), b=np.full(n, 7.25))
    pdf.loc[rng.random(n) < 0.2, "a"] = np.nan
    pdf.loc[100:180, "a"] = np.nan
    pdf["pos"] = np.arange(n)
    return pdf


@pytest.mark.parametrize("block_rows", [64, 256, 4096])
def test_window_features_equal_pandas(spark, block_rows):
    pdf = table()
    got = FT.add_window_features(frame(spark, pdf), ["a", "b"], [5, 15, 60], [1, 5, 15], (), block_rows)
    got = got.orderBy("pos").toPandas()
    assert len(got) == len(pdf)
    for c in ("a", "b"):
        for w in (5, 15, 60):
            roll = pdf[c].rolling(w, min_periods=1)
            same(got[f"{c}_roll_mean_{w}"], roll.mean(), 1e-9)
            same(got[f"{c}_roll_std_{w}"], roll.std().fillna(0), 1e-6)
        for k in (1, 5, 15):
            same(got[f"{c}_lag_{k}"], pdf[c].shift(k))


@pytest.mark.parametrize("block_rows", [128, 4096])
def test_deviation_beside_an_outlier(spark, block_rows):
    pdf = table()
    pdf["b"] = 70.0 + np.arange(len(pdf)) % 2
    for c in ("a", "b"):
        pdf.loc[pdf["pos"] % 150 == 3, c] = 1e12
    got = FT.add_window_features(frame(spark, pdf), ["a", "b"], [5, 15, 60], block_rows=block_rows).orderBy("pos").toPandas()
    for c in ("a", "b"):
        x = pdf[c].to_numpy()
        for w in (5, 15, 60):
            parts = [x[max(0, k - w + 1): k + 1] for k in range(len(x))]
            parts = [p[~np.isnan(p)] for p in parts]
            want = np.array([p.std(ddof=1) if len(p) > 1 else 0.0 for p in parts])
            assert np.allclose(got[f"{c}_roll_std_{w}"], want, rtol=1e-9, atol=1e-9)


def test_missing_features_are_null_not_nan(spark):
    out = FT.add_window_features(frame(spark, table()), ["a"], [5], [1])
    assert out.where(F.isnan("a") | F.isnan("a_lag_1") | F.isnan("a_roll_mean_5")).count() == 0
    assert out.where(F.col("a_lag_1").isNull()).count() > 0


def test_halo_larger_than_block_is_refused(spark):
    with pytest.raises(ValueError):
        with_halo(spark.range(3).withColumnRenamed("id", "pos"), 64, 64)


def test_one_shuffle_for_all_frames(spark):
    df = frame(spark, table())
    out = FT.add_window_features(df, ["a", "b"], [5, 15], [1])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    physical = out._jdf.queryExecution().executedPlan().toString()
    # Two windows per frame length, one for what lies before a chunk and all lags; sorts stay inside a partition.
    assert plan.count("Window [") == 2 * 2 + 1
    assert physical.count("Exchange hashpartitioning") == 1
    assert physical.count("Sort [") == 2 * 2 + 1


@pytest.mark.parametrize("size,fanout", [(4, 2), (64, 4), (4096, 4096)])
def test_dense_positions(spark, size, fanout):
    ids = np.unique(np.random.default_rng(1).integers(0, 5000, 700))
    df = spark.createDataFrame(pd.DataFrame({"t": ids, "k": ids % 3 == 0}))
    got = number_rows(df, ["k"], "t", size, fanout=fanout).toPandas()
    for _, part in got.groupby("k"):
        assert list(part.sort_values("t")["pos"]) == list(range(len(part)))


def test_feature_columns_and_fill(spark):
    pdf = series(4, a=[1.0, np.nan, 3.0, np.nan], patient_id=[1] * 4, was_missing=[0] * 4)
    df = frame(spark, pdf).withColumn("flag", F.lit(True)).withColumn("name", F.lit("x"))
    assert FT.feature_columns(df) == ["a", "flag"]
    assert FT.null_total(df, ["a"]).first()[0] == 2
    assert FT.fill_features(df, ["a"], ["a"]).count() == 4
    assert FT.fill_features(df, ["a"], ["a"], "drop").count() == 2
    with pytest.raises(ValueError):
        FT.fill_features(df, ["a"], ["a"], "guess")


def test_full_feature_table_has_62_columns(spark):
    n = 130
    rng = np.random.default_rng(2)
    vitals = ["heart_rate", "spo2", "resp_rate", "temperature", "systolic_bp", "diastolic_bp"]
    pdf = series(n, **{v: rng.normal(size=n) for v in vitals}, patient_id=1, was_missing=0)
    pdf["pos"] = np.arange(n)
    made, cols = FT.build_features(frame(spark, pdf), vitals)
    assert len(cols) == 62
    assert made.dropna("any", subset=cols).count() == n


def test_sanity_report(spark):
    pdf = pd.DataFrame({"a_roll_std_5": [0.0, 0.0, 0.0], "a_lag_1": [0.0, 1.0, 1.0]})
    rows = {(r["check"], r["column"]): r for r in FT.sanity_report(spark.createDataFrame(pdf), list(pdf)).collect()}
    assert not rows["roll_std_variance", "a_roll_std_5"]["ok"]
    assert not rows["lag_nonzero_rate", "all"]["ok"]
    assert rows["null_count", "all"]["ok"]


def test_time_of_day(spark):
    pdf = series(3, freq="361min")
    got = FT.add_time_features(frame(spark, pdf)).orderBy("timestamp").toPandas()
    minute = np.array([0, 361, 722])
    same(got["sin_time"], np.sin(2 * np.pi * minute / 1440))
    same(got["cos_time"], np.cos(2 * np.pi * minute / 1440))


def test_scalers(spark, tmp_path):
    pdf = pd.DataFrame({"a": [1.0, 2.0, 4.0], "c": [5.0, 5.0, 5.0]})
    df = spark.createDataFrame(pdf)
    scaled, rows = SC.scale_features(df, ["a", "c"], save_path=str(tmp_path / "s"))
    got = scaled.orderBy("a").toPandas()
    same(got["a"], (pdf["a"] - pdf["a"].mean()) / pdf["a"].std(ddof=0))
    same(got["c"], [0, 0, 0])
    again = SC.apply_scaler(df, SC.load_scaler(spark, str(tmp_path / "s"))).orderBy("a").toPandas()
    assert (again == got).all().all()
    same(SC.scale_features(df, ["a", "c"], "minmax")[0].orderBy("a").toPandas()["a"], [0, 1 / 3, 1])
    fit_part = SC.fit_scaler(df, ["a"], fit_where=F.col("a") < 3)
    assert fit_part[0]["center"] == 1.5


def test_scaler_guards(spark):
    df = spark.createDataFrame(pd.DataFrame({"a": [1.0, 2.0]}))
    with pytest.raises(ValueError):
        SC.fit_scaler(df, [])
    with pytest.raises(ValueError):
        SC.fit_scaler(df.where("a > 5"), ["a"])
    with pytest.raises(ValueError):
        SC.fit_scaler(df.withColumn("a", F.when(F.col("a") > 1, F.col("a"))), ["a"])
    with pytest.raises(ValueError):
        SC.fit_scaler(df, ["a"], "robust")


@pytest.mark.parametrize("frac,n_train", [(0.8, 7), (1.0, 9), (0.0, 0), (0.5, 4)])
def test_split_sizes(spark, frac, n_train):
    df = spark.range(9).withColumnRenamed("id", "pos")
    train, test = split_frames(df, frac)
    assert train.count() == n_train and test.count() == 9 - n_train
    labelled = label_split(df, frac)
    assert filter_split(labelled, "Train").count() == n_train
    assert filter_split(labelled, "All").count() == 9


def test_window_split_counts_windows(spark):
    rows = spark.range(200_020).withColumnRenamed("id", "pos").where("pos >= 59")
    first_test = label_window_split(rows, 0.8, 60).where("split = 'test'").agg(F.min("pos")).first()[0]
    assert first_test == 159_968 + 59


@pytest.mark.parametrize("block_rows", [8, 4096])
def test_windows(spark, tmp_path, block_rows):
    pdf = series(40, a=np.arange(40.0), b=np.arange(40.0) * 2)
    pdf.loc[10, "a"] = np.nan
    pdf["pos"] = np.arange(40)
    made = build_windows(frame(spark, pdf), ["a", "b"], 5, block_rows=block_rows)
    save_windows(made, str(tmp_path / "w"))
    got = load_windows(spark, str(tmp_path / "w")).orderBy("pos").collect()
    assert [r["pos"] for r in got] == list(range(4, 40))
    assert got[0]["seq"] == [[float(i), 2.0 * i] for i in range(5)]
    assert got[6]["seq"][4][0] is None and len(got[6]["seq"]) == 5
    with pytest.raises(ValueError):
        build_windows(frame(spark, pdf), ["a"], 41)
