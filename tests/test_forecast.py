import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from helpers import frame, same, series
from vitalstream.config import ForecastConfig
from vitalstream.operators import forecast as FC
from vitalstream.plans.report import forecast_metrics
from vitalstream.plans.workflow import ForecastDetector


def tiny(n=200, seed=0):
    rng = np.random.default_rng(seed)
    return series(n, heart_rate=70 + 5 * np.sin(np.linspace(0, 4 * np.pi, n)) + rng.normal(0, 1, n),
                  spo2=98 + rng.normal(0, 0.5, n), patient_id=1, was_missing=0)


def mock(pdf, spike=None):
    out = pd.DataFrame({"ds": pdf["timestamp"], "y": pdf["heart_rate"]})
    out["yhat"], out["yhat_lower"], out["yhat_upper"] = out["y"], out["y"] - 5, out["y"] + 5
    if spike is not None:
        out.loc[spike, "y"] += 100
    return out


def test_prepare_renames_and_drops_nulls(spark):
    pdf = tiny()
    pdf.loc[[3, 7], "heart_rate"] = np.nan
    got = FC.prepare_target(frame(spark, pdf), "heart_rate")
    assert got.columns == ["ds", "y"] and got.count() == 198
    with pytest.raises(KeyError):
        FC.prepare_target(frame(spark, pdf), "no_such_vital")


def test_perfect_forecast_flags_nothing(spark):
    got = FC.flag_interval(frame(spark, mock(tiny()), ["ds"])).toPandas()
    assert got["anomaly"].sum() == 0 and (got["anomaly_score"] == 0).all()


def test_spike_is_flagged(spark):
    got = FC.flag_interval(frame(spark, mock(tiny(), 10), ["ds"])).orderBy("ds").toPandas()
    assert got.index[got["anomaly"] == 1].tolist() == [10]
    assert got.loc[10, "anomaly_score"] == pytest.approx(20)


def test_degenerate_interval_scores_zero(spark):
    pdf = mock(tiny(), 10)
    pdf["yhat_lower"] = pdf["yhat_upper"] = pdf["yhat"]
    got = FC.flag_interval(frame(spark, pdf, ["ds"])).orderBy("ds").toPandas()
    assert (got["anomaly_score"] == 0).all() and got.loc[10, "anomaly"] == 1


def test_residual_zscore(spark):
    pdf = mock(tiny(), 10)
    pdf["yhat"] = 70.0
    pdf["split"] = np.where(np.arange(200) < 160, "train", "test")
    flagged = FC.flag_interval(frame(spark, pdf, ["ds"]))
    res = pdf["y"] - pdf["yhat"]
    got = FC.flag_by_residual(flagged, 3.0).orderBy("ds").toPandas()
    z = (res - res.mean()) / res.std(ddof=1)
    same(got["residual_zscore"], z)
    assert (got["anomaly_residual"] == (z.abs() > 3).astype(int)).all()
    train = res[:160]
    got = FC.flag_by_residual(flagged, 3.0, "train").orderBy("ds").toPandas()
    same(got["residual_zscore"], (res - train.mean()) / train.std(ddof=1))


def test_constant_residual_is_no_anomaly(spark):
    pdf = mock(tiny())
    got = FC.flag_by_residual(FC.flag_interval(frame(spark, pdf, ["ds"])))
    assert got.agg(F.sum("anomaly_residual")).first()[0] == 0


def test_metrics(spark):
    pdf = mock(tiny(), 10)
    pdf["split"] = np.where(np.arange(200) < 160, "train", "test")
    got = {r["split"]: r for r in forecast_metrics(FC.flag_interval(frame(spark, pdf, ["ds"]))).collect()}
    assert got["train"]["mae"] == pytest.approx(100 / 160)
    assert got["train"]["rmse"] == pytest.approx(np.sqrt(10000 / 160))
    assert got["test"]["anomaly_rate"] == 0


def test_fit_recovers_trend_season_and_noise(spark):
    n = 5 * 1440
    rng = np.random.default_rng(3)
    day = np.arange(n) / 1440
    truth = 80 + 2 * day + 3 * np.sin(2 * np.pi * day)
    pdf = series(n, heart_rate=truth + rng.normal(0, 1, n))
    detector = ForecastDetector()
    got = detector.run(frame(spark, pdf)).orderBy("ds").toPandas()
    assert (got["split"] == "train").sum() == int(n * 0.8)
    train = got[got["split"] == "train"]
    assert np.abs(train["yhat"] - truth[: len(train)]).mean() < 0.15
    model = detector.model.first()
    assert model["sigma"] * model["y_scale"] == pytest.approx(1, abs=0.05)
    # An 80 % interval leaves about 20 % outside.
    assert train["anomaly"].mean() == pytest.approx(0.2, abs=0.03)
    width = got["yhat_upper"] - got["yhat_lower"]
    assert width.iloc[-1] >= width.iloc[0]


def test_gram_fit_equals_direct_solution(spark):
    """The coefficients solve the penalised normal equations of all training rows."""
    pdf = tiny(600, 4)
    rows = FC.number_series(FC.to_long(frame(spark, pdf), ["heart_rate"]), 0.8, block_rows=64)
    assert sorted(r["pos"] for r in rows.select("pos").collect()) == list(range(600))
    model = FC.fit_forecast(rows).first()
    train = pdf.iloc[:480]
    us = train["timestamp"].astype("datetime64[us]").astype("int64").to_numpy()
    part = pd.DataFrame({"us": us, "t0": model["t0"], "span": model["span"]})
    part["changepoints"] = [model["changepoints"]] * len(part)
    x = np.column_stack([FC._design(part, 25, 4), train["heart_rate"] / model["y_scale"]])
    beta, sigma = FC._map_estimate(x.T @ x, 25, 4, 0.05)
    same([model["slope"], model["intercept"], *model["deltas"], *model["season"], model["sigma"]], [*beta, sigma], 1e-6)
    want = np.round(np.linspace(0, int(480 * 0.8) - 1, 26)).astype(int)[1:]
    same(model["changepoints"], (us[want] - us[0]) / (us[-1] - us[0]), 1e-12)


def test_all_targets_in_one_job_and_failures_reported(spark):
    pdf = tiny()
    pdf["empty"] = np.nan
    pdf["single"] = np.nan
    pdf.loc[0, "single"] = 1.0
    result, status = FC.forecast_all(frame(spark, pdf), ["heart_rate", "spo2", "empty", "single", "absent"])
    got = {r["series"]: r["status"] for r in status.collect()}
    assert got["heart_rate"] == got["spo2"] == "ok"
    assert all(got[c].startswith("failed") for c in ("empty", "single", "absent"))
    counts = {r["series"]: r["count"] for r in result.groupBy("series").count().collect()}
    assert counts == {"heart_rate": 200, "spo2": 200}


def test_saved_model_gives_the_same_forecast(spark, tmp_path):
    df = frame(spark, tiny())
    detector = ForecastDetector().fit(df)
    detector.save(str(tmp_path / "m"))
    again = ForecastDetector().load(spark, str(tmp_path / "m"))
    a, b = (d.score(df).orderBy("ds").toPandas() for d in (detector, again))
    assert a.equals(b)
    with pytest.raises(RuntimeError):
        ForecastDetector().score(df)
    with pytest.raises(FileNotFoundError):
        ForecastDetector().load(spark, str(tmp_path / "absent"))


def test_external_forecast_is_left_joined(spark):
    pdf = mock(tiny())
    actuals = frame(spark, pdf[["ds", "y"]], ["ds"])
    partial = frame(spark, pdf.drop(columns="y").iloc[:50], ["ds"])
    got = FC.flag_interval(FC.merge_forecast(actuals, partial)).toPandas()
    assert len(got) == 200 and got["yhat"].notna().sum() == 50 and got["anomaly"].sum() == 0


def test_changepoint_prior_limits_flexibility(spark):
    df = frame(spark, tiny(1000, 8))
    stiff, loose = (
        FC.fit_forecast(FC.number_series(FC.to_long(df, ["heart_rate"]), 0.8), ForecastConfig(changepoint_prior_scale=s)).first()
        for s in (0.001, 0.5)
    )
    assert np.abs(stiff["deltas"]).sum() < np.abs(loose["deltas"]).sum()
