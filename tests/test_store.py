import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from helpers import frame
from vitalstream.config import (
    COLUMN_MAPPING, EnsembleConfig, ForecastConfig, ForestConfig, Settings, VITALS, WindowModelConfig,
)
from vitalstream.operators import ensemble
from vitalstream.plans import store, workflow
from vitalstream.sources.tables import materialise, path_exists, write_table

SMALL = dict(
    forest=ForestConfig(n_estimators=5), windows=WindowModelConfig(sequence_length=10, latent_dim=4),
    forecast=ForecastConfig(n_changepoints=3, fourier_order=1),
)


@pytest.fixture(scope="module")
def raw(spark, tmp_path_factory):
    rng = np.random.default_rng(4)
    names = {v: k for k, v in COLUMN_MAPPING.items()}
    pdf = pd.DataFrame({names[v]: rng.normal(100, 2, 200) for v in VITALS})
    pdf["Patient ID"] = 1
    pdf["Timestamp"] = pd.date_range("2024-03-03", periods=200, freq="1min").strftime("%Y-%m-%d %H:%M:%S")
    pdf.loc[50, "Heart Rate"] = 900.0
    path = str(tmp_path_factory.mktemp("raw"))
    write_table(frame(spark, pdf, []), path)
    return spark.read.parquet(path)


def test_a_run_cut_off_goes_on(spark, raw, tmp_path, monkeypatch):
    s, folder = Settings(**SMALL), str(tmp_path / "run")
    whole = workflow.run_all(raw, s, str(tmp_path / "whole"))

    def cut(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(workflow, "_window_result", cut)
        with pytest.raises(RuntimeError, match="lost"):
            workflow.run_all(raw, s, folder)
    steps = spark.read.parquet(f"{folder}/manifest").first()["steps"]
    assert not path_exists(spark, steps)
    # As after a kill: steps left behind, and a table without the committer's mark.
    write_table(spark.range(3), f"{steps}/left")
    write_table(spark.range(3), f"{folder}/results/lstm")
    (tmp_path / "run" / "results" / "lstm" / "_SUCCESS").unlink()
    with monkeypatch.context() as m:
        for made in ("run_preprocess", "run_features", "_forecast_result", "_forest_result"):
            m.setattr(workflow, made, cut)
        again = workflow.run_all(raw, s, folder, resume=True)
    assert not path_exists(spark, steps)
    left = again.comparison.orderBy("timestamp").toPandas()
    assert left.equals(whole.comparison.orderBy("timestamp").toPandas())
    assert again.feature_columns == whole.feature_columns and again.scaler == whole.scaler
    with pytest.raises(ValueError, match="other data or settings"):
        workflow.run_all(raw, Settings(**SMALL, ensemble=EnsembleConfig(min_votes=1)), folder, resume=True)


def test_steps_are_deleted_and_reports_stay(spark, raw, tmp_path):
    out = workflow.run_all(raw, Settings(**SMALL), str(tmp_path / "run"), store_windows=True)
    steps = spark.read.parquet(f"{tmp_path}/run/manifest").first()["steps"]
    assert not path_exists(spark, steps)
    found = {p.name for p in (tmp_path / "run").iterdir()}
    assert found == {"clean", "features", "scaler", "windows", "models", "results", "reports", "manifest"}
    assert spark.read.parquet(f"{tmp_path}/run/windows").count() == 191
    limits = {r["column"]: r["n_clipped"] for r in out.reports["limits"].collect()}
    assert limits["heart_rate"] == 1
    assert set(out.reports) == {
        "limits", "features", "rates", "kpis", "agreement", "metrics-prophet", "metrics-if", "metrics-lstm"
    }
    assert {r["model"] for r in out.reports["rates"].collect()} == {"prophet", "if", "lstm", "ensemble"}


def test_only_wanted_models_and_the_chosen_flag(spark, raw, monkeypatch):
    def never(*_):
        raise AssertionError("not wanted")

    monkeypatch.setattr(workflow, "_window_result", never)
    settings = Settings(**SMALL, ensemble=EnsembleConfig(models=("prophet", "if"), min_votes=1, forecast_flag="residual"))
    out = workflow.run_all(raw, settings)
    assert set(out.results) == {"prophet", "if"}
    flags = out.results["prophet"].select("timestamp", F.col("anomaly_residual").alias("want"))
    assert out.comparison.join(flags, "timestamp").where(~F.col("anomaly_prophet").eqNullSafe(F.col("want"))).count() == 0
    for models, flag in (((), "interval"), (("prophet", "svm"), "interval"), (("prophet",), "median")):
        with pytest.raises(ValueError):
            workflow.run_all(raw, Settings(**SMALL, ensemble=EnsembleConfig(models=models, forecast_flag=flag)))


def test_scope_deletes_only_its_own(spark, tmp_path):
    before = materialise(spark.range(4), "before")
    with pytest.raises(KeyError):
        with store.stage_scope(spark, str(tmp_path / "steps")):
            materialise(spark.range(2), "inside")
            assert list((tmp_path / "steps").iterdir())
            raise KeyError("x")
    assert not (tmp_path / "steps").exists()
    assert before.count() == 4


def test_unanimous_by_severity(spark):
    rows = [(1, 3, 0.1, 1.0), (2, 3, 0.9, None), (3, 2, 9.0, 9.0), (4, 3, 0.2, 0.9), (5, 3, 0.9, 0.0)]
    df = spark.createDataFrame(rows, "timestamp int, vote_count int, a double, b double")
    pick = lambda **how: [r["timestamp"] for r in ensemble.top_unanimous(df, 3, **how).collect()]
    assert pick() == [1, 2, 4]
    assert pick(severity=["a", "b"]) == [1, 4, 2]
