import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from helpers import frame
from vitalstream.config import COLUMN_MAPPING, ForestConfig, SeriesConfig, Settings, VITALS, WindowModelConfig
from vitalstream.operators import forecast, forest, reconstruct
from vitalstream.operators.features import build_features
from vitalstream.plans import workflow
from vitalstream.sources.tables import load_results


@pytest.fixture(scope="module")
def raw(spark):
    rng = np.random.default_rng(9)
    n = 600
    centers = dict(zip(VITALS, (70, 98, 16, 37, 120, 80)))
    names = {v: k for k, v in COLUMN_MAPPING.items()}
    pdf = pd.DataFrame({names[v]: rng.normal(c, c / 500, n) for v, c in centers.items()})
    pdf["Patient ID"] = np.arange(n)
    pdf["Timestamp"] = pd.date_range("2024-03-03 00:14", periods=n, freq="1min").strftime("%Y-%m-%d %H:%M:%S")
    pdf.loc[300, "Heart Rate"] = 400.0
    return frame(spark, pdf.sample(frac=1, random_state=0), [])


def test_whole_run(spark, raw, tmp_path):
    s = Settings(forest=ForestConfig(n_estimators=20), windows=WindowModelConfig(sequence_length=20, latent_dim=8))
    out = workflow.run_all(raw, s, str(tmp_path))
    assert out.clean.count() == 600
    assert out.clean.where("was_missing = 1").count() == 1
    assert out.clean.where(F.col("heart_rate") > 250).count() == 0
    assert len(out.feature_columns) == 62
    assert [r[0] for r in out.clean.select("patient_id").distinct().collect()] == [1]
    comparison = out.comparison.toPandas()
    assert len(comparison) == 600 - 19
    assert {"anomaly_prophet", "anomaly_if", "anomaly_lstm", "vote_count", "anomaly_ensemble"} <= set(comparison.columns)
    paths = {m: f"{tmp_path}/results/{m}" for m in ("prophet", "if", "lstm")}
    again = workflow.run_ensemble(load_results(spark, paths), s)
    assert again.orderBy("timestamp").toPandas().equals(comparison.sort_values("timestamp").reset_index(drop=True))
    trees = workflow.ForestDetector().load(spark, f"{tmp_path}/models/forest")
    assert trees.infer(spark.read.parquet(f"{tmp_path}/features"), ["timestamp"]).count() == 600


def test_no_rows(spark, raw):
    with pytest.raises((RuntimeError, ValueError)):
        workflow.run_features(workflow.run_preprocess(raw.limit(0)))


def test_drop_policy_closes_positions(spark):
    pdf = pd.DataFrame({"timestamp": pd.date_range("2024-01-01", periods=30, freq="1min"), "a": np.arange(30.0)})
    pdf.loc[[4, 5, 20], "a"] = np.nan
    pdf["pos"] = np.arange(30)
    made, _ = build_features(frame(spark, pdf), ["a"], [3], [1], null_policy="drop")
    assert sorted(r["pos"] for r in made.select("pos").collect()) == list(range(27))


def test_keyed_run_equals_single_runs(spark):
    """Two patients in one run: the stages without chance give each what a run of its own gives."""
    rng = np.random.default_rng(3)
    names = {v: k for k, v in COLUMN_MAPPING.items()}
    parts = []
    for patient, n in ((7, 300), (8, 400)):
        pdf = pd.DataFrame({names[v]: rng.normal(100, 5, n) for v in VITALS})
        pdf["Patient ID"] = patient
        pdf["Timestamp"] = pd.date_range("2024-03-03", periods=n, freq="1min").strftime("%Y-%m-%d %H:%M:%S")
        parts.append(pdf)
    small = dict(forest=ForestConfig(n_estimators=10), windows=WindowModelConfig(sequence_length=10, latent_dim=4))
    keyed = Settings(series=SeriesConfig(keys=("patient_id",)), **small)
    both = workflow.run_all(frame(spark, pd.concat(parts), []), keyed)
    assert both.comparison.count() == 300 + 400 - 2 * 9
    assert both.results["if"].columns.count("patient_id") == 1
    for part in parts:
        patient = int(part["Patient ID"].iloc[0])
        alone = workflow.run_preprocess(frame(spark, part, []), keyed).orderBy("pos").toPandas()
        mine = both.clean.where(F.col("patient_id") == patient).orderBy("pos").toPandas()
        pd.testing.assert_frame_equal(alone[mine.columns], mine)
        single = workflow.ForecastDetector(series=keyed.series).run(workflow.run_preprocess(frame(spark, part, []), keyed))
        got = both.results["prophet"].where(F.col("patient_id") == patient).orderBy("timestamp").toPandas()
        np.testing.assert_allclose(got["yhat"], single.orderBy("ds").toPandas()["yhat"], rtol=1e-6)


def test_carried_ids_are_kept_bit_by_bit(spark):
    """Nullable 64-bit ids above 2^53 pass through scoring as they are; a row without a feature has no score."""
    ids = [None if i % 7 == 0 else (1 << 53) + 2 * i + 1 for i in range(200)]
    rows = [(i, big, float(i % 13), None if i == 5 else float(i % 5)) for i, big in enumerate(ids)]
    df = spark.createDataFrame(rows, "pos long, id long, a double, b double")
    model = forest.fit_forest(df.na.fill(0.0), ["a", "b"], ["pos"], ForestConfig(n_estimators=5))
    scored = forest.score_rows(model, df, ["pos", "id"]).orderBy("pos").collect()
    assert [r["id"] for r in scored] == ids
    assert [r["pos"] for r in scored if r["raw_score"] is None] == [5]
    errors = reconstruct.score_windows(df.na.fill(0.0, ["a", "b"]), ["a", "b"], 10, np.zeros_like, block_rows=32, carry=["id"])
    assert [r["id"] for r in errors.orderBy("pos").collect()] == ids[9:]


def test_times_that_repeat_are_refused(spark):
    pdf = pd.DataFrame({"ds": list(pd.date_range("2024-01-01", periods=20, freq="1min")) * 2, "y": 1.0, "series": "a"})
    with pytest.raises(Exception, match="a time repeats within a series"):
        forecast.number_series(frame(spark, pdf, ["ds"]), 0.8).collect()


def test_a_stray_early_time_leaves_blocks_small(spark):
    times = [pd.Timestamp("1990-01-01"), *pd.date_range("2024-01-01", periods=5000, freq="1s")]
    df = frame(spark, pd.DataFrame({"ds": times, "y": 1.0, "series": "a"}), ["ds"])
    slots = forecast._slots_of_time(df.withColumn("__us", F.unix_micros(F.col("ds").cast("timestamp"))), ["series"], 256)
    blocks = slots.groupBy(F.floor(F.col("__tick") / 256)).count()
    assert blocks.agg(F.max("count")).first()[0] <= 512
    numbered = forecast.number_series(df, 0.8, block_rows=256).orderBy("ds").collect()
    assert [r["pos"] for r in numbered] == list(range(5001))
