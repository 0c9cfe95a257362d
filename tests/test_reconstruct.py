import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from helpers import frame, same, series
from vitalstream.config import SeriesConfig, WindowModelConfig
from vitalstream.operators import reconstruct as RC
from vitalstream.plans.workflow import WindowDetector

COLS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(0)
    n = 210
    pdf = series(n, **{c: np.sin(np.arange(n) / (3 + i)) + rng.normal(0, 0.3, n) for i, c in enumerate(COLS)})
    pdf["pos"] = np.arange(n)
    pdf["was_missing"] = 0
    return pdf, frame(spark, pdf).cache()


def views(pdf, length):
    x = pdf[COLS].to_numpy()
    return np.stack([x[i:i + length] for i in range(len(x) - length + 1)])


@pytest.mark.parametrize("block_rows", [16, 64, 4096])
def test_identities(table, block_rows):
    _, df = table
    same_back = RC.score_windows(df, COLS, 10, lambda w: w, block_rows=block_rows).toPandas()
    assert len(same_back) == 201 and (same_back["mse"] == 0).all()
    assert sorted(same_back["pos"]) == list(range(9, 210))
    ones = df.select("pos", *[F.lit(1.0).alias(c) for c in COLS])
    zero = RC.score_windows(ones, COLS, 10, lambda w: w * 0, block_rows=block_rows).toPandas()
    assert (zero["mse"] == 1).all()


@pytest.mark.parametrize("block_rows", [16, 4096])
def test_fit_equals_principal_components_of_the_windows(table, block_rows):
    pdf, df = table
    cfg = WindowModelConfig(sequence_length=10, latent_dim=4)
    model = RC.fit_windows(df, COLS, cfg, block_rows=block_rows)
    w = views(pdf, 10)
    flat = w.reshape(len(w), -1)
    train = flat[: int(len(flat) * 0.8)]
    same(model.mean, train.mean(axis=0))
    values, vectors = np.linalg.eigh(np.cov(train.T, ddof=0))
    top = vectors[:, ::-1][:, :4]
    same(np.abs(np.sum(model.components * top.T, axis=1)), np.ones(4), 1e-6)
    scores = RC.score_windows(df, COLS, 10, model.reconstruct, block_rows=block_rows).orderBy("pos").toPandas()
    centred = flat - train.mean(axis=0)
    same(scores["mse"], ((centred - centred @ top @ top.T) ** 2).mean(axis=1), 1e-8)
    # Mean error on the training windows is what the dropped components carry.
    same(scores["mse"][: len(train)].mean(), values[:-4].sum() / 30, 1e-8)


def test_full_rank_reconstructs_exactly(table):
    _, df = table
    model = RC.fit_windows(df, COLS, WindowModelConfig(sequence_length=2, latent_dim=99))
    assert RC.score_windows(df, COLS, 2, model.reconstruct).agg(F.max("mse")).first()[0] < 1e-20


def test_short_series(table):
    _, df = table
    with pytest.raises(ValueError):
        RC.fit_windows(df.where("pos < 5"), COLS, WindowModelConfig(sequence_length=10))
    with pytest.raises(ValueError):
        RC.score_windows(df.where("pos < 5"), COLS, 10, lambda w: w)


def test_windows_do_not_cross_keys(spark, table):
    pdf, df = table
    both = df.withColumn("k", F.lit(1)).unionByName(df.withColumn("k", F.lit(2)).withColumns({c: F.col(c) * 2 for c in COLS}))
    got = RC.score_windows(both, COLS, 10, lambda w: w * 0, ["k"], 32).groupBy("k").agg(F.count("*"), F.avg("mse")).orderBy("k").collect()
    assert [r[1] for r in got] == [201, 201]
    assert got[1][2] == pytest.approx(4 * got[0][2])


def test_threshold_formula(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 2, 3, 4, 5)], "mse double")
    x = np.arange(1, 6)
    assert RC.score_threshold(df, 3.0).first()["threshold"] == pytest.approx(x.mean() + 3 * x.std())
    assert RC.score_threshold(df, 3.0, ddof=1).first()["threshold"] == pytest.approx(x.mean() + 3 * x.std(ddof=1))


def test_threshold_ignores_test_rows(spark):
    rows = [(i, 1.0 + (i % 2)) for i in range(80)] + [(i, 1000.0) for i in range(80, 100)]
    df = spark.createDataFrame([(p + 9, m) for p, m in rows], "pos long, mse double")
    got = RC.flag_windows(df, 3.0, 10, 0.8).orderBy("pos").toPandas()
    assert got["threshold"].iloc[0] == pytest.approx(1.5 + 3 * 0.5)
    assert got["anomaly"].tolist() == [0] * 80 + [1] * 20
    assert got["split"].tolist() == ["train"] * 80 + ["test"] * 20


def test_sweep_equals_rethreshold(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(rng.exponential(size=300))], "pos long, mse double")
    flagged = RC.flag_windows(df, 3.0, 1, 0.8)
    for row in RC.threshold_sweep(flagged, [1.5, 2.0, 3.0]).collect():
        again = RC.rethreshold(flagged, row["multiplier"]).agg(F.sum("anomaly"), F.max("threshold")).first()
        assert row["n_flagged"] == again[0] and row["threshold"] == pytest.approx(again[1])
        assert row["rate"] == pytest.approx(again[0] / 300)


def test_detector_reload_and_custom_network(spark, table, tmp_path):
    _, df = table
    cfg = WindowModelConfig(sequence_length=10, latent_dim=4)
    series_cfg = SeriesConfig(vitals=tuple(COLS))
    detector = WindowDetector(cfg, series_cfg)
    got = detector.run(df, df).orderBy("pos").toPandas()
    assert len(got) == 201 and {"mse", "threshold", "anomaly", "split", *COLS} <= set(got.columns)
    detector.save(spark, str(tmp_path / "m"))
    again = WindowDetector(cfg, series_cfg).load(spark, str(tmp_path / "m"))
    assert again.score(df, df).orderBy("pos").toPandas().equals(got)
    network = WindowDetector(cfg, series_cfg, custom=lambda w: w)
    assert network.score(df, df).agg(F.max("mse")).first()[0] == 0
    with pytest.raises(RuntimeError):
        WindowDetector(cfg, series_cfg).score(df, df)
    with pytest.raises(FileNotFoundError):
        WindowDetector(cfg, series_cfg).load(spark, str(tmp_path / "absent"))


def test_sketch_finds_the_exact_subspace(spark):
    rng = np.random.default_rng(8)
    t = np.arange(3000)
    x = np.column_stack([np.sin(t / 9) * 3 + 5, np.cos(t / 4) * 2, np.sin(t / 9 + 1) + np.sin(t / 21)]) + rng.normal(0, 0.05, (3000, 3))
    df = spark.createDataFrame(pd.DataFrame(x, columns=["a", "b", "c"]).assign(pos=t, k=np.where(t < 1700, "x", "y")))
    df = df.withColumn("pos", F.when(F.col("k") == "y", F.col("pos") - 1700).otherwise(F.col("pos")))
    how = dict(sequence_length=8, latent_dim=6)
    exact = RC.fit_windows(df, ["a", "b", "c"], WindowModelConfig(**how), ["k"], 256)
    sketch = RC.fit_windows(df, ["a", "b", "c"], WindowModelConfig(**how, solver="sketch", oversample=4), ["k"], 256)
    assert np.allclose(exact.mean, sketch.mean, rtol=0, atol=1e-9)
    apart = exact.components.T @ exact.components - sketch.components.T @ sketch.components
    assert np.linalg.norm(apart, 2) < 1e-6
    assert sketch.components.shape == (6, 24)
    with pytest.raises(ValueError):
        RC.fit_windows(df, ["a"], WindowModelConfig(**how, solver="other"), ["k"])


def test_a_sketch_hands_on_few_numbers(spark, monkeypatch):
    counts = []
    summed = RC._summed
    monkeypatch.setattr(RC, "_summed", lambda *a: counts.append(a[-1]) or summed(*a))
    rng = np.random.default_rng(9)
    names = [f"c{i}" for i in range(62)]
    df = spark.createDataFrame(pd.DataFrame(rng.normal(0, 1, (200, 62)), columns=names).assign(pos=np.arange(200)))
    cfg = WindowModelConfig(sequence_length=60, latent_dim=32, solver="sketch", max_passes=2)
    model = RC.fit_windows(df, names, cfg)
    assert model.components.shape == (32, 3720)
    # 3,720 x 43 and a count, where the exact way hands on 3,721 squared.
    assert counts == [3720 * 42 + 3720 + 1] * 2
