import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from helpers import frame, same, series
from vitalstream.config import ForestConfig, SeriesConfig
from vitalstream.operators import forest as FO
from vitalstream.plans.workflow import ForestDetector
from vitalstream.streaming.score import start_scoring

VITALS = ["heart_rate", "spo2", "resp_rate", "temperature", "systolic_bp", "diastolic_bp"]
CFG = ForestConfig(n_estimators=20)


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(42)
    n = 1000
    centers = [70, 98, 16, 37, 120, 80]
    pdf = series(n, **{v: rng.normal(c, c / 20, n) for v, c in zip(VITALS, centers)}, was_missing=0)
    pdf.loc[500, VITALS] = [190.0, 60.0, 50.0, 41.5, 210.0, 130.0]
    pdf["pos"] = np.arange(n)
    return pdf, frame(spark, pdf).cache()


@pytest.fixture(scope="module")
def run(data):
    pdf, df = data
    detector = ForestDetector(CFG, SeriesConfig(vitals=tuple(VITALS)))
    return detector, detector.run(df, VITALS, df).orderBy("pos").toPandas()


def test_flags_scores_and_split(data, run):
    _, got = run
    assert len(got) == 1000
    assert set(got["anomaly_if"]) <= {-1, 1}
    assert ((got["anomaly_if"] == -1).astype(int) == got["anomaly"]).all()
    assert got["anomaly_score"].between(0, 1).all()
    assert got["anomaly_score"].min() == 0 and got["anomaly_score"].max() == pytest.approx(1, abs=1e-6)
    assert (got["split"][:800] == "train").all() and (got["split"][800:] == "test").all()
    same(got["heart_rate"], data[0]["heart_rate"])


def test_train_rate_is_the_contamination(run):
    train = run[1][:800]
    assert train["anomaly"].mean() == pytest.approx(0.05, abs=0.02)


def test_outlier_scores_highest(run):
    assert run[1]["anomaly_score"].idxmax() == 500


def test_every_tree_has_256_rows_and_consistent_nodes(run):
    nodes = run[0].model.nodes.toPandas()
    roots = nodes[nodes["slot"] == 0]
    assert len(roots) == 20 and (roots["n"] == 256).all()
    assert nodes["depth"].max() <= 8
    leaves = nodes[nodes["feature"] < 0]
    assert (leaves.groupby("tree")["n"].sum() == 256).all()


def test_scores_equal_a_plain_walk(data, run):
    pdf, _ = data
    model = run[0].model
    nodes = {(r.tree, r.slot): r for r in model.nodes.toPandas().itertuples()}
    x = pdf[VITALS].to_numpy()
    want = []
    for row in x[:60]:
        depths = []
        for tree in range(20):
            slot = 0
            while nodes[tree, slot].feature >= 0:
                node = nodes[tree, slot]
                slot = 2 * slot + (2 if row[node.feature] > node.threshold else 1)
            depths.append(nodes[tree, slot].path)
        want.append(2 ** (-np.mean(depths) / FO.path_correction(256)))
    scored = run[0].scored.orderBy("pos").toPandas()["raw_score"]
    same(scored[:60], want)


def test_result_does_not_depend_on_partitioning(spark, data):
    _, df = data
    a = FO.fit_forest(df.repartition(7), VITALS, ["pos"], CFG).nodes.toPandas()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        b = FO.fit_forest(df.coalesce(1), VITALS, ["pos"], CFG).nodes.toPandas()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    key = ["tree", "slot"]
    assert a.sort_values(key).reset_index(drop=True).equals(b.sort_values(key).reset_index(drop=True))


def test_sampling_of_a_large_table(spark):
    """Far more rows than the trees want: every tree still gets a full sample."""
    rows = spark.range(400_000).withColumn("x", F.rand(1))
    offered = FO.sample_for_trees(rows, ["id"], 400_000, 30, 256, 42)
    sizes = offered.groupBy("tree").count().toPandas()["count"]
    assert len(sizes) == 30 and sizes.min() >= 256 and sizes.max() < 800


def test_few_rows(spark):
    pdf = series(10, a=np.arange(10.0))
    pdf["pos"] = np.arange(10)
    model = FO.fit_forest(frame(spark, pdf), ["a"], ["pos"], CFG)
    assert model.max_samples == 10
    assert (model.nodes.where("slot = 0").toPandas()["n"] == 10).all()
    with pytest.raises(ValueError):
        FO.fit_forest(frame(spark, pdf).where("a < 0"), ["a"], ["pos"], CFG)


def test_constant_column_is_never_cut(spark):
    pdf = pd.DataFrame({"pos": np.arange(50), "a": np.ones(50), "b": np.arange(50.0)})
    nodes = FO.fit_forest(spark.createDataFrame(pdf), ["a", "b"], ["pos"], CFG).nodes
    assert nodes.where("feature = 0").count() == 0


def test_reload_and_inference(spark, data, run, tmp_path):
    _, df = data
    detector, _ = run
    detector.save(str(tmp_path / "f"))
    again = ForestDetector(CFG, SeriesConfig(vitals=tuple(VITALS))).load(spark, str(tmp_path / "f"))
    a, b = (d.infer(df, ["pos"]).orderBy("pos").toPandas() for d in (detector, again))
    assert a.equals(b)
    one = again.infer(df.where("pos = 500"), ["pos"]).first()
    assert one["anomaly_score"] == a.loc[500, "anomaly_score"] and one["anomaly"] == 1
    batch = again.infer(df.where("pos = 500"), ["pos"], "batch").first()
    assert batch["anomaly_score"] == 0
    with pytest.raises(RuntimeError):
        ForestDetector().infer(df, ["pos"])
    with pytest.raises(FileNotFoundError):
        ForestDetector().load(spark, str(tmp_path / "absent"))


def test_stream_equals_batch(spark, data, run, tmp_path):
    _, df = data
    model = run[0].model
    src = str(tmp_path / "in")
    df.select("pos", "timestamp", *VITALS).repartition(4).write.parquet(src)
    stream = spark.readStream.schema(spark.read.parquet(src).schema).option("maxFilesPerTrigger", 1).parquet(src)
    start_scoring(model, stream, ["pos", "timestamp"], str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("pos").toPandas()
    want = FO.flag_scores(model, FO.score_rows(model, df, ["pos", "timestamp"]), "model").orderBy("pos").toPandas()
    assert got[want.columns].equals(want)


def test_contamination_sweep(spark):
    pdf = pd.DataFrame({"anomaly_score": np.arange(1000) / 1000})
    got = FO.contamination_sweep(spark.createDataFrame(pdf), [0.01, 0.1]).orderBy("contamination").toPandas()
    for (_, row), c in zip(got.iterrows(), (0.01, 0.1)):
        cut = pdf["anomaly_score"].quantile(1 - c)
        assert row["threshold"] == pytest.approx(cut)
        assert row["n_flagged"] == (pdf["anomaly_score"] >= cut).sum()


@pytest.mark.parametrize("width, size", [(1, 256), (4, 256), (6, 100), (4, 2)])
def test_grids_equal_a_walk(width, size):
    """Look-ups of four levels at once: the very sums of a walk level by level."""
    rng = np.random.default_rng(width)
    x = np.round(rng.normal(size=(3000, width)), 1)
    depth = max(1, int(np.ceil(np.log2(size))))
    nodes = pd.concat([FO._grow_tree(x[rng.choice(3000, size, False)], t, depth, 3) for t in range(7)])
    arrays = FO._forest_arrays(nodes, depth)
    found = FO._scorer(*arrays, depth, width)
    assert isinstance(found, FO.GriddedTrees)
    odd = np.concatenate([x, np.full((1, width), np.inf), np.full((1, width), -np.inf), nodes["threshold"].dropna().to_numpy()[:5, None].repeat(width, 1)])
    assert (found.sums(odd) == FO.WalkedTrees(*arrays, depth).sums(odd)).all()


@pytest.mark.parametrize("width, size", [(30, 256), (3, 2000)])
def test_many_features_and_deep_trees_are_walked(width, size):
    rng = np.random.default_rng(5)
    x, depth = rng.normal(size=(2000, width)), int(np.ceil(np.log2(size)))
    nodes = FO._grow_tree(x[:size], 0, depth, 3)
    assert isinstance(FO._scorer(*FO._forest_arrays(nodes, depth), depth, width), FO.WalkedTrees)
