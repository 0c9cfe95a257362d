import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from helpers import frame, same, series
from vitalstream.functions.flags import label
from vitalstream.functions.quantiles import exact_quantiles
from vitalstream.operators import ensemble as EN
from vitalstream.plans import profile as PR
from vitalstream.plans import report as RP
from vitalstream.sources.tables import load_results, read_table, write_table


@pytest.fixture(scope="module")
def skewed(spark):
    """Heavy tail, a value that holds a third of all rows, nulls and two groups."""
    rng = np.random.default_rng(0)
    v = np.concatenate([rng.lognormal(0, 4, 6000), np.full(3000, 2.5)])
    v[rng.random(9000) < 0.01] = np.nan
    pdf = pd.DataFrame({"v": v, "g": rng.random(9000) < 0.1})
    return pdf, frame(spark, pdf).cache()


@pytest.mark.parametrize("exact_rows", [10**6, 500, 10])
def test_quantiles_equal_numpy(skewed, exact_rows):
    pdf, df = skewed
    probs = [0.0, 0.01, 0.25, 0.5, 0.75, 0.95, 0.999, 1.0]
    got = exact_quantiles(df, "v", probs, exact_rows=exact_rows).orderBy("prob").toPandas()
    same(got["value"], np.nanquantile(pdf["v"], probs), 1e-12)
    by = exact_quantiles(df, "v", [0.5, 0.9], ["g"], exact_rows=exact_rows).orderBy("g", "prob").toPandas()
    want = [np.nanquantile(pdf.loc[pdf["g"] == g, "v"], p) for g in (False, True) for p in (0.5, 0.9)]
    same(by["value"], want, 1e-12)


def test_quantiles_of_one_value(spark):
    df = spark.createDataFrame([(3.0,)] * 50, "v double")
    assert [r["value"] for r in exact_quantiles(df, "v", [0.1, 0.9], exact_rows=10).collect()] == [3.0, 3.0]


@pytest.mark.parametrize("bins", [7, 50])
def test_histogram_equals_numpy(spark, bins):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"v": np.concatenate([rng.integers(0, 50, 2000) / 10, rng.normal(size=500)]), "f": rng.integers(0, 2, 2500)})
    df = spark.createDataFrame(pdf)
    got = PR.histogram(df, "v", bins).orderBy("bin").toPandas()
    n, edges = np.histogram(pdf["v"], bins)
    assert got["n"].tolist() == n.tolist()
    same(got["left"], edges[:-1])
    same(got["density"], np.histogram(pdf["v"], bins, density=True)[0])
    per_flag = PR.histogram(df, "v", bins, ["f"]).orderBy("f", "bin").toPandas()
    for f in (0, 1):
        assert per_flag[per_flag["f"] == f]["n"].tolist() == np.histogram(pdf.loc[pdf["f"] == f, "v"], bins)[0].tolist()


def test_histogram_of_a_constant(spark):
    got = PR.histogram(spark.createDataFrame([(2.0,)] * 5, "v double"), "v", 4).orderBy("bin").toPandas()
    n, edges = np.histogram([2.0] * 5, 4)
    assert got["n"].tolist() == n.tolist()
    same(got["right"], edges[1:])


def test_correlation_equals_pandas(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame(rng.normal(size=(300, 3)), columns=list("abc"))
    pdf.loc[rng.random(300) < 0.3, "b"] = np.nan
    got = PR.correlations(frame(spark, pdf), list("abc")).toPandas()
    want = pdf.corr()
    for r in got.itertuples():
        assert r.r == pytest.approx(want.loc[r.col_a, r.col_b])


def test_describe_equals_pandas(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"a": rng.normal(size=200), "b": rng.normal(size=200)})
    pdf.loc[:9, "b"] = np.nan
    got = PR.describe(frame(spark, pdf), ["a", "b"]).toPandas().set_index("column")
    want = pdf.describe().round(2)
    for ours, theirs in zip(["count", "mean", "std", "min", "q25", "q50", "q75", "max"], want.index):
        same(got.loc[["a", "b"], ours], want.loc[theirs, ["a", "b"]], 0.0100001)
    assert got.loc["b", "n_null"] == 10


def test_box_stats(spark):
    x = np.concatenate([np.arange(100.0), [1000.0]])
    pdf = pd.DataFrame({"v": x, "anomaly": 0})
    got = PR.box_stats(spark.createDataFrame(pdf), ["v"]).first()
    q1, q3 = np.quantile(x, [0.25, 0.75])
    assert (got["q1"], got["q3"]) == (q1, q3)
    assert got["whisker_hi"] == 99 and got["whisker_lo"] == 0 and got["n_outliers"] == 1


def test_clinical_and_medians_and_shift(spark):
    pdf = pd.DataFrame({"hr": [50.0, 60.0, 100.0, 101.0], "sp": [94.0, 95.0, 100.0, 80.0], "anomaly": [1, 1, 0, 1]})
    df = spark.createDataFrame(pdf)
    rows = PR.clinical_deviation(df, {"hr": (60, 100), "sp": (95, 100), "absent": (0, 1)})
    assert sorted(r["n_vitals_outside_range"] for r in rows.collect()) == [0, 2, 2]
    shares = {r[0]: (r["n"], r["share"]) for r in PR.value_counts(rows, "n_vitals_outside_range").collect()}
    assert shares == {0: (1, pytest.approx(1 / 3)), 2: (2, pytest.approx(2 / 3))}
    above = {r["column"]: r["rate"] for r in PR.above_median_share(df, ["hr"]).collect()}
    assert above["hr"] == pytest.approx(1 / 3)
    shift = {r["column"]: r["deviation"] for r in PR.mean_shift(df, ["hr"]).collect()}
    assert shift["hr"] == pytest.approx(abs(pdf.loc[pdf.anomaly == 1, "hr"].mean() - pdf["hr"].mean()))
    calm = df.withColumn("anomaly", F.lit(0))
    assert PR.mean_shift(calm, ["hr"]).first()["deviation"] == 0
    assert PR.above_median_share(calm, ["hr"]).first()["rate"] == 0


@pytest.fixture(scope="module")
def votes(spark):
    rng = np.random.default_rng(4)
    n = 400
    base = series(n)
    results = {}
    for name, p in (("prophet", 0.3), ("if", 0.1), ("lstm", 0.1)):
        pdf = base.assign(anomaly=(rng.random(n) < p).astype(int), split=np.where(np.arange(n) < 320, "train", "test"))
        results[name] = pdf.iloc[5:] if name == "lstm" else pdf
    frames = {k: frame(spark, v) for k, v in results.items()}
    models = list(results)
    return results, EN.add_votes(EN.align_results(frames), models).cache(), models


def test_votes(votes):
    results, merged, models = votes
    got = merged.orderBy("timestamp").toPandas()
    flags = np.column_stack([results[m]["anomaly"].to_numpy()[-395:] for m in models])
    assert got["vote_count"].tolist() == flags.sum(axis=1).tolist()
    assert got["anomaly_ensemble"].tolist() == (flags.sum(axis=1) >= 2).astype(int).tolist()


def test_inclusion_exclusion(votes):
    _, merged, models = votes
    pairs = EN.pairwise_agreement(merged, models).agg(F.sum("both_flag")).first()[0]
    all_three = EN.unanimous_share(merged).first()["n_unanimous"]
    assert merged.agg(F.sum("anomaly_ensemble")).first()[0] == pairs - 2 * all_three


def test_rates_by_split_has_a_total(votes):
    _, merged, models = votes
    got = EN.rates_by_split(merged, models).toPandas()
    total = got[(got["split"] == "all") & (got["model"] == "ensemble")].iloc[0]
    assert total["n"] == 395
    assert total["n_flagged"] == got[(got["split"] != "all") & (got["model"] == "ensemble")]["n_flagged"].sum()


def test_top_unanimous_is_earliest(votes):
    _, merged, _ = votes
    want = merged.where("vote_count = 3").orderBy("timestamp").toPandas()["timestamp"].tolist()[:2]
    assert [r["timestamp"] for r in EN.top_unanimous(merged, 2).collect()] == want


def test_sample_is_repeatable(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    a = [r["k"] for r in RP.sample_rows(df.repartition(7), 50, ["k"], ["k"]).collect()]
    b = [r["k"] for r in RP.sample_rows(df.coalesce(1), 50, ["k"], ["k"]).collect()]
    assert a == b == sorted(a) and len(set(a)) == 50
    assert RP.sample_rows(df, 5000, ["k"], ["k"]).count() == 1000


def test_kpis(spark):
    pdf = series(4, anomaly=[0, 1, 1, 0], mse=[1.0, 2.0, 3.0, 4.0], threshold=2.5, split=["train", "train", "test", "test"])
    df = frame(spark, pdf)
    row = RP.kpis({"lstm": df}).first()
    assert (row["n_rows"], row["n_flagged"], row["rate"], row["mean_score"], row["threshold"]) == (4, 2, 0.5, 2.5, 2.5)
    assert RP.kpis({"lstm": df}, "test").first()["n_rows"] == 2


def test_labels_and_equal_flags(spark):
    df = spark.createDataFrame([(0, 0), (1, 1)], "a int, b int")
    assert {r[0] for r in df.select(label("a")).collect()} == {"normal", "anomaly"}
    assert RP.flags_equal(df, "a", "b").first()[0]
    assert not RP.flags_equal(df.withColumn("b", F.lit(0)), "a", "b").first()[0]


def test_csv_roundtrip_and_results(spark, tmp_path):
    pdf = series(3, anomaly=[0, 1, 0], anomaly_residual=[1, 0, 0]).rename(columns={"timestamp": "ds"})
    df = frame(spark, pdf, ["ds"])
    write_table(df, str(tmp_path / "x.csv"), "csv")
    back = read_table(spark, str(tmp_path / "x.csv"), df.schema)
    assert back.orderBy("ds").collect() == df.orderBy("ds").collect()
    with pytest.raises(ValueError):
        read_table(spark, str(tmp_path / "x.csv"))
    write_table(df, str(tmp_path / "r"))
    got = load_results(spark, {"prophet": str(tmp_path / "r"), "if": str(tmp_path / "none")}, {"prophet": "anomaly_residual"})
    assert list(got) == ["prophet"] and got["prophet"].columns.count("anomaly") == 1
    assert got["prophet"].agg(F.sum("anomaly"), F.sum("anomaly_interval")).first() == (1, 1)
    assert "timestamp" in got["prophet"].columns


def test_quantiles_of_large_groups_read_the_rows_three_times(spark):
    """One pass counts the groups, one the bins, one the values; values that fill a bin need no further pass."""
    n, seen = 20_000, spark.sparkContext.accumulator(0)

    def counting(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rng = np.random.default_rng(4)
    v = np.concatenate([rng.uniform(900, 105_000, n - 4000), np.full(3000, 7.0), -rng.lognormal(0, 2, 1000)])
    df = frame(spark, pd.DataFrame({"v": v})).mapInArrow(counting, "v double")
    got = exact_quantiles(df, "v", [0.01, 0.15, 0.5, 0.99], exact_rows=500).orderBy("prob").toPandas()
    same(got["value"], np.quantile(v, [0.01, 0.15, 0.5, 0.99]), 1e-12)
    assert seen.value <= 3 * n


@pytest.mark.parametrize("exact_rows", [10**6, 5])
def test_quantiles_of_odd_values(spark, exact_rows):
    """Zeros of both signs, values that share a bin, infinities, NaN above all, nulls left out, null keys kept."""
    near = 1.7e9 + np.arange(400) / 1e4
    v = [*near, *-near, 0.0, -0.0, 5e-324, -5e-324, 1.7e308, -1.7e308, float("inf"), float("-inf"), float("nan")]
    rows = [(g, x) for g in (None, "a") for x in map(float, v)] + [("a", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(3)
    probs = [i / (len(v) - 1) for i in (0, 1, 2, 100, 400, 401, 402, 403, 404, 500, 805, 807, 808)]
    got = exact_quantiles(df, "v", probs, ["g"], exact_rows=exact_rows).orderBy("g", "prob").toPandas()
    want = np.sort(v)[[round(p * (len(v) - 1)) for p in probs]]
    for g in (got["g"].isna(), got["g"] == "a"):
        mine = got[g]["value"].to_numpy()
        fine = np.isfinite(want)
        assert len(mine) == len(probs)
        np.testing.assert_allclose(mine[fine], want[fine], rtol=1e-12, atol=1e-300)
