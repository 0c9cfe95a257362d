import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from helpers import frame, same, series
from vitalstream.functions.timeline import freq_micros, from_micros, micros
from vitalstream.operators import clean as C

LIM = {"a": (0.0, 100.0), "b": (0.0, 100.0)}


def with_gaps(rng, n):
    """Gaps of 1, 10, 11, 20, 21 and 40 rows, and open ends of 5 and 15."""
    v = rng.normal(50, 10, n)
    at = 20
    for gap in (1, 10, 11, 20, 21, 40):
        v[at:at + gap] = np.nan
        at += gap + int(rng.integers(1, 15))
    v[:5] = np.nan
    v[-15:] = np.nan
    return v


@pytest.mark.parametrize("limit", [1, 10])
@pytest.mark.parametrize("block_rows,fanout", [(16, 2), (64, 8), (4096, 4096)])
def test_interpolation_equals_pandas(spark, limit, block_rows, fanout):
    rng = np.random.default_rng(limit * 1000 + block_rows)
    pdf = series(300, a=with_gaps(rng, 300), b=np.where(rng.random(300) < 0.6, np.nan, rng.normal(size=300)),
                 c=np.full(300, np.nan))
    pdf["pos"] = np.arange(300)
    got = C.interpolate(frame(spark, pdf), ["a", "b", "c"], limit, block_rows=block_rows, fanout=fanout)
    got = got.orderBy("pos").toPandas()
    want = pdf[["a", "b", "c"]].interpolate(method="linear", limit=limit, limit_direction="both")
    for c in "abc":
        same(got[c], want[c])
    assert (got["still_missing"] == want.isna().any(axis=1).astype(int)).all()


def reference_clean(pdf, vitals, limits, freq, gap):
    pdf = pdf.copy()
    for c in vitals:
        lo, hi = limits[c]
        pdf.loc[(pdf[c] < lo) | (pdf[c] > hi), c] = np.nan
    out = pdf.set_index("timestamp").sort_index()[vitals].resample(freq).mean()
    out["was_missing"] = out[vitals].isna().any(axis=1).astype(int)
    out[vitals] = out[vitals].interpolate(method="linear", limit=gap, limit_direction="both")
    return out.dropna(subset=vitals, how="all").reset_index()


@pytest.mark.parametrize("freq,block_rows", [("1min", 4096), ("1min", 16), ("7min", 16)])
def test_clean_equals_pandas(spark, freq, block_rows):
    rng = np.random.default_rng(5)
    times = pd.Timestamp("2024-01-01 23:50:03") + pd.to_timedelta(
        np.sort(np.concatenate([rng.integers(0, 3000, 200), rng.integers(9000, 12000, 100)])), unit="s")
    pdf = pd.DataFrame({"timestamp": times, "a": rng.normal(50, 40, 300), "b": rng.normal(50, 40, 300)})
    pdf.loc[rng.random(300) < 0.3, "a"] = np.nan
    pdf.loc[0, "a"], pdf.loc[1, "b"] = 100.0, 0.0  # on the limits: kept
    got = C.clean(frame(spark, pdf.sample(frac=1, random_state=1)), ["a", "b"], LIM, freq, 3, block_rows=block_rows)
    got = got.orderBy("pos").toPandas()
    want = reference_clean(pdf, ["a", "b"], LIM, freq, 3)
    assert list(got["pos"]) == list(range(len(want)))
    assert (got["timestamp"] == want["timestamp"]).all()
    same(got["a"], want["a"])
    same(got["b"], want["b"])
    assert (got["was_missing"] == want["was_missing"]).all()


def test_clean_with_keys_is_clean_per_key(spark):
    rng = np.random.default_rng(6)
    parts = []
    for key, n in (("x", 400), ("y", 30), ("z", 1)):
        t = pd.Timestamp("2024-01-01") + pd.to_timedelta(rng.integers(0, n * 90, n), unit="s")
        parts.append(pd.DataFrame({"key": key, "timestamp": t, "a": rng.normal(50, 40, n), "b": rng.normal(50, 20, n)}))
    pdf = pd.concat(parts)
    got = C.clean(frame(spark, pdf), ["a", "b"], LIM, "1min", 2, keys=["key"], block_rows=32).toPandas()
    for key, part in pdf.groupby("key"):
        mine = got[got["key"] == key].sort_values("pos")
        want = reference_clean(part, ["a", "b"], LIM, "1min", 2)
        assert list(mine["pos"]) == list(range(len(want)))
        same(mine["a"], want["a"])
        same(mine["b"], want["b"])


def test_limit_counts(spark):
    pdf = series(5, a=[-1.0, 0.0, 100.0, 100.5, np.nan], b=[1.0] * 5)
    got = {r["column"]: r["n_clipped"] for r in C.limit_counts(frame(spark, pdf), LIM).collect()}
    assert got == {"a": 2, "b": 0}
    kept = C.apply_limits(frame(spark, pdf), LIM).orderBy("timestamp").toPandas()["a"]
    same(kept, [np.nan, 0.0, 100.0, np.nan, np.nan])


def test_rename_reports_absent(spark):
    df, absent = C.rename_columns(spark.range(1).select(F.col("id").alias("A")), {"A": "a", "B": "b"})
    assert df.columns == ["a"] and absent == ["B"]


def test_missing_column_raises(spark):
    with pytest.raises(KeyError):
        C.parse_timestamps(spark.range(1))
    with pytest.raises(KeyError):
        C.require_columns(spark.range(1), ["nope"])


def test_parse_text(spark):
    df = spark.createDataFrame([("2024-03-03 00:14:00",)], "timestamp string")
    got = C.parse_timestamps(df)
    assert got.dtypes == [("timestamp", "timestamp_ntz")]
    assert got.first()[0] == datetime.datetime(2024, 3, 3, 0, 14)


def test_time_arithmetic_ignores_the_session_zone(spark):
    times = ["1969-12-31 23:59:59.5", "2024-03-10 02:30:00", "2024-11-03 01:30:00.000001"]
    df = spark.createDataFrame([(t,) for t in times], "s string").select(F.col("s").cast("timestamp_ntz").alias("t"))
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        rows = df.select("t", micros(F.col("t")).alias("us"), from_micros(micros(F.col("t"))).alias("back")).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    for row, text in zip(rows, times):
        assert row["us"] == pd.Timestamp(text).value // 1000
        assert row["back"] == row["t"]


def test_frequencies():
    assert freq_micros("15min") == 900_000_000 and freq_micros("1D") == 86_400_000_000
    for bad in ("0min", "1 fortnight", ""):
        with pytest.raises(ValueError):
            freq_micros(bad)


def test_drop_rules(spark):
    pdf = series(3, a=[1.0, np.nan, np.nan], b=[np.nan, np.nan, 2.0])
    df = frame(spark, pdf)
    assert C.drop_empty(df, ["a", "b"]).count() == 2
    assert C.drop_incomplete(df, ["a", "b"]).count() == 0
