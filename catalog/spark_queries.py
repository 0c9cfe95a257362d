"""Every operator as a query over the test tables.

Stand-in for vital signs: ``events`` split by ``event_type`` into five channels.
"""

from __future__ import annotations

import uuid
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from vitalstream.config import (
    EnsembleConfig, FeatureConfig, ForecastConfig, ForestConfig, SeriesConfig, CleanConfig, Settings,
    WindowModelConfig,
)
from vitalstream.functions.flags import flag, label, min_max
from vitalstream.functions.quantiles import exact_quantiles
from vitalstream.functions.summary import attach
from vitalstream.operators import clean as C
from vitalstream.operators import ensemble, features, forecast, forest, reconstruct, scaling, windows
from vitalstream.operators.blocks import POS, number_rows
from vitalstream.operators.split import filter_split, label_split
from vitalstream.plans import profile, report, workflow
from vitalstream.sources.tables import load_results, materialise, read_table, shared_dir, write_table
from vitalstream.streaming.score import start_scoring

CHANNELS = ["click", "error", "purchase", "signup", "view"]
LIMITS = {c: (1.0, 200.0) for c in CHANNELS}
LINE_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"]
LINE_RANGES = {
    "l_quantity": (5.0, 45.0), "l_extendedprice": (1000.0, 80000.0), "l_discount": (0.01, 0.09), "l_tax": (0.01, 0.07),
}
WINDOW = 12
# Added before rounding on both sides: means of cents often lie exactly between
# two rounded values, where the last bit of a sum would decide.
TIE = 3e-10
QUERIES = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    doubles = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.round(F.col(c).cast("double") + F.lit(TIE), digits) for c in doubles})


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/vitalstream/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def channels(spark: SparkSession, sf_dir: str, *extra: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    values = [F.expr(f"IF(event_type = '{c}', value, NULL) AS {c}") for c in CHANNELS]
    return ev.select(F.col("ts").alias("timestamp"), *extra, *values)


def flagged_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.withColumn("anomaly", flag(F.col("l_returnflag") == "R"))


@lru_cache(maxsize=None)
def _stored(spark: SparkSession, sf_dir: str, what: str) -> DataFrame:
    """Tables several queries start from, derived once per session."""
    if what == "grid15":
        limited = C.apply_limits(channels(spark, sf_dir), LIMITS)
        return materialise(C.resample(limited, CHANNELS, "15min"), what)
    if what == "clean15":
        return materialise(C.clean(channels(spark, sf_dir), CHANNELS, LIMITS, "15min", 10), what)
    if what == "features":
        made, cols = features.build_features(_stored(spark, sf_dir, "clean15"), CHANNELS, (5, 15), (1, 5))
        return materialise(made.select("timestamp", POS, "was_missing", *cols), what)
    if what == "merged":
        return materialise(ensemble.add_votes(
            ensemble.align_results(_detectors(spark, sf_dir)), list(_detectors(spark, sf_dir))), what)
    if what == "forest":
        li = table(spark, sf_dir, "lineitem")
        return materialise(li.select(*LINE_KEY, *LINE_COLS), what)
    raise KeyError(what)


def feature_names() -> list[str]:
    out = list(CHANNELS)
    for c in CHANNELS:
        out += [f"{c}_roll_{k}_{w}" for w in (5, 15) for k in ("mean", "std")] + [f"{c}_lag_{k}" for k in (1, 5)]
    return [*out, "sin_time", "cos_time"]


def grid15(spark, sf_dir):
    return _stored(spark, sf_dir, "grid15")


def clean15(spark, sf_dir):
    return _stored(spark, sf_dir, "clean15")


def _band(spark, sf_dir) -> DataFrame:
    """Trailing mean and deviation of ``click`` as a forecast made elsewhere."""
    rolled = features.add_window_features(
        clean15(spark, sf_dir).select(POS, "timestamp", "click"), ["click"], [60]
    )
    mean, std = F.col("click_roll_mean_60"), F.col("click_roll_std_60")
    return rolled.select(
        POS, F.col("timestamp").alias("ds"), F.col("click").alias("y"), mean.alias("yhat"),
        (mean - 1.28 * std).alias("yhat_lower"), (mean + 1.28 * std).alias("yhat_upper"),
    )


def _band_result(spark, sf_dir) -> DataFrame:
    return label_split(forecast.flag_by_residual(forecast.flag_interval(_band(spark, sf_dir)), 2.0), 0.8)


def _score_result(spark, sf_dir) -> DataFrame:
    """|value - mean| of ``error`` as a score, flagged above its 95 % quantile on training rows."""
    rows = label_split(clean15(spark, sf_dir).select(POS, "timestamp", *CHANNELS), 0.8)
    raw = attach(rows, rows.agg(F.avg("error").alias("m"))).withColumn("raw", F.abs(F.col("error") - F.col("m")))
    span = raw.agg(F.min("raw").alias("lo"), F.max("raw").alias("hi"))
    scored = attach(raw, span).withColumn("anomaly_score", min_max(F.col("raw"), F.col("lo"), F.col("hi")))
    cut = exact_quantiles(raw.where("split = 'train'"), "raw", [0.95]).select(F.col("value").alias("cut"))
    hit = F.col("raw") > F.col("cut")
    return attach(scored, cut).withColumns({"anomaly_if": F.when(hit, -1).otherwise(1), "anomaly": flag(hit)}).select(
        "timestamp", POS, *CHANNELS, "anomaly_if", "anomaly", "anomaly_score", "split"
    )


def _window_scores(spark, sf_dir) -> DataFrame:
    """Squared standardised ``view`` as a score of windows of 12 rows."""
    rows = clean15(spark, sf_dir).select(POS, "timestamp", "view")
    stats = rows.agg(F.avg("view").alias("m"), F.stddev_pop("view").alias("s"))
    z = (F.col("view") - F.col("m")) / F.col("s")
    return attach(rows, stats).select(POS, "timestamp", (z * z).alias("mse")).where(F.col(POS) >= WINDOW - 1)


def _window_flags(spark, sf_dir) -> DataFrame:
    return reconstruct.flag_windows(_window_scores(spark, sf_dir), 1.5, WINDOW, 0.8)


def _detectors(spark, sf_dir) -> dict[str, DataFrame]:
    return {
        "prophet": _band_result(spark, sf_dir).withColumnRenamed("ds", "timestamp"),
        "if": _score_result(spark, sf_dir),
        "lstm": _window_flags(spark, sf_dir),
    }


def merged(spark, sf_dir):
    return _stored(spark, sf_dir, "merged")


# --- sources and sinks -----------------------------------------------------

@query
def csv_roundtrip(spark, sf_dir):
    path = scratch(spark, "events.csv")
    ev = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    write_table(ev, path, "csv")
    return rounded(read_table(spark, path, ev.schema, ["ts"], "csv"))


@query
def parquet_timestamps(spark, sf_dir):
    path = f"{sf_dir}/orders.parquet"
    return rounded(read_table(spark, path, timestamp_cols=["o_orderdate"]).select("o_orderkey", "o_orderdate", "o_totalprice"))


@query
def stored_windows(spark, sf_dir):
    path = scratch(spark, "windows")
    windows.save_windows(windows.build_windows(clean15(spark, sf_dir), ["click", "view"], 3), path)
    return _flat_windows(windows.load_windows(spark, path), 3, 2)


@query
def stored_scaler(spark, sf_dir):
    path = scratch(spark, "scaler")
    scaling.save_scaler(spark, scaling.fit_scaler(_stored(spark, sf_dir, "features"), CHANNELS), path)
    return rounded(scaling.scaler_table(spark, scaling.load_scaler(spark, path)))


@query
def stored_results(spark, sf_dir):
    root = scratch(spark, "results")
    write_table(_band_result(spark, sf_dir), f"{root}/prophet")
    write_table(_score_result(spark, sf_dir), f"{root}/if")
    loaded = load_results(
        spark, {"prophet": f"{root}/prophet", "if": f"{root}/if", "lstm": f"{root}/absent"},
        {"prophet": "anomaly_residual"},
    )
    parts = [df.select(F.lit(n).alias("model"), "timestamp", "anomaly", "split") for n, df in loaded.items()]
    return parts[0].unionByName(parts[1])


# --- projections, filters, predicates --------------------------------------

@query
def rename_mapped(spark, sf_dir):
    mapping = {"l_quantity": "quantity", "l_extendedprice": "price", "not_there": "x"}
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    renamed, absent = C.rename_columns(li, mapping)
    return rounded(renamed.withColumn("absent", F.lit(",".join(absent))))


@query
def parse_text_timestamps(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"))
    return C.parse_timestamps(C.require_columns(ev, ["timestamp"]))


@query
def single_stream_key(spark, sf_dir):
    return C.single_stream(table(spark, sf_dir, "events").select("event_id", "ts"))


@query
def limits_to_null(spark, sf_dir):
    return rounded(C.apply_limits(channels(spark, sf_dir, "event_id"), LIMITS))


@query
def limit_counts(spark, sf_dir):
    return C.limit_counts(channels(spark, sf_dir), LIMITS)


@query
def target_rows(spark, sf_dir):
    return rounded(forecast.prepare_target(grid15(spark, sf_dir), "view"))


@query
def complete_rows(spark, sf_dir):
    return rounded(C.drop_incomplete(grid15(spark, sf_dir), ["click", "view"]).select(POS, "click", "view"))


@query
def zero_fill(spark, sf_dir):
    grid = grid15(spark, sf_dir)
    return rounded(features.fill_features(grid, CHANNELS, CHANNELS).select(POS, *CHANNELS))


@query
def zero_fill_total(spark, sf_dir):
    return features.null_total(grid15(spark, sf_dir), CHANNELS)


@query
def fill_or_drop(spark, sf_dir):
    grid = grid15(spark, sf_dir)
    return rounded(features.fill_features(grid, CHANNELS, ["click", "view"], "drop").select(POS, *CHANNELS))


@query
def discovered_features(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    cols = features.feature_columns(li, ("l_orderkey", "l_linenumber"))
    return profile.melt(li, cols).groupBy("column").agg(F.count("value").alias("n"))


@query
def split_filter(spark, sf_dir):
    return rounded(filter_split(_band_result(spark, sf_dir), "Test").select("ds", "y", "split"))


@query
def flag_labels(spark, sf_dir):
    li = flagged_lines(spark, sf_dir)
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", label("anomaly").alias("label"))


@query
def result_projection(spark, sf_dir):
    scored = _score_result(spark, sf_dir).select(POS, "timestamp", "anomaly_if", "anomaly", "anomaly_score")
    return rounded(forest.forest_result(scored, clean15(spark, sf_dir), CHANNELS, 0.8))


@query
def flags_identical(spark, sf_dir):
    return report.flags_equal(_band_result(spark, sf_dir), "anomaly", "anomaly_residual")


# --- joins -----------------------------------------------------------------

@query
def external_forecast(spark, sf_dir):
    band = _band(spark, sf_dir)
    actuals = forecast.prepare_target(clean15(spark, sf_dir), "click")
    # A forecast that covers only times with a known view: the others stay unmatched.
    seen = grid15(spark, sf_dir).where("view IS NOT NULL").select(F.col("timestamp").alias("ds"))
    return rounded(forecast.flag_interval(forecast.merge_forecast(actuals, band.join(seen, "ds", "left_semi"))))


@query
def aligned_window_scores(spark, sf_dir):
    scores = _window_scores(spark, sf_dir).select((F.col(POS) - (WINDOW - 1)).alias("window_index"), "mse")
    rows = clean15(spark, sf_dir).select(POS, "timestamp", "view")
    return rounded(windows.align_windows(scores, rows, WINDOW))


@query
def aligned_results(spark, sf_dir):
    return ensemble.align_results(_detectors(spark, sf_dir))


# --- aggregations ----------------------------------------------------------

@query
def resample_gapless(spark, sf_dir):
    return rounded(grid15(spark, sf_dir))


@query
def resample_seven_minutes(spark, sf_dir):
    return rounded(C.resample(channels(spark, sf_dir), ["click", "view"], "7min"))


@query
def resample_per_user(spark, sf_dir):
    return rounded(C.resample(channels(spark, sf_dir, "user_id"), CHANNELS, "1d", ["user_id"]))


@query
def dataset_overview(spark, sf_dir):
    return profile.overview(table(spark, sf_dir, "events"), "ts", "user_id")


@query
def describe_lines(spark, sf_dir):
    return rounded(profile.describe(table(spark, sf_dir, "lineitem"), LINE_COLS, None), 2)


@query
def describe_grid(spark, sf_dir):
    return rounded(profile.describe(grid15(spark, sf_dir), CHANNELS, None), 2)


@query
def rows_per_key(spark, sf_dir):
    return profile.key_counts(table(spark, sf_dir, "events"), "user_id")


@query
def distinct_keys(spark, sf_dir):
    return profile.distinct_total(table(spark, sf_dir, "events"), "user_id")


@query
def correlation_matrix(spark, sf_dir):
    return rounded(profile.correlations(table(spark, sf_dir, "lineitem"), LINE_COLS))


@query
def correlation_with_gaps(spark, sf_dir):
    return rounded(profile.correlations(grid15(spark, sf_dir), CHANNELS))


@query
def histogram_all(spark, sf_dir):
    return rounded(profile.histogram(table(spark, sf_dir, "events"), "value", 50))


@query
def histogram_by_flag(spark, sf_dir):
    return rounded(profile.histogram(flagged_lines(spark, sf_dir), "l_extendedprice", 60, ["anomaly"]), 9)


@query
def box_by_flag(spark, sf_dir):
    return rounded(profile.box_stats(flagged_lines(spark, sf_dir), LINE_COLS))


@query
def forecast_metrics(spark, sf_dir):
    return rounded(report.forecast_metrics(_band_result(spark, sf_dir)))


@query
def forest_metrics(spark, sf_dir):
    return rounded(report.forest_metrics(_score_result(spark, sf_dir)))


@query
def window_metrics(spark, sf_dir):
    return rounded(report.window_metrics(_window_flags(spark, sf_dir)))


@query
def kpi_all(spark, sf_dir):
    return rounded(report.kpis(_detectors(spark, sf_dir), flags={"prophet": "anomaly_residual"}))


@query
def kpi_test(spark, sf_dir):
    return rounded(report.kpis(_detectors(spark, sf_dir), "test", {"prophet": "anomaly_residual"}))


@query
def vote_counts(spark, sf_dir):
    return rounded(profile.value_counts(merged(spark, sf_dir), "vote_count"))


@query
def clinical_rows(spark, sf_dir):
    rows = flagged_lines(spark, sf_dir).select("l_orderkey", "l_linenumber", *LINE_COLS, "anomaly")
    return rounded(profile.clinical_deviation(rows, LINE_RANGES))


@query
def clinical_counts(spark, sf_dir):
    rows = profile.clinical_deviation(flagged_lines(spark, sf_dir), LINE_RANGES)
    return rounded(profile.value_counts(rows, "n_vitals_outside_range"))


@query
def pairwise_agreement(spark, sf_dir):
    return rounded(ensemble.pairwise_agreement(merged(spark, sf_dir), ["prophet", "if", "lstm"]))


@query
def rates_by_split(spark, sf_dir):
    return rounded(ensemble.rates_by_split(merged(spark, sf_dir), ["prophet", "if", "lstm"]))


@query
def above_median(spark, sf_dir):
    return rounded(profile.above_median_share(flagged_lines(spark, sf_dir), LINE_COLS))


@query
def mean_shift(spark, sf_dir):
    return rounded(profile.mean_shift(flagged_lines(spark, sf_dir), LINE_COLS))


@query
def score_quantiles(spark, sf_dir):
    return rounded(profile.quantile_table(table(spark, sf_dir, "lineitem"), "l_extendedprice", [0.5, 0.9, 0.95, 0.99]))


@query
def score_quantiles_bracketed(spark, sf_dir):
    """The same result by the way large tables take."""
    li = table(spark, sf_dir, "lineitem")
    return rounded(profile.quantile_table(li, "l_extendedprice", [0.5, 0.9, 0.95, 0.99], exact_rows=2000))


@query
def quantiles_with_null_group(spark, sf_dir):
    """A null key is a group like any other, whichever way its quantiles are found."""
    lines = table(spark, sf_dir, "lineitem").select(F.nullif("l_returnflag", F.lit("N")).alias("v"), "l_extendedprice")
    small = exact_quantiles(lines, "l_extendedprice", [0.1, 0.5], ["v"])
    large = exact_quantiles(lines, "l_extendedprice", [0.1, 0.5], ["v"], exact_rows=500)
    return rounded(small.withColumn("way", F.lit("small")).unionByName(large.withColumn("way", F.lit("large"))))


@query
def histogram_null_group(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.nullif("l_returnflag", F.lit("N")).alias("g"), "l_quantity")
    return rounded(profile.histogram(lines, "l_quantity", 7, ["g"]))


@query
def box_null_group(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.nullif("l_returnflag", F.lit("N")).alias("bin"), "l_quantity")
    return rounded(profile.box_stats(lines, ["l_quantity"], "bin"))


@query
def positions_null_key(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", F.nullif("event_type", F.lit("view")).alias("block"))
    return number_rows(events, ["block"], "event_id", 256)


@query
def first_test_time(spark, sf_dir):
    return profile.first_test_time(_score_result(spark, sf_dir))


@query
def feature_sanity(spark, sf_dir):
    table_ = _stored(spark, sf_dir, "features")
    return rounded(features.sanity_report(table_, feature_names()), 4)


# --- windows and order -----------------------------------------------------

@query
def interpolate_gap2(spark, sf_dir):
    return rounded(C.interpolate(grid15(spark, sf_dir), CHANNELS, 2))


@query
def interpolate_gap10_small_blocks(spark, sf_dir):
    """The same operator over many small blocks and block groups."""
    return rounded(C.interpolate(grid15(spark, sf_dir), CHANNELS, 10, block_rows=64, fanout=8))


@query
def interpolate_per_user(spark, sf_dir):
    daily = C.resample(channels(spark, sf_dir, "user_id"), CHANNELS, "1d", ["user_id"])
    return rounded(C.interpolate(materialise(daily, "daily"), CHANNELS, 2, ["user_id"]))


@query
def clean_minutes(spark, sf_dir):
    """One-minute series with long gaps: empty rows are dropped and positions closed up."""
    return rounded(C.clean(channels(spark, sf_dir), CHANNELS, LIMITS, "1min", 1))


@query
def rolling_features(spark, sf_dir):
    grid = grid15(spark, sf_dir).select(POS, "click", "view")
    return rounded(features.add_window_features(grid, ["click", "view"], [5, 15, 60]))


@query
def rolling_features_wide(spark, sf_dir):
    """All channels, in small blocks."""
    grid = grid15(spark, sf_dir).select(POS, *CHANNELS)
    return rounded(features.add_window_features(grid, CHANNELS, [5, 15, 60], block_rows=512))


@query
def rolling_with_outlier(spark, sf_dir):
    """Deviations beside readings of 1e12; windows that hold one give -1, as its square has no decimals left."""
    grid = grid15(spark, sf_dir).select(POS, F.when(F.col(POS) % 500 == 3, 1e12).otherwise(F.col("click")).alias("click"))
    found = features.add_window_features(grid, ["click"], [5, 15, 60], block_rows=1024)
    names = [f"click_roll_std_{w}" for w in (5, 15, 60)]
    return rounded(found.select(POS, *[F.when(F.col(n) > 1e6, -1.0).otherwise(F.col(n)).alias(n) for n in names]))


@query
def lag_features(spark, sf_dir):
    grid = grid15(spark, sf_dir).select(POS, "click", "view")
    return rounded(features.add_window_features(grid, ["click", "view"], lags=[1, 5, 15], block_rows=256))


@query
def rolling_per_user(spark, sf_dir):
    daily = C.resample(channels(spark, sf_dir, "user_id"), ["click", "view"], "1d", ["user_id"])
    rows = daily.select("user_id", POS, "click", "view")
    return rounded(features.add_window_features(rows, ["click", "view"], [5], [1], ["user_id"]))


@query
def row_positions(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return number_rows(orders, ["o_orderstatus"], "o_orderkey", 512, fanout=4)


@query
def split_labels(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    return label_split(number_rows(orders, (), "o_orderkey"), 0.8)


@query
def sliding_windows(spark, sf_dir):
    return _flat_windows(windows.build_windows(clean15(spark, sf_dir), ["click", "view"], 4, block_rows=128), 4, 2)


def _flat_windows(df: DataFrame, length: int, width: int) -> DataFrame:
    cells = [F.col("seq")[i][j].alias(f"x{i}_{j}") for i in range(length) for j in range(width)]
    return rounded(df.select(POS, "timestamp", *cells), 3)


# --- order, limits, samples ------------------------------------------------

@query
def time_ordered(spark, sf_dir):
    """Sorted by time; the place is part of the result, so that the order is checked."""
    events = table(spark, sf_dir, "events").select("event_id", "ts")
    ordered = report.sorted_by_time(events, (), "ts", ["event_id"])
    return report.numbered_in_order(ordered, "place")


@query
def top_unanimous(spark, sf_dir):
    return ensemble.top_unanimous(merged(spark, sf_dir), 20)


@query
def unanimous_share(spark, sf_dir):
    return rounded(ensemble.unanimous_share(merged(spark, sf_dir)))


@query
def top_flagged_scores(spark, sf_dir):
    return rounded(report.top_scores(_score_result(spark, sf_dir), 20, "anomaly_score", ["split", *CHANNELS], only_flagged=True))


@query
def top_window_scores(spark, sf_dir):
    return rounded(report.top_scores(_window_flags(spark, sf_dir), 20, "mse", ["split", "anomaly"]))


@query
def sampled_rows(spark, sf_dir):
    return report.sample_rows(table(spark, sf_dir, "events"), 2000, ["event_id"], ["ts", "event_id"])


@query
def first_rows(spark, sf_dir):
    return rounded(report.head(table(spark, sf_dir, "events").select("ts", "event_id", "value"), 15, ["ts", "event_id"]))


# --- scalars and scaling ---------------------------------------------------

@query
def time_of_day(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select("event_id", F.col("ts").alias("timestamp"))
    return rounded(features.add_time_features(ev))


@query
def normalised_scores(spark, sf_dir):
    return rounded(_score_result(spark, sf_dir).select(POS, "anomaly_score", "anomaly"))


@query
def standard_scaled(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *LINE_COLS)
    return rounded(scaling.scale_features(li, LINE_COLS)[0])


@query
def minmax_scaled(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *LINE_COLS)
    return rounded(scaling.scale_features(li, LINE_COLS, "minmax")[0])


@query
def scaled_feature_table(spark, sf_dir):
    made = _stored(spark, sf_dir, "features")
    return rounded(scaling.scale_features(made, feature_names())[0], 5)


# --- detectors -------------------------------------------------------------

@query
def interval_flags(spark, sf_dir):
    return rounded(forecast.flag_interval(_band(spark, sf_dir)))


@query
def residual_zscore(spark, sf_dir):
    return rounded(_band_result(spark, sf_dir).select("ds", "residual", "residual_zscore", "anomaly_residual", "split"))


@query
def window_threshold(spark, sf_dir):
    train = _window_flags(spark, sf_dir).where("split = 'train'")
    return rounded(reconstruct.score_threshold(train, 3.0))


@query
def window_flags(spark, sf_dir):
    return rounded(_window_flags(spark, sf_dir))


@query
def threshold_sweep(spark, sf_dir):
    return rounded(reconstruct.threshold_sweep(_window_flags(spark, sf_dir), [2.0, 2.5, 3.0, 3.5, 4.0]))


@query
def rethresholded(spark, sf_dir):
    return rounded(reconstruct.rethreshold(_window_flags(spark, sf_dir), 2.0).select(POS, "mse", "threshold", "anomaly"))


@query
def contamination_sweep(spark, sf_dir):
    return rounded(forest.contamination_sweep(_score_result(spark, sf_dir), [0.01, 0.03, 0.05, 0.08, 0.10]))


@query
def ensemble_votes(spark, sf_dir):
    return merged(spark, sf_dir)


@query
def forecast_model(spark, sf_dir):
    rows = forecast.number_series(forecast.to_long(clean15(spark, sf_dir), ["click"]), 0.8)
    model = forecast.fit_forecast(rows)
    return rounded(model.select("series", "n", "y_scale", "slope", "intercept", "sigma", "status"))


@query
def forecast_every_channel(spark, sf_dir):
    return rounded(forecast.forecast_all(clean15(spark, sf_dir), CHANNELS)[0])


@query
def forecast_status(spark, sf_dir):
    return forecast.forecast_all(clean15(spark, sf_dir), [*CHANNELS, "not_there"])[1]


@lru_cache(maxsize=None)
def _line_forest(spark: SparkSession, sf_dir: str) -> forest.ForestModel:
    rows = _stored(spark, sf_dir, "forest")
    model = forest.fit_forest(rows, LINE_COLS, LINE_KEY)
    scores = materialise(forest.score_rows(model, rows, LINE_KEY), "forest-scores")
    return forest.calibrate(model, scores)


@query
def forest_nodes(spark, sf_dir):
    return rounded(_line_forest(spark, sf_dir).nodes)


@query
def forest_flags(spark, sf_dir):
    model = _line_forest(spark, sf_dir)
    scored = materialise(forest.score_rows(model, _stored(spark, sf_dir, "forest"), LINE_KEY), "forest-scores")
    return rounded(forest.flag_scores(model, scored))


@query
def forest_inference(spark, sf_dir):
    path = scratch(spark, "forest")
    _line_forest(spark, sf_dir).save(path)
    detector = workflow.ForestDetector().load(spark, path)
    return rounded(detector.infer(table(spark, sf_dir, "lineitem"), LINE_KEY))


@query
def window_model_scores(spark, sf_dir):
    clean = clean15(spark, sf_dir).na.fill(0.0, CHANNELS)
    scaled, _ = scaling.scale_features(clean, CHANNELS)
    cfg = WindowModelConfig(sequence_length=WINDOW, latent_dim=8)
    series = SeriesConfig(vitals=tuple(CHANNELS))
    return rounded(workflow.WindowDetector(cfg, series).run(scaled, clean))


@query
def window_error_of_zero(spark, sf_dir):
    """The error of a model passed in as a function: here one that answers 0 everywhere."""
    filled = clean15(spark, sf_dir).na.fill(0.0, CHANNELS)
    return rounded(reconstruct.score_windows(filled, CHANNELS, WINDOW, np.zeros_like, block_rows=256))


@query
def embedding_reconstruction(spark, sf_dir):
    """Vectors as windows of one row: distance from the best 8-dimensional subspace."""
    emb = table(spark, sf_dir, "embeddings")
    size, longest = emb.agg(F.min(F.size("embedding")), F.max(F.size("embedding"))).first()
    if size != longest:
        raise ValueError("vectors of unequal length")
    dims = [f"e{i}" for i in range(size)]
    rows = number_rows(emb.select("vec_id", *[F.col("embedding")[i].cast("double").alias(d) for i, d in enumerate(dims)]), (), "vec_id")
    cfg = WindowModelConfig(sequence_length=1, latent_dim=8)
    model = reconstruct.fit_windows(rows, dims, cfg)
    return rounded(reconstruct.score_windows(rows, dims, 1, model.reconstruct, carry=["vec_id"]))


@query
def stream_scoring(spark, sf_dir):
    model = _line_forest(spark, sf_dir)
    path, state = scratch(spark, "scored"), scratch(spark, "state")
    src = f"{sf_dir}/lineitem.parquet"
    stream = spark.readStream.schema(spark.read.parquet(src).schema).parquet(f"{sf_dir}/lineitem*.parquet")
    start_scoring(model, stream, LINE_KEY, path, state, tasks=spark.sparkContext.defaultParallelism).awaitTermination()
    return rounded(read_table(spark, path))


@query
def full_run(spark, sf_dir):
    settings = Settings(
        series=SeriesConfig(vitals=tuple(CHANNELS)),
        clean=CleanConfig({"ts": "timestamp"}, LIMITS, "15min", 10),
        features=FeatureConfig(),
        forecast=ForecastConfig(target="click"),
        forest=ForestConfig(),
        windows=WindowModelConfig(),
        ensemble=EnsembleConfig(),
    )
    raw = channels(spark, sf_dir).withColumnRenamed("timestamp", "ts")
    return workflow.run_all(raw, settings).comparison
