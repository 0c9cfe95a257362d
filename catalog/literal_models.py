"""Detectors whose model is literal or has a closed form, as queries with SQL counterparts.

A literal forest and literal coefficients check scoring, thresholds, storage and
streams; a forecast of trend alone and a window model of one row and two columns check the fits.
"""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import DataFrame, SparkSession, functions as F

from catalog import oracle
from catalog.oracle import r
from catalog.spark_queries import (
    CHANNELS, LIMITS, LINE_COLS, LINE_KEY, _line_forest, channels, clean15, rounded, scratch, table,
)
from vitalstream.config import (
    CleanConfig, EnsembleConfig, FeatureConfig, ForecastConfig, SeriesConfig, Settings, WindowModelConfig,
)
from vitalstream.functions.summary import attach
from vitalstream.functions.timeline import micros
from vitalstream.operators import forecast, forest, scaling
from vitalstream.operators.blocks import POS
from vitalstream.plans import workflow
from vitalstream.sources.tables import materialise, read_table
from vitalstream.streaming.score import start_scoring

QUERIES, ORACLES = {}, {}
Z80 = NormalDist().inv_cdf(0.9)
DAY_US = oracle.DAY


def query(sql: str):
    def add(fn):
        QUERIES[fn.__name__], ORACLES[fn.__name__] = fn, sql
        return fn

    return add


# --- forest ------------------------------------------------------------------

SAMPLES, DEPTH = 8, 2
#: Fixed trees over ``LINE_COLS``: slot -> (feature, threshold, rows) or, for a leaf, its rows.
TREES = [
    {0: (0, 24.5, 8), 1: (1, 20000.0, 5), 2: 3, 3: 4, 4: 1},
    {0: (2, 0.045, 8), 1: 2, 2: (3, 0.035, 6), 5: 1, 6: 5},
    {0: (1, 40000.0, 8), 1: (0, 10.5, 4), 2: (3, 0.075, 4), 3: 1, 4: 3, 5: 2, 6: 2},
]


def _depth(slot: int) -> int:
    return (slot + 1).bit_length() - 1


def _literal_forest(spark: SparkSession) -> forest.ForestModel:
    nodes = [
        (t, slot, node[0], node[1], None, node[2], _depth(slot)) if isinstance(node, tuple)
        else (t, slot, -1, None, _depth(slot) + forest.path_correction(node), node, _depth(slot))
        for t, tree in enumerate(TREES) for slot, node in tree.items()
    ]
    return forest.ForestModel(LINE_COLS, spark.createDataFrame(nodes, forest.NODE_SCHEMA), DEPTH, SAMPLES, 0.05)


def _calibrated(spark: SparkSession, sf_dir: str) -> forest.ForestModel:
    """Threshold and range from the lines that were not returned, after a way through stored tables."""
    lines = table(spark, sf_dir, "lineitem").where("l_returnflag <> 'R'")
    model = _literal_forest(spark)
    model = forest.calibrate(model, materialise(forest.score_rows(model, lines, ["l_orderkey"]), "literal-scores"))
    path = scratch(spark, "literal-forest")
    model.save(path)
    return workflow.ForestDetector().load(spark, path).model


def _path_sql(tree: dict, slot: int = 0) -> str:
    node = tree[slot]
    if not isinstance(node, tuple):
        return repr(_depth(slot) + float(forest.path_correction(node)))
    left, right = (_path_sql(tree, 2 * slot + k) for k in (1, 2))
    return f"CASE WHEN {LINE_COLS[node[0]]} > {node[1]}::DOUBLE THEN {right} ELSE {left} END"


LINES = f"""WITH raw AS (
    SELECT *, CASE WHEN {' OR '.join(f'{c} IS NULL' for c in LINE_COLS)} THEN NULL ELSE
      pow(2::DOUBLE, -({' + '.join(f'({_path_sql(t)})::DOUBLE' for t in TREES)}) / 3 / {float(forest.path_correction(SAMPLES))!r}::DOUBLE) END AS raw_score
    FROM lineitem),
  train AS (SELECT quantile_cont(raw_score, 0.95) AS cut, min(raw_score) AS lo, max(raw_score) AS hi FROM raw WHERE l_returnflag <> 'R'),
  span AS (SELECT min(raw_score) AS alo, max(raw_score) AS ahi FROM raw)
  SELECT {', '.join(LINE_KEY)}, {r('raw_score', 'raw_score')},
    CASE WHEN raw_score > cut THEN -1 WHEN raw_score <= cut THEN 1 END AS anomaly_if,
    CASE WHEN raw_score > cut THEN 1 WHEN raw_score <= cut THEN 0 END AS anomaly,"""
BY_MODEL = f"{LINES} {r('least(greatest((raw_score - lo) / (hi - lo + 1e-8), 0), 1)', 'anomaly_score')} FROM raw, train"


@query(f"{LINES} {r('(raw_score - alo) / (ahi - alo + 1e-8)', 'anomaly_score')} FROM raw, train, span")
def literal_forest_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = _calibrated(spark, sf_dir)
    scored = materialise(forest.score_rows(model, table(spark, sf_dir, "lineitem"), LINE_KEY), "literal-scores")
    return rounded(forest.flag_scores(model, scored))


@query(BY_MODEL)
def literal_forest_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    detector = workflow.ForestDetector(model=_calibrated(spark, sf_dir))
    return rounded(detector.infer(table(spark, sf_dir, "lineitem"), LINE_KEY))


@query(BY_MODEL)
def literal_stream_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/lineitem.parquet").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/lineitem*.parquet")
    path, state = scratch(spark, "literal-scored"), scratch(spark, "literal-state")
    model = _calibrated(spark, sf_dir)
    start_scoring(model, stream, LINE_KEY, path, state, tasks=spark.sparkContext.defaultParallelism).awaitTermination()
    return rounded(read_table(spark, path))


@query("""SELECT t.tree::INTEGER AS tree, least(256, n)::BIGINT AS root_rows, 1::BIGINT AS leaves_over_cuts, 0::BIGINT AS rows_lost,
    true AS shallow, true AS paths_right, true AS cuts_inside, true AS rows_everywhere
    FROM range(200) t(tree), (SELECT count(*) AS n FROM lineitem)""")
def forest_tree_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What holds for every grown tree: rows kept at each cut, path lengths, cuts inside the columns' ranges."""
    model = _line_forest(spark, sf_dir)
    lines = table(spark, sf_dir, "lineitem")
    ranges = lines.select(F.array(*[
        F.struct(F.min(c).cast("double").alias("lo"), F.max(c).cast("double").alias("hi")) for c in LINE_COLS
    ]).alias("ranges"))
    nodes = attach(model.nodes, ranges).withColumn("range", F.get("ranges", F.col("feature")))
    leaf, m = F.col("feature") < 0, F.col("n").cast("double")
    search = 2 * (F.log(F.greatest(m - 1, F.lit(1.0))) + F.lit(0.5772156649015329)) - 2 * (m - 1) / m
    c = F.when(m <= 1, 0.0).when(m <= 2, 1.0).otherwise(search)
    return nodes.groupBy("tree").agg(
        F.max(F.when(F.col("slot") == 0, F.col("n"))).cast("long").alias("root_rows"),
        (F.count_if(leaf) - F.count_if(~leaf)).alias("leaves_over_cuts"),
        (F.coalesce(F.sum(F.when(~leaf, F.col("n"))), F.lit(0)) - F.coalesce(F.sum(F.when(F.col("slot") > 0, F.col("n"))), F.lit(0))).alias("rows_lost"),
        F.bool_and(F.col("depth") <= 8).alias("shallow"),
        F.bool_and(~leaf | (F.abs(F.col("path") - F.col("depth") - c) < 1e-9)).alias("paths_right"),
        F.bool_and(leaf | F.col("threshold").between(F.col("range.lo"), F.col("range.hi"))).alias("cuts_inside"),
        F.bool_and(F.col("n") >= 1).alias("rows_everywhere"),
    )


# --- forecast ----------------------------------------------------------------

#: Fixed coefficients per series: scale, slope, offset, two changepoints with their deltas, two harmonics, noise.
COEFFICIENTS = {
    "click": (150.0, 0.12, 0.55, [0.3, 0.7], [0.2, -0.35], [0.03, -0.02, 0.01, 0.015], 0.11),
    "view": (120.0, -0.08, 0.6, [0.25, 0.5], [-0.1, 0.15], [-0.01, 0.04, 0.02, -0.005], 0.09),
}
LITERAL_FORECAST = ForecastConfig(n_changepoints=2, fourier_order=2)
RESULT = ["series", POS, "ds", "y", "split", "yhat", "yhat_lower", "yhat_upper", "residual", "anomaly_score", "anomaly",
          "residual_zscore", "anomaly_residual"]


def _series_sql(cols: list[str], source: str = "clean") -> str:
    union = " UNION ALL ".join(f"SELECT '{c}' AS series, \"timestamp\" AS ds, {c} AS y FROM {source} WHERE {c} IS NOT NULL" for c in cols)
    return f"""long AS ({union}),
    rows_ AS (SELECT *, epoch_us(ds) AS us, row_number() OVER (PARTITION BY series ORDER BY ds) - 1 AS pos,
        count(*) OVER (PARTITION BY series) AS m FROM long),
    rows AS (SELECT *, CASE WHEN pos < floor(m * 0.8::DOUBLE) THEN 'train' ELSE 'test' END AS split FROM rows_)"""


#: From ``banded`` (yhat and half the interval) to the flags of both kinds.
FLAGGED = f"""
    flagged AS (SELECT *, yhat - half AS yhat_lower, yhat + half AS yhat_upper, y - yhat AS residual,
        CASE WHEN half > 0 THEN abs(y - yhat) / half ELSE 0 END AS anomaly_score,
        CASE WHEN y < yhat - half OR y > yhat + half THEN 1 ELSE 0 END AS anomaly FROM banded),
    z AS (SELECT *, (residual - avg(residual) OVER (PARTITION BY series)) / stddev_samp(residual) OVER (PARTITION BY series) AS residual_zscore FROM flagged),
    forecasts AS (SELECT *, CASE WHEN abs(residual_zscore) > 3 THEN 1 ELSE 0 END AS anomaly_residual FROM z)"""
FORECASTS = f"""SELECT series, pos, ds, split, {', '.join(r(c, c) for c in RESULT if c not in ('series', POS, 'ds', 'split', 'anomaly', 'anomaly_residual'))},
    anomaly, anomaly_residual FROM forecasts"""


def _literal_band_sql() -> str:
    def one(name: str) -> str:
        scale, slope, offset, points, deltas, season, sigma = COEFFICIENTS[name]
        rate = sum(map(abs, deltas)) / len(deltas)
        hinges = " + ".join(f"({d}::DOUBLE) * greatest(t - {p}::DOUBLE, 0)" for p, d in zip(points, deltas))
        waves = " + ".join(
            f"({season[2 * k]}::DOUBLE) * sin({k + 1} * angle) + ({season[2 * k + 1]}::DOUBLE) * cos({k + 1} * angle)" for k in range(2))
        return (f"SELECT *, {scale}::DOUBLE * (({slope}::DOUBLE) * t + {offset}::DOUBLE + {hinges} + {waves}) AS yhat, "
                f"{Z80!r}::DOUBLE * {scale}::DOUBLE * sqrt({sigma}::DOUBLE * {sigma}::DOUBLE + 2 * {rate!r}::DOUBLE * {rate!r}::DOUBLE * 2 * "
                f"pow(greatest(t - 1, 0), 3) / 3) AS half FROM timed WHERE series = '{name}'")

    return f"""ends AS (SELECT series, min(us) AS t0, (max(us) - min(us)) * 0.75::DOUBLE AS span FROM rows GROUP BY series),
    timed AS (SELECT rows.*, (us - t0) / span AS t, (us % {DAY_US}) * 2 * pi() / {DAY_US} AS angle FROM rows JOIN ends USING (series)),
    banded AS ({' UNION ALL '.join(map(one, COEFFICIENTS))})"""


@query(f"WITH {oracle.CLEAN}, {_series_sql(list(COEFFICIENTS))}, {_literal_band_sql()}, {FLAGGED} {FORECASTS}")
def literal_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trend with changepoints, harmonics and widening bounds from fixed coefficients, over three quarters of the time."""
    names = ["series", "y_scale", "slope", "intercept", "changepoints", "deltas", "season", "sigma"]
    kinds = ["string", *["double"] * 3, *["array<double>"] * 3, "double"]
    fixed = spark.createDataFrame([(k, *v) for k, v in COEFFICIENTS.items()], ", ".join(map(" ".join, zip(names, kinds))))
    numbered = materialise(forecast.number_series(forecast.to_long(clean15(spark, sf_dir), list(COEFFICIENTS)), 0.8), "literal-series")
    us = micros(F.col("ds"))
    ends = numbered.groupBy("series").agg(F.min(us).alias("t0"), ((F.max(us) - F.min(us)) * 0.75).alias("span"))
    path = scratch(spark, "literal-forecast")
    forecast.save_forecast(fixed.join(ends, "series"), path)
    model = forecast.load_forecast(spark, path)
    return rounded(forecast.forecast_and_flag(numbered, model, LITERAL_FORECAST).select(*RESULT))


TREND = ForecastConfig(target="click", n_changepoints=0, fourier_order=0)
#: Trend alone: a ridge line whose noise is iterated to its fixed point, as sums per series.
TREND_FIT = f"""
    ends AS (SELECT series, min(us) AS t0, greatest(max(us) - min(us), 1)::DOUBLE AS span, max(abs(y)) AS ys, count(*) AS n
        FROM rows WHERE split = 'train' GROUP BY series),
    timed AS (SELECT rows.*, (us - t0) / span AS t, y / ys AS u, ys, n FROM rows JOIN ends USING (series)),
    sums AS (SELECT series, count(*)::DOUBLE AS n, sum(t * t) AS tt, sum(t) AS t1, sum(t * u) AS tu, sum(u) AS u1, sum(u * u) AS uu
        FROM timed WHERE split = 'train' GROUP BY series),
    steps AS (
        SELECT series, 0 AS k, greatest(uu / n, 1e-12) AS noise, 0::DOUBLE AS slope, 0::DOUBLE AS intercept FROM sums
        UNION ALL
        SELECT series, k + 1, greatest((uu - 2 * (b0 * tu + b1 * u1) + b0 * b0 * tt + 2 * b0 * b1 * t1 + b1 * b1 * n) / n, 1e-12), b0, b1
        FROM (SELECT *, (r0 * a11 - r1 * a01) / (a00 * a11 - a01 * a01) AS b0, (a00 * r1 - a01 * r0) / (a00 * a11 - a01 * a01) AS b1
            FROM (SELECT steps.series, k, sums.* EXCLUDE (series), tt / noise + 1 / 25::DOUBLE AS a00, t1 / noise AS a01,
                n / noise + 1 / 25::DOUBLE AS a11, tu / noise AS r0, u1 / noise AS r1
                FROM steps JOIN sums USING (series) WHERE k < 40))),
    fitted AS (SELECT series, slope, intercept, sqrt(noise) AS sigma FROM steps WHERE k = 40),
    banded AS (SELECT timed.*, ys * (slope * t + intercept) AS yhat, {Z80!r}::DOUBLE * ys * sigma AS half FROM timed JOIN fitted USING (series))"""


@query(f"""WITH RECURSIVE {oracle.CLEAN}, {_series_sql(CHANNELS)}, {TREND_FIT}
    SELECT series, ends.n, {r('ys', 'y_scale')}, {r('slope', 'slope')}, {r('intercept', 'intercept')}, {r('sigma', 'sigma')}, 'ok' AS status
    FROM ends JOIN fitted USING (series)""")
def trend_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = materialise(forecast.number_series(forecast.to_long(clean15(spark, sf_dir), CHANNELS), 0.8), "trend-series")
    return rounded(forecast.fit_forecast(rows, TREND).select("series", "n", "y_scale", "slope", "intercept", "sigma", "status"))


@query(f"WITH RECURSIVE {oracle.CLEAN}, {_series_sql(CHANNELS)}, {TREND_FIT}, {FLAGGED} {FORECASTS}")
def trend_every_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every channel fitted and scored in one job."""
    return rounded(forecast.forecast_all(clean15(spark, sf_dir), CHANNELS, TREND)[0].select(*RESULT))


# --- window model ------------------------------------------------------------

AXIS_CFG = WindowModelConfig(sequence_length=1, latent_dim=1, threshold_multiplier=2.0)
#: Two scaled columns: distance from the longer axis of the training rows' ellipse.
AXIS = """
    filled0 AS (SELECT pos, "timestamp", coalesce(click, 0) AS x, coalesce("view", 0) AS v FROM clean),
    scaled AS (SELECT pos, "timestamp", (x - avg(x) OVER ()) / stddev_pop(x) OVER () AS x, (v - avg(v) OVER ()) / stddev_pop(v) OVER () AS v,
        CASE WHEN pos < floor(n * 0.8::DOUBLE) THEN 'train' ELSE 'test' END AS split FROM filled0, size),
    ellipse AS (SELECT avg(x) AS mx, avg(v) AS mv, atan2(2 * covar_pop(x, v), var_pop(x) - var_pop(v)) / 2 AS th
        FROM scaled WHERE split = 'train'),
    errors AS (SELECT pos, "timestamp", split, pow((v - mv) * cos(th) - (x - mx) * sin(th), 2) / 2 AS mse FROM scaled, ellipse),
    cut AS (SELECT avg(mse) + 2 * stddev_pop(mse) AS threshold FROM errors WHERE split = 'train'),
    axis_flags AS (SELECT *, CASE WHEN mse > threshold THEN 1 ELSE 0 END AS anomaly FROM errors, cut)"""


@query(f"""WITH {oracle.CLEAN}, {AXIS}
    SELECT pos, "timestamp", split, {r('mse', 'mse')}, {r('threshold', 'threshold')}, anomaly FROM axis_flags""")
def window_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The window model of one row and two columns, fitted, stored, loaded and scored."""
    clean = clean15(spark, sf_dir).na.fill(0.0, CHANNELS)
    scaled, _ = scaling.scale_features(clean, ["click", "view"])
    series, path = SeriesConfig(vitals=("click", "view")), scratch(spark, "axis")
    workflow.WindowDetector(AXIS_CFG, series).fit(scaled).save(spark, path)
    found = workflow.WindowDetector(AXIS_CFG, series).load(spark, path).score(scaled, clean)
    return rounded(found.select(POS, "timestamp", "split", "mse", "threshold", "anomaly"))


# --- whole run ---------------------------------------------------------------

@query(f"""WITH RECURSIVE {oracle.clean(cols=['click', 'view'])}, {_series_sql(['click'])}, {TREND_FIT}, {FLAGGED}, {AXIS}
    SELECT ds AS "timestamp", f.split, f.anomaly AS anomaly_prophet, a.anomaly AS anomaly_lstm, f.anomaly + a.anomaly AS vote_count,
        CASE WHEN f.anomaly + a.anomaly >= 1 THEN 1 ELSE 0 END AS anomaly_ensemble
    FROM forecasts f JOIN axis_flags a ON f.ds = a."timestamp" """)
def run_of_two_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole run, raw readings to votes, of the two models whose fit has a closed form."""
    settings = Settings(
        series=SeriesConfig(vitals=("click", "view")), clean=CleanConfig({"ts": "timestamp"}, LIMITS, "15min", 10),
        features=FeatureConfig(), forecast=TREND, windows=AXIS_CFG, ensemble=EnsembleConfig(models=("prophet", "lstm"), min_votes=1),
    )
    raw = channels(spark, sf_dir).withColumnRenamed("timestamp", "ts").select("ts", "click", "view")
    return workflow.run_all(raw, settings).comparison
