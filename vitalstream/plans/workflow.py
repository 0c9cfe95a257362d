"""Detectors and the end-to-end run, from raw readings to ensemble votes."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, Row, SparkSession, functions as F

from vitalstream.config import ForecastConfig, ForestConfig, SeriesConfig, Settings, WindowModelConfig
from vitalstream.operators import clean as cleaning
from vitalstream.operators import ensemble, features, forecast, forest, reconstruct, scaling
from vitalstream.operators.blocks import POS
from vitalstream.operators.split import label_split
from vitalstream.operators.windows import build_windows
from vitalstream.plans import report
from vitalstream.plans.report import sorted_by_time
from vitalstream.plans.store import RunStore, fingerprint
from vitalstream.sources.tables import materialise


@dataclass
class ForecastDetector:
    """Forecast of one target; flags values outside the interval and large residuals."""

    cfg: ForecastConfig = ForecastConfig()
    series: SeriesConfig = SeriesConfig()
    model: DataFrame | None = None

    def _numbered(self, clean: DataFrame) -> DataFrame:
        keys = list(self.series.keys)
        cleaning.require_columns(clean, [self.series.timestamp, self.cfg.target])
        rows = clean.select(
            *keys, *([POS] if POS in clean.columns else []), F.col(self.series.timestamp).alias("ds"),
            F.col(self.cfg.target).cast("double").alias("y"),
        ).dropna("any", subset=["y"])
        numbered = forecast.number_series(rows, self.cfg.train_split, keys, self.series.block_rows)
        return materialise(numbered, "series")

    def _fit(self, numbered: DataFrame) -> None:
        fitted = forecast.fit_forecast(numbered, self.cfg, self.series.keys)
        self.model = materialise(fitted, "forecast-model")

    def fit(self, clean: DataFrame) -> "ForecastDetector":
        self._fit(self._numbered(clean))
        return self

    def score(self, clean: DataFrame) -> DataFrame:
        if self.model is None:
            raise RuntimeError("no forecast model: call fit or load first")
        return forecast.forecast_and_flag(self._numbered(clean), self.model, self.cfg, self.series.keys)

    def run(self, clean: DataFrame) -> DataFrame:
        numbered = self._numbered(clean)
        self._fit(numbered)
        return forecast.forecast_and_flag(numbered, self.model, self.cfg, self.series.keys)

    def save(self, path: str) -> None:
        if self.model is None:
            raise RuntimeError("no forecast model: call fit or load first")
        forecast.save_forecast(self.model, path)

    def load(self, spark: SparkSession, path: str) -> "ForecastDetector":
        self.model = forecast.load_forecast(spark, path)
        return self


@dataclass
class ForestDetector:
    """Isolation forest over the scaled feature table."""

    cfg: ForestConfig = ForestConfig()
    series: SeriesConfig = SeriesConfig()
    model: forest.ForestModel | None = None
    scored: DataFrame | None = None

    def fit(self, table: DataFrame, columns: list[str]) -> "ForestDetector":
        keys, ts = list(self.series.keys), self.series.timestamp
        labelled = label_split(table, self.cfg.train_split, keys)
        train = labelled.where(F.col("split") == "train")
        model = forest.fit_forest(train, columns, [*keys, POS], self.cfg)
        self.scored = materialise(forest.score_rows(model, labelled, [*keys, POS, ts, "split"]), "forest-scores")
        self.model = forest.calibrate(model, self.scored.where(F.col("split") == "train"))
        return self

    def score(self, table: DataFrame, clean: DataFrame) -> DataFrame:
        """Flag a feature table; measurements come from ``clean`` in their own units."""
        model = self._fitted()
        keys, ts = list(self.series.keys), self.series.timestamp
        scored = materialise(forest.score_rows(model, table, [*keys, POS, ts]), "forest-scores")
        return self._result(scored, clean)

    def run(self, table: DataFrame, columns: list[str], clean: DataFrame) -> DataFrame:
        self.fit(table, columns)
        return self._result(self.scored.drop("split"), clean)

    def infer(self, rows: DataFrame, keep: list[str], normalise: str = "model") -> DataFrame:
        """Score any rows that have the feature columns."""
        model = self._fitted()
        return forest.flag_scores(model, forest.score_rows(model, rows, keep), normalise)

    def _result(self, scored: DataFrame, clean: DataFrame) -> DataFrame:
        flagged = forest.flag_scores(self._fitted(), scored)
        return forest.forest_result(
            flagged, clean, self.series.vitals, self.cfg.train_split, self.series.keys, self.series.timestamp
        )

    def _fitted(self) -> forest.ForestModel:
        if self.model is None:
            raise RuntimeError("no forest model: call fit or load first")
        return self.model

    def save(self, path: str) -> None:
        self._fitted().save(path)

    def load(self, spark: SparkSession, path: str) -> "ForestDetector":
        self.model = forest.ForestModel.load(spark, path)
        return self


@dataclass
class WindowDetector:
    """Reconstruction error of sliding windows over the scaled measurements."""

    cfg: WindowModelConfig = WindowModelConfig()
    series: SeriesConfig = SeriesConfig()
    model: reconstruct.WindowModel | None = None
    custom: Callable[[np.ndarray], np.ndarray] | None = None

    def _columns(self, table: DataFrame) -> list[str]:
        return [v for v in self.series.vitals if v in table.columns]

    def fit(self, table: DataFrame) -> "WindowDetector":
        self.model = reconstruct.fit_windows(
            table, self._columns(table), self.cfg, self.series.keys, self.series.block_rows
        )
        return self

    def score(self, table: DataFrame, clean: DataFrame) -> DataFrame:
        if self.model is None and self.custom is None:
            raise RuntimeError("no window model: call fit or load first, or pass a reconstruct function")
        rebuild = self.custom or self.model.reconstruct
        keys = self.series.keys
        scores = materialise(
            reconstruct.score_windows(
                table, self._columns(table), self.cfg.sequence_length, rebuild, keys, self.series.block_rows,
                carry=[self.series.timestamp],
            ),
            "window-scores",
        )
        flagged = reconstruct.flag_windows(
            scores, self.cfg.threshold_multiplier, self.cfg.sequence_length, self.cfg.train_split, keys
        )
        return reconstruct.window_result(flagged, clean, keys, self.series.timestamp)

    def run(self, table: DataFrame, clean: DataFrame) -> DataFrame:
        return self.fit(table).score(table, clean)

    def save(self, spark: SparkSession, path: str) -> None:
        if self.model is None:
            raise RuntimeError("no window model: call fit or load first")
        self.model.save(spark, path)

    def load(self, spark: SparkSession, path: str) -> "WindowDetector":
        self.model = reconstruct.WindowModel.load(spark, path)
        return self


@dataclass
class Outcome:
    clean: DataFrame
    features: DataFrame
    feature_columns: list[str]
    scaler: list[Row]
    results: dict[str, DataFrame] = field(default_factory=dict)
    comparison: DataFrame | None = None
    reports: dict[str, DataFrame] = field(default_factory=dict)


def run_preprocess(raw: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Raw readings to the clean table."""
    named, _ = cleaning.rename_columns(raw, s.clean.column_mapping)
    parsed = cleaning.nan_to_null(cleaning.parse_timestamps(named, s.series.timestamp))
    clean = cleaning.clean(
        parsed, s.series.vitals, s.clean.limits, s.clean.freq, s.clean.max_gap,
        s.series.keys, s.series.timestamp, s.series.block_rows,
    )
    # Without keys all readings are one stream, whatever ids they came with.
    return clean if s.series.keys else cleaning.single_stream(clean)


def run_features(clean: DataFrame, s: Settings = Settings()) -> tuple[DataFrame, list[str], list[Row]]:
    """Clean table to the scaled feature table, its feature columns and the scaler."""
    wide, columns = features.build_features(
        clean, s.series.vitals, s.features.windows, s.features.lags, s.series.keys,
        s.series.timestamp, s.features.null_policy, s.series.block_rows,
    )
    kept = materialise(wide.drop("still_missing"), "features")
    if kept.isEmpty():
        raise RuntimeError("no rows left after feature engineering")
    columns = [c for c in columns if c in kept.columns]
    scaled, scaler = scaling.scale_features(kept, columns, s.features.scaler)
    return scaled, columns, scaler


def run_ensemble(results: dict[str, DataFrame], s: Settings = Settings()) -> DataFrame:
    """Votes of the wanted models; of the forecast the flag that the settings name."""
    known = {"interval": "anomaly", "residual": "anomaly_residual"}
    if s.ensemble.forecast_flag not in known:
        raise ValueError(f"unknown flag of the forecast: {s.ensemble.forecast_flag!r}")
    chosen = known[s.ensemble.forecast_flag]
    voting = {
        m: df.withColumn("anomaly", F.col(chosen)) if m == "prophet" and chosen != "anomaly" else df
        for m, df in results.items()
    }
    merged = ensemble.align_results(voting, s.series.keys, s.series.timestamp)
    return ensemble.add_votes(merged, list(results), s.ensemble.min_votes)


def run_all(
    raw: DataFrame, s: Settings = Settings(), out_dir: str | None = None, resume: bool = False, store_windows: bool = False,
    reports: bool | None = None,
) -> Outcome:
    """Every stage, with the models that the settings name.

    Tables, models and, if wanted (by default where there is an ``out_dir``), reports are stored below ``out_dir`` (or a
    folder of the run in the shared folder), each once, and the outcome reads them. At full width these are the clean table, the features
    before and after scaling, a result per model and the comparison; intermediate tables are deleted at the end. A run that was
    cut off goes on with ``resume=True``: complete tables and models are read, the rest is made.
    """
    spark = raw.sparkSession
    unknown = set(s.ensemble.models) - {"prophet", "if", "lstm"}
    if unknown or not s.ensemble.models:
        raise ValueError(f"unknown models: {sorted(unknown)}" if unknown else "no models")
    keys, ts = s.series.keys, s.series.timestamp
    store = RunStore(spark, out_dir, fingerprint(raw, s), resume)
    with store.steps():
        clean = store.table("clean", lambda: run_preprocess(raw, s))
        if not (store.complete("features") and store.complete("scaler")):
            table, columns, scaler = run_features(clean, s)
            scaling.save_scaler(spark, scaler, store.path("scaler"))
            store.put("features", table)
        table, scaler = store.table("features", lambda: table), scaling.load_scaler(spark, store.path("scaler"))
        scaler = sorted(scaler, key=lambda r: table.columns.index(r["feature"]))
        out = Outcome(clean, table, [r["feature"] for r in scaler], scaler)
        if store_windows:
            vitals = [v for v in s.series.vitals if v in table.columns]
            store.table("windows", lambda: build_windows(table, vitals, s.windows.sequence_length, keys, ts, s.series.block_rows))
        make = {"prophet": _forecast_result, "if": _forest_result, "lstm": _window_result}
        for name in s.ensemble.models:
            out.results[name] = store.table(f"results/{name}", lambda name=name: make[name](store, out, s))
        out.comparison = store.table(
            "results/comparison", lambda: sorted_by_time(run_ensemble(out.results, s), keys, ts)
        )
        if bool(out_dir) if reports is None else reports:
            out.reports = {name: store.table(f"reports/{name}", made) for name, made in _reports(raw, out, s).items()}
    return out


def _forecast_result(store: RunStore, out: Outcome, s: Settings) -> DataFrame:
    detector, path = ForecastDetector(s.forecast, s.series), "models/forecast"
    if store.complete(path):
        found = detector.load(store.spark, store.path(path)).score(out.clean)
    else:
        found = detector.run(out.clean)
        detector.save(store.path(path))
    return found.withColumnRenamed("ds", s.series.timestamp)


def _forest_result(store: RunStore, out: Outcome, s: Settings) -> DataFrame:
    detector = ForestDetector(s.forest, s.series)
    found = detector.run(out.features, out.feature_columns, out.clean)
    detector.save(store.path("models/forest"))
    return found


def _window_result(store: RunStore, out: Outcome, s: Settings) -> DataFrame:
    detector = WindowDetector(s.windows, s.series).fit(out.features)
    detector.save(store.spark, store.path("models/windows"))
    return detector.score(out.features, out.clean)


def _reports(raw: DataFrame, out: Outcome, s: Settings) -> dict[str, Callable[[], DataFrame]]:
    """The reports of a run: limits, features, metrics of each model by split, rates, agreement."""
    named, _ = cleaning.rename_columns(raw, s.clean.column_mapping)
    models = list(out.results)
    made = {
        "limits": lambda: cleaning.limit_counts(cleaning.nan_to_null(named), s.clean.limits),
        "features": lambda: features.sanity_report(out.features, out.feature_columns),
        "rates": lambda: ensemble.rates_by_split(out.comparison, models),
        "kpis": lambda: report.kpis(out.results),
    }
    if len(models) > 1:
        made["agreement"] = lambda: ensemble.pairwise_agreement(out.comparison, models)
    metrics = {"prophet": report.forecast_metrics, "if": report.forest_metrics, "lstm": report.window_metrics}
    return made | {f"metrics-{m}": lambda m=m: metrics[m](out.results[m]) for m in models}
