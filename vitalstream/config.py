"""Parameters of every stage, as frozen dataclasses."""

from __future__ import annotations

from dataclasses import dataclass, field

# Measurement names, raw column names, plausible limits and
# clinical reference ranges of the vital-sign data set.
VITALS = ("heart_rate", "spo2", "resp_rate", "temperature", "systolic_bp", "diastolic_bp")
COLUMN_MAPPING = {
    "Heart Rate": "heart_rate",
    "Respiratory Rate": "resp_rate",
    "Body Temperature": "temperature",
    "Oxygen Saturation": "spo2",
    "Systolic Blood Pressure": "systolic_bp",
    "Diastolic Blood Pressure": "diastolic_bp",
    "Patient ID": "patient_id",
    "Timestamp": "timestamp",
}
LIMITS = {
    "heart_rate": (20, 250),
    "spo2": (50, 100),
    "resp_rate": (4, 60),
    "temperature": (30, 42),
    "systolic_bp": (60, 220),
    "diastolic_bp": (30, 140),
}
CLINICAL_RANGES = {
    "heart_rate": (60, 100),
    "spo2": (95, 100),
    "resp_rate": (12, 20),
    "temperature": (36.1, 37.2),
    "systolic_bp": (90, 120),
    "diastolic_bp": (60, 80),
}


@dataclass(frozen=True)
class SeriesConfig:
    """What a series is. Empty ``keys`` means one global series."""

    vitals: tuple[str, ...] = VITALS
    keys: tuple[str, ...] = ()
    timestamp: str = "timestamp"
    # Rows per block of the time axis: the unit of parallelism inside a series.
    block_rows: int = 4096


@dataclass(frozen=True)
class CleanConfig:
    column_mapping: dict = field(default_factory=lambda: dict(COLUMN_MAPPING))
    limits: dict = field(default_factory=lambda: dict(LIMITS))
    freq: str = "1min"
    max_gap: int = 10


@dataclass(frozen=True)
class FeatureConfig:
    windows: tuple[int, ...] = (5, 15, 60)
    lags: tuple[int, ...] = (1, 5, 15)
    scaler: str = "standard"
    null_policy: str = "zero"


@dataclass(frozen=True)
class ForecastConfig:
    target: str = "heart_rate"
    train_split: float = 0.8
    changepoint_prior_scale: float = 0.05
    n_changepoints: int = 25
    fourier_order: int = 4
    interval_width: float = 0.80
    z_thresh: float = 3.0


@dataclass(frozen=True)
class ForestConfig:
    train_split: float = 0.8
    n_estimators: int = 200
    max_samples: int = 256
    contamination: float = 0.05
    random_state: int = 42


@dataclass(frozen=True)
class WindowModelConfig:
    sequence_length: int = 60
    train_split: float = 0.8
    latent_dim: int = 32
    threshold_multiplier: float = 3.0
    # "exact" hands on (length x columns)^2 numbers per task, "sketch" (length x columns) x (latent_dim + oversample).
    solver: str = "exact"
    oversample: int = 10
    max_passes: int = 40


@dataclass(frozen=True)
class EnsembleConfig:
    models: tuple[str, ...] = ("prophet", "if", "lstm")
    min_votes: int = 2
    # Which flag of the forecast votes: "interval" or "residual".
    forecast_flag: str = "interval"


@dataclass(frozen=True)
class Settings:
    series: SeriesConfig = SeriesConfig()
    clean: CleanConfig = field(default_factory=CleanConfig)
    features: FeatureConfig = FeatureConfig()
    forecast: ForecastConfig = ForecastConfig()
    forest: ForestConfig = ForestConfig()
    windows: WindowModelConfig = WindowModelConfig()
    ensemble: EnsembleConfig = EnsembleConfig()
