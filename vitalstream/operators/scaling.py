"""Standard and min-max scaling with parameters kept as a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F

from vitalstream.functions.summary import long_columns, q
from vitalstream.sources.tables import require_table, write_table

SCHEMA = "feature string, kind string, center double, scale double"


def fit_scaler(
    df: DataFrame, cols: Sequence[str], kind: str = "standard", fit_where: Column | None = None
) -> list[Row]:
    """One ``(feature, kind, center, scale)`` row per column, from one aggregation.

    Standard: mean and population deviation. Min-max: minimum and range. A
    zero spread scales by 1. Empty input and nulls raise ``ValueError``.
    """
    if kind not in ("standard", "minmax"):
        raise ValueError(f"unknown scaler {kind!r}")
    if not cols:
        raise ValueError("no feature columns to scale")
    rows = df if fit_where is None else df.where(fit_where)
    center, scale = ("avg(v)", "stddev_pop(v)") if kind == "standard" else ("min(v)", "max(v) - min(v)")
    got = long_columns(rows, cols).groupBy("i").agg(
        F.expr(f"{center} AS center"), F.expr(f"{scale} AS scale"), F.expr("count_if(v IS NULL) AS missing")
    ).collect()  # one row per column
    if not got:
        raise ValueError("no rows to fit the scaler on")
    missing = sum(r["missing"] for r in got)
    if missing:
        raise ValueError(f"{missing} nulls left in the feature columns")
    return [
        Row(feature=cols[r["i"]], kind=kind, center=r["center"], scale=r["scale"] or 1.0)
        for r in sorted(got, key=lambda r: r["i"])
    ]


def apply_scaler(df: DataFrame, scaler: Sequence[Row]) -> DataFrame:
    by_name = {r["feature"]: r for r in scaler}
    return df.selectExpr(*[
        f"({q(c)} - {_double(by_name[c]['center'])}) / {_double(by_name[c]['scale'])} AS {q(c)}"
        if c in by_name else q(c)
        for c in df.columns
    ])


def _double(value: float) -> str:
    return f"CAST('{value!r}' AS DOUBLE)"


def scale_features(
    df: DataFrame, cols: Sequence[str], kind: str = "standard", save_path: str | None = None,
    fit_where: Column | None = None,
) -> tuple[DataFrame, list[Row]]:
    scaler = fit_scaler(df, cols, kind, fit_where)
    if save_path:
        save_scaler(df.sparkSession, scaler, save_path)
    return apply_scaler(df, scaler), scaler


def scaler_table(spark: SparkSession, scaler: Sequence[Row]) -> DataFrame:
    return spark.createDataFrame(list(scaler), SCHEMA)


def save_scaler(spark: SparkSession, scaler: Sequence[Row], path: str) -> None:
    write_table(scaler_table(spark, scaler).coalesce(1), path)


def load_scaler(spark: SparkSession, path: str) -> list[Row]:
    return require_table(spark, path).collect()
