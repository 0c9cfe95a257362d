"""Metrics, KPI and top-N tables over detector results."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from vitalstream.operators.split import filter_split
from vitalstream.sources.tables import materialise


def forecast_metrics(result: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return result.groupBy(*by, "split").agg(
        F.avg(F.abs("residual")).alias("mae"),
        F.sqrt(F.avg(F.col("residual") * F.col("residual"))).alias("rmse"),
        F.avg("anomaly").alias("anomaly_rate"),
    )


def forest_metrics(result: DataFrame) -> DataFrame:
    return result.groupBy("split").agg(
        F.avg("anomaly").alias("anomaly_rate"), F.avg("anomaly_score").alias("mean_score"),
        F.count(F.lit(1)).alias("n"),
    )


def window_metrics(result: DataFrame) -> DataFrame:
    return result.groupBy("split").agg(
        F.avg("anomaly").alias("anomaly_rate"), F.avg("mse").alias("mean_mse"), F.max("mse").alias("max_mse"),
        F.count(F.lit(1)).alias("n"),
    )


def kpis(results: Mapping[str, DataFrame], split: str = "all", flags: Mapping[str, str] | None = None) -> DataFrame:
    """One row per model: rows, flagged, rate, and where the result has them mean score, MAE, threshold."""
    rows = []
    for name, df in results.items():
        hit = (flags or {}).get(name, "anomaly")
        score = next((c for c in ("anomaly_score", "mse") if c in df.columns), None)
        none = F.lit(None).cast("double")
        rows.append(filter_split(df, split).agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.coalesce(F.sum(hit), F.lit(0)).cast("bigint").alias("n_flagged"), F.avg(hit).alias("rate"),
            (F.avg(score) if score else none).alias("mean_score"),
            (F.avg(F.abs("residual")) if "residual" in df.columns else none).alias("mae"),
            (F.max("threshold") if "threshold" in df.columns else none).alias("threshold"),
        ).select(F.lit(name).alias("model"), "*"))
    return reduce(DataFrame.unionByName, rows)


def flags_equal(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: whether two flag columns agree on every row."""
    return df.agg(F.bool_and(F.col(a).eqNullSafe(F.col(b))).alias("identical"))


def top_scores(df: DataFrame, n: int, score: str, columns: Sequence[str], ts: str = "timestamp",
               only_flagged: bool = False) -> DataFrame:
    """Highest scores first; equal scores in time order."""
    rows = df.where(F.col("anomaly") == 1) if only_flagged else df
    picked = list(dict.fromkeys([ts, score, *columns]))
    return rows.select(*picked).orderBy(F.col(score).desc(), ts).limit(n)


def sample_rows(df: DataFrame, n: int, key: Sequence[str], order: Sequence[str], seed: int = 42) -> DataFrame:
    """A repeatable random sample of at most ``n`` rows, in ``order``: those with the least MD5 of key and seed."""
    return df.orderBy(F.md5(F.concat_ws("|", *key, F.lit(seed))), *key).limit(n).orderBy(*order)


def head(df: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    return df.orderBy(*order).limit(n)


def sorted_by_time(
    df: DataFrame, keys: Sequence[str] = (), ts: str = "timestamp", ties: Sequence[str] = ()
) -> DataFrame:
    return df.orderBy(*keys, ts, *ties)


def numbered_in_order(ordered: DataFrame, name: str) -> DataFrame:
    """The place, from 0, of each row of a sorted table in its order.

    Rows are counted per partition of the sorted table, so no task sees more than its own.
    """
    at = F.monotonically_increasing_id()
    placed = materialise(ordered.withColumn("__at", at), "ordered").withColumn("__part", F.shiftright("__at", 33))
    counts = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("__part", F.coalesce(before, F.lit(0)).alias("__before"))
    place = F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.join(counts, "__part").withColumn(name, place).drop("__at", "__part", "__before")
