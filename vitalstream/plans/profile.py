"""Data profiles and distributions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from vitalstream.functions.flags import flag, outside
from vitalstream.functions.quantiles import EXACT_ROWS, exact_quantiles
from vitalstream.functions.summary import attach, join_on, long_rows, q
from vitalstream.operators.blocks import spread


def overview(df: DataFrame, ts: str = "timestamp", key: str | None = None) -> DataFrame:
    """One row: rows, first and last time, length in seconds, number of keys."""
    seconds = F.timestamp_diff("SECOND", F.min(ts), F.max(ts))
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"),
        seconds.alias("duration_s"),
        *([F.count_distinct(key).alias("n_keys")] if key else []),
    )


def describe(df: DataFrame, cols: Sequence[str], digits: int | None = 2, exact_rows: int = EXACT_ROWS) -> DataFrame:
    """Long table ``column, n_null, count, mean, std, min, q25, q50, q75, max``, rounded to ``digits``."""
    long = melt(df, cols)
    base = long.groupBy("column").agg(
        F.count_if(F.col("value").isNull()).alias("n_null"), F.count("value").alias("count"),
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"),
    )
    cuts = quantile_columns(long, ["column"], {"q25": 0.25, "q50": 0.5, "q75": 0.75}, exact_rows)
    out = base.join(cuts, "column", "left")
    stats = ["mean", "std", "min", "q25", "q50", "q75", "max"]
    shown = stats if digits is None else [F.round(c, digits).alias(c) for c in stats]
    return out.select("column", "n_null", "count", *shown)


def melt(df: DataFrame, cols: Sequence[str], ids: Sequence[str] = ()) -> DataFrame:
    """``ids..., column, value`` with values as doubles."""
    doubles = df.select(*ids, *[F.col(c).cast("double").alias(c) for c in cols])
    return doubles.unpivot(list(ids), list(cols), "column", "value")


def quantile_columns(long: DataFrame, by: Sequence[str], probs: Mapping[str, float],
                     exact_rows: int = EXACT_ROWS) -> DataFrame:
    """Exact quantiles of ``value`` with one column per probability."""
    cuts = exact_quantiles(long, "value", list(probs.values()), by, exact_rows)
    return cuts.groupBy(*by).agg(*[
        F.max(F.when(F.col("prob") == F.lit(float(p)), F.col("value"))).alias(n) for n, p in probs.items()
    ])


def key_counts(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def distinct_total(df: DataFrame, key: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(key).alias("n_distinct"))


def correlations(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pearson correlation of all column pairs (pairwise complete), in one pass.

    A task keeps four matrices over the pairs (rows that have both values, mean and squared
    deviations of the first, co-deviation), taken from a batch by matrix products with the null mask. Batches and tasks
    are merged without subtracting sums. A pair without rows or with a constant is null, one with a NaN is NaN.
    """
    size = len(cols)
    values = df.select(F.array(*[F.col(q(c)).cast("double") for c in cols]).alias("v"))

    def summed(batches):
        total = None
        for batch in batches:
            flat = batch.column("v").flatten()
            held = np.asarray(flat.is_valid()).reshape(-1, size)
            x = flat.fill_null(0.0).to_numpy(zero_copy_only=False).reshape(-1, size)
            total = _merged_moments(total, _pair_moments(x, held))
        if total is not None:
            yield pa.RecordBatch.from_pydict({"moments": pa.array([total.ravel()], pa.list_(pa.float64()))})

    def merged(table: pa.Table) -> pa.Table:
        total = None
        for row in table.column("moments").chunks:
            for one in row:
                total = _merged_moments(total, one.values.to_numpy().reshape(5, size, size))
        return pa.table({"moments": pa.array([total.ravel()], pa.list_(pa.float64()))})

    parts = spread(values).mapInArrow(summed, "moments array<double>")
    # Two levels, so that the last task merges 64 sums and not one per task.
    for group in (F.pmod(F.spark_partition_id(), F.lit(64)), F.lit(0)):
        parts = parts.groupBy(group.alias("g")).applyInArrow(merged, "moments array<double>")

    def pairs(batches):
        for batch in batches:
            for row in batch.column("moments"):
                n, _, squares, together, nan = row.values.to_numpy().reshape(5, size, size)
                root = np.sqrt(squares * squares.T)
                with np.errstate(divide="ignore", invalid="ignore"):
                    r = np.where(np.eye(size, dtype=bool), 1.0, together / root)
                some = (n > 0) & (root > 0) | (nan > 0)
                r[nan > 0] = np.nan
                a, b = np.divmod(np.arange(size * size), size)
                yield pa.RecordBatch.from_arrays([
                    pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(r.ravel(), pa.float64(), mask=~some.ravel())
                ], ["a", "b", "r"])

    names = F.array(*[F.lit(c) for c in cols])
    # All pairs are listed, also those of a table without rows.
    grid = df.sparkSession.range(size * size).select(
        (F.col("id") / size).cast("int").alias("a"), F.pmod("id", F.lit(size)).cast("int").alias("b")
    )
    whole = grid.join(parts.mapInArrow(pairs, "a int, b int, r double"), ["a", "b"], "left")
    return whole.select(F.get(names, F.col("a")).alias("col_a"), F.get(names, F.col("b")).alias("col_b"), "r")


def _pair_moments(x: np.ndarray, held: np.ndarray) -> np.ndarray:
    """For columns i, j: rows with both, mean and squared deviations of i over them, co-deviation, rows with a NaN."""
    bad = held & np.isnan(x)
    fine = held & ~bad
    shift = np.where(fine, x, 0.0).sum(axis=0) / np.maximum(fine.sum(axis=0), 1)
    x, m = np.where(fine, x - shift, 0.0), fine.astype(float)
    n, total, squares, together = m.T @ m, x.T @ m, (x * x).T @ m, x.T @ x
    rows = np.maximum(n, 1)
    nan = bad.T.astype(float) @ held
    return np.stack([
        n, total / rows + shift[:, None], np.maximum(squares - total * total / rows, 0.0),
        together - total * total.T / rows, nan + nan.T,
    ])


def _merged_moments(a: np.ndarray | None, b: np.ndarray) -> np.ndarray:
    if a is None:
        return b
    n = a[0] + b[0]
    rows = np.maximum(n, 1)
    apart, share = b[1] - a[1], a[0] * b[0] / rows
    mean = np.where(a[0] == 0, b[1], a[1] + apart * b[0] / rows)
    return np.stack([n, mean, a[2] + b[2] + apart * apart * share, a[3] + b[3] + apart * apart.T * share, a[4] + b[4]])


def histogram(df: DataFrame, value: str, bins: int = 50, by: Sequence[str] = ()) -> DataFrame:
    """Equal-width bins as in numpy: ``by..., bin, left, right, n, density``.

    The last bin is closed; empty bins are listed. With ``by`` every group has
    its own range. If all values are equal the range is widened by 0.5.
    """
    keys = [f"__key_{i}" for i in range(len(by))]
    named = [F.col(q(c)).alias(k) for c, k in zip(by, keys)]
    rows = df.select(*named, F.col(q(value)).cast("double").alias("v")).where(F.col("v").isNotNull())
    lo, hi = F.min("v"), F.max("v")
    same = lo == hi
    bounds = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"),
        F.when(same, lo - 0.5).otherwise(lo).alias("lo"), F.when(same, hi + 0.5).otherwise(hi).alias("hi"),
    )
    step = (F.col("hi") - F.col("lo")) / bins
    guess = F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))
    # A value within rounding of an edge is put on the side its edge says.
    fixed = (
        F.when(F.col("v") < F.col("lo") + F.col("guess") * step, F.col("guess") - 1)
        .when((F.col("v") >= F.col("lo") + (F.col("guess") + 1) * step) & (F.col("guess") < bins - 1), F.col("guess") + 1)
        .otherwise(F.col("guess"))
    )
    counted = (
        attach(rows, bounds, keys).withColumn("guess", guess).withColumn("bin", fixed.cast("int"))
        .groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"))
    )
    # A group without values (the whole table, then) has no bins.
    grid = bounds.where(F.col("total") > 0).withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return join_on(grid, counted, [*keys, "bin"], "left").select(
        *[F.col(k).alias(c) for c, k in zip(by, keys)], "bin", (F.col("lo") + F.col("bin") * step).alias("left"),
        (F.col("lo") + (F.col("bin") + 1) * step).alias("right"),
        F.coalesce("n", F.lit(0)).cast("bigint").alias("n"),
        (F.coalesce("n", F.lit(0)) / (F.col("total") * step)).alias("density"),
    )


def box_stats(df: DataFrame, cols: Sequence[str], by: str = "anomaly", exact_rows: int = EXACT_ROWS) -> DataFrame:
    """Quartiles, whiskers (furthest value within 1.5 IQR) and outliers per group and column.

    The group keeps its column's name, or is called ``group`` where that is a name of the result.
    """
    long = melt(df.withColumn("__group", F.col(q(by))), cols, ["__group"]).where(F.col("value").isNotNull())
    keys = ["__group", "column"]
    box = quantile_columns(long, keys, {"q1": 0.25, "median": 0.5, "q3": 0.75}, exact_rows)
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = F.col("value").between(F.col("q1") - reach, F.col("q3") + reach)
    out = attach(long, box, keys).groupBy(*keys, "q1", "median", "q3").agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.when(inside, F.col("value"))).alias("whisker_lo"),
        F.max(F.when(inside, F.col("value"))).alias("whisker_hi"),
        F.count_if(~inside).alias("n_outliers"),
    )
    return out.withColumnRenamed("__group", "group" if by.lower() in out.columns else by)


def value_counts(df: DataFrame, c: str) -> DataFrame:
    """Count and share per value; the value keeps its column's name, ``n`` and ``share`` follow.

    A column that is itself called ``n`` or ``share`` comes back as ``value``.
    """
    counts = df.select(F.col(q(c)).alias("__value")).where("__value IS NOT NULL").groupBy("__value").agg(
        F.count(F.lit(1)).alias("__n")
    )
    name = "value" if c.lower() in ("n", "share") else c
    return attach(counts, counts.agg(F.sum("__n").alias("__total"))).select(
        F.col("__value").alias(name), F.col("__n").alias("n"), (F.col("__n") / F.col("__total")).alias("share")
    )


def clinical_deviation(
    df: DataFrame, ranges: Mapping[str, tuple[float, float]], only_flagged: bool = True
) -> DataFrame:
    """Rows with ``<vital>_outside`` flags and ``n_vitals_outside_range``."""
    rows = df.where(F.col("anomaly") == 1) if only_flagged else df
    present = [v for v in ranges if v in df.columns]
    rows = rows.withColumns({f"{v}_outside": flag(outside(v, *ranges[v])) for v in present})
    total: Column = reduce(add, [F.col(f"{v}_outside") for v in present])
    return rows.withColumn("n_vitals_outside_range", total)


def above_median_share(df: DataFrame, cols: Sequence[str], exact_rows: int = EXACT_ROWS) -> DataFrame:
    """Per column: share of flagged rows above the column's overall median; 0 without flags."""
    long = melt(df, cols, ["anomaly"])
    medians = quantile_columns(long, ["column"], {"median": 0.5}, exact_rows)
    above = F.coalesce(F.col("value") > F.col("median"), F.lit(False)).cast("int")
    return attach(long, medians, ["column"]).groupBy("column").agg(
        F.first("median").alias("median"),
        F.coalesce(F.avg(F.when(F.col("anomaly") == 1, above)), F.lit(0.0)).alias("rate"),
    )


def mean_shift(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """|mean of flagged rows - mean of all rows| per column; 0 without flags."""
    wide = df.agg(
        F.count_if(F.col("anomaly") == 1).alias("n_flagged"),
        *[a for i, c in enumerate(cols) for a in (
            F.avg(c).alias(f"all{i}"), F.avg(F.when(F.col("anomaly") == 1, F.col(c))).alias(f"hit{i}"))],
    )
    return long_rows(wide, [], [
        {"column": F.lit(c), "deviation":
            F.when(F.col("n_flagged") == 0, F.lit(0.0)).otherwise(F.abs(F.col(f"hit{i}") - F.col(f"all{i}")))}
        for i, c in enumerate(cols)
    ])


def quantile_table(df: DataFrame, c: str, probs: Sequence[float], exact_rows: int = EXACT_ROWS) -> DataFrame:
    return exact_quantiles(df, c, probs, exact_rows=exact_rows)


def first_test_time(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    """Time of the first test row."""
    return df.agg(F.min(F.when(F.col("split") == "test", F.col(ts))).alias("boundary"))


