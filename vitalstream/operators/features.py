"""Rolling, lag and time-of-day features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F, types as T

from vitalstream.functions.summary import long_columns, q
from vitalstream.functions.timeline import cos_time, sin_time
from vitalstream.operators.blocks import BLOCK, HALO, POS, by_block, number_rows, with_halo
from vitalstream.operators.clean import require_columns
from vitalstream.sources.tables import materialise

# Share of a window's mean below which its deviation is rounding.
ROUNDING = 1e-14

def rolling_name(c: str, kind: str, w: int) -> str:
    return f"{c}_roll_{kind}_{w}"


def lag_name(c: str, k: int) -> str:
    return f"{c}_lag_{k}"


def add_window_features(
    df: DataFrame,
    cols: Sequence[str],
    windows: Sequence[int] = (),
    lags: Sequence[int] = (),
    keys: Sequence[str] = (),
    block_rows: int = 4096,
) -> DataFrame:
    """Rolling mean and standard deviation over the last ``w`` rows, and lags.

    Frames count rows of a densely numbered series and include the current
    one; nulls, NaN and infinite values are skipped. The deviation has ddof 1
    and is 0 below two values. All columns share one shuffle and one sort.

    A window of ``w`` rows is the end of one chunk of ``w`` rows and the start of
    the next. Count, mean and squared deviations run forwards and backwards
    through every chunk and the two parts are merged, so the cost does not depend on ``w``
    and no sums are subtracted: a huge value leaves the windows without it
    untouched. A deviation within the rounding of the window's mean is 0.
    """
    require_columns(df, [*cols, *keys, POS])
    halo = max([w - 1 for w in windows] + list(lags) + [0])
    rows = by_block(with_halo(df, halo, block_rows), keys)
    group = ", ".join(q(c) for c in (*keys, BLOCK))
    spec = f"PARTITION BY {group} ORDER BY {POS}"
    rolled = [(i, w) for i in range(len(cols)) for w in dict.fromkeys(windows)]
    rows = rows.selectExpr("*", *[
        f"CASE WHEN abs({q(c)}) < double('infinity') THEN CAST({q(c)} AS DOUBLE) END AS __v{i}"
        for i, c in enumerate(cols) if windows
    ])
    for w in dict.fromkeys(windows):
        for name, way in (("__head", ""), ("__tail", "DESC")):
            upto = f"OVER (PARTITION BY {group}, {POS} DIV {w} ORDER BY {POS} {way} ROWS UNBOUNDED PRECEDING)"
            rows = rows.selectExpr("*", *[
                f"named_struct('n', count(__v{i}) {upto}, 'mean', coalesce(avg(__v{i}) {upto}, 0D), "
                f"'squares', coalesce(var_pop(__v{i}) {upto}, 0D) * count(__v{i}) {upto}) AS {name}{i}_{w}"
                for i in range(len(cols))
            ])
    # A window that ends with a chunk is that chunk.
    made = [
        f"IF(({POS} + 1) % {w} = 0, NULL, lag(__tail{i}_{w}, {w - 1}) OVER ({spec})) AS __before{i}_{w}" for i, w in rolled
    ]
    made += [f"lag({q(c)}, {k}) OVER ({spec}) AS {q(lag_name(c, k))}" for c in cols for k in lags]
    rows = rows.selectExpr("*", *made).where(~F.col(HALO))
    out = []
    for i, c in enumerate(cols):
        for w in windows:
            mean, deviation = _merged(f"__before{i}_{w}", f"__head{i}_{w}")
            out += [f"{mean} AS {q(rolling_name(c, 'mean', w))}", f"{deviation} AS {q(rolling_name(c, 'std', w))}"]
        out += [q(lag_name(c, k)) for k in lags]
    return rows.selectExpr(*[q(c) for c in df.columns], *out)


def _merged(before: str, now: str) -> tuple[str, str]:
    """Mean and deviation of two runs of values, each (n, mean, squares); ``before`` may be null."""
    m, n = f"coalesce({before}.n, 0L)", f"{now}.n"
    apart = f"IF({m} = 0 OR {n} = 0, 0D, {before}.mean - {now}.mean)"
    mean = f"CASE WHEN {m} + {n} = 0 THEN NULL WHEN {n} = 0 THEN {before}.mean ELSE {now}.mean + {apart} * {m} / ({m} + {n}) END"
    squares = f"({now}.squares + coalesce({before}.squares, 0D) + {apart} * {apart} * {m} * {n} / ({m} + {n}))"
    deviation = f"sqrt({squares} / ({m} + {n} - 1))"
    least = f"{ROUNDING} * greatest(abs({now}.mean), abs(coalesce({before}.mean, 0D)))"
    return mean, f"CASE WHEN {m} + {n} < 2 OR {deviation} <= {least} THEN 0D ELSE {deviation} END"


def add_time_features(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    """Minute of the day on a circle: ``sin_time`` and ``cos_time``."""
    return df.withColumns({"sin_time": sin_time(F.col(ts)), "cos_time": cos_time(F.col(ts))})


def feature_columns(df: DataFrame, exclude: Sequence[str] = ("patient_id", "was_missing")) -> list[str]:
    """Numeric and boolean columns that are not listed as metadata."""
    return [
        f.name for f in df.schema
        if isinstance(f.dataType, (T.NumericType, T.BooleanType)) and f.name not in exclude
    ]


def null_total(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row: how many nulls ``fill_features`` replaces."""
    return df.agg(F.expr(" + ".join(f"count_if({q(c)} IS NULL)" for c in cols)).alias("n_filled"))


def fill_features(
    df: DataFrame, cols: Sequence[str], vitals: Sequence[str], policy: str = "zero"
) -> DataFrame:
    """Replace nulls by 0 in all feature columns.

    ``policy="zero"`` also zeroes measurements that stayed null; ``"drop"``
    removes such rows first.
    """
    if policy not in ("zero", "drop"):
        raise ValueError(f"unknown null policy {policy!r}")
    if policy == "drop":
        df = df.dropna("any", subset=list(vitals))
    numeric = {f.name for f in df.schema if isinstance(f.dataType, T.NumericType)} & set(cols)
    return df.selectExpr(*[f"coalesce({q(c)}, 0) AS {q(c)}" if c in numeric else q(c) for c in df.columns])


def sanity_report(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Degenerate features: ``check, column, value, ok``.

    Variance (ddof 1, 4 decimals) of rolling deviations must not be 0; the
    mean share of non-zero lag values must reach 0.90; no nulls may be left.
    """
    names = list(cols)
    stats = materialise(
        long_columns(df, names).groupBy("i").agg(
            F.round(F.var_samp("v"), 4).alias("variance"),
            # A null differs from 0, so it counts as non-zero.
            F.avg(F.coalesce(F.col("v") != 0, F.lit(True)).cast("int")).alias("nonzero"),
            F.count_if(F.col("v").isNull()).alias("nulls"),
        ),
        "sanity",
    ).withColumn("column", F.get(F.array(*[F.lit(c) for c in names]), F.col("i")))
    everything = F.lit("all").alias("column")
    spread = stats.where(F.col("column").contains("roll_std")).select(
        F.lit("roll_std_variance").alias("check"), "column", F.col("variance").alias("value"),
        F.coalesce(F.col("variance") != 0, F.lit(True)).alias("ok"),
    )
    lagged = stats.where(F.col("column").contains("_lag_")).agg(F.avg("nonzero").alias("value")).where(
        F.col("value").isNotNull()
    ).select(F.lit("lag_nonzero_rate").alias("check"), everything, "value", (F.col("value") >= 0.90).alias("ok"))
    nulls = stats.agg(F.sum("nulls").cast("double").alias("value")).select(
        F.lit("null_count").alias("check"), everything, "value", (F.col("value") == 0).alias("ok")
    )
    return spread.unionByName(lagged).unionByName(nulls)


def build_features(
    df: DataFrame,
    vitals: Sequence[str],
    windows: Sequence[int] = (5, 15, 60),
    lags: Sequence[int] = (1, 5, 15),
    keys: Sequence[str] = (),
    ts: str = "timestamp",
    null_policy: str = "zero",
    block_rows: int = 4096,
) -> tuple[DataFrame, list[str]]:
    """Unscaled, null-free feature table and the names of its feature columns."""
    present = [v for v in vitals if v in df.columns]
    wide = add_window_features(df, present, windows, lags, keys, block_rows)
    wide = add_time_features(wide, ts)
    cols = feature_columns(wide, ("patient_id", "was_missing", "still_missing", POS, *keys))
    filled = fill_features(wide, cols, present, null_policy)
    if null_policy == "drop":
        filled = number_rows(filled, keys, POS, block_rows)
    return filled, cols
