"""From raw readings to a gapless, range-checked, interpolated series."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window, functions as F, types as T

from vitalstream.functions.flags import any_missing, outside, within
from vitalstream.functions.summary import attach, join_on, long_rows, q
from vitalstream.functions.timeline import DAY_US, floor_div, freq_micros, from_micros, seconds
from vitalstream.operators.blocks import (
    BLOCK, FANOUT, POS, block_window, by_block, carry_nearest, carry_sum, task_count, with_block,
)
from vitalstream.sources.tables import materialise


def rename_columns(df: DataFrame, mapping: Mapping[str, str]) -> tuple[DataFrame, list[str]]:
    """Rename the columns that exist; also return the mapped names that are absent."""
    absent = [c for c in mapping if c not in df.columns]
    return df.withColumnsRenamed({a: b for a, b in mapping.items() if a in df.columns}), absent


def require_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    absent = [c for c in cols if c not in df.columns]
    if absent:
        raise KeyError(f"columns not found: {absent}")
    return df


def parse_timestamps(df: DataFrame, ts: str = "timestamp", fmt: str | None = None) -> DataFrame:
    require_columns(df, [ts])
    if isinstance(df.schema[ts].dataType, T.StringType):
        parsed = F.to_timestamp_ntz(F.col(ts), F.lit(fmt)) if fmt else F.to_timestamp_ntz(F.col(ts))
    else:
        parsed = F.col(ts).cast("timestamp_ntz")
    return df.withColumn(ts, parsed)


def single_stream(df: DataFrame, key: str = "patient_id") -> DataFrame:
    """Treat all rows as one series."""
    return df.withColumn(key, F.lit(1))


def nan_to_null(df: DataFrame) -> DataFrame:
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats})


def apply_limits(df: DataFrame, limits: Mapping[str, tuple[float, float]]) -> DataFrame:
    """Null every value outside its closed range."""
    return df.withColumns({c: within(c, *limits[c]) for c in limits if c in df.columns})


def limit_counts(df: DataFrame, limits: Mapping[str, tuple[float, float]]) -> DataFrame:
    """How many values ``apply_limits`` nulls, per column."""
    cols = [c for c in limits if c in df.columns]
    wide = df.agg(*[F.count_if(outside(c, *limits[c])).alias(c) for c in cols])
    return long_rows(wide, [], [
        {"column": F.lit(c), "lo": F.lit(float(limits[c][0])), "hi": F.lit(float(limits[c][1])),
         "n_clipped": F.col(c)}
        for c in cols
    ])


def resample(
    df: DataFrame,
    vitals: Sequence[str],
    freq: str,
    keys: Sequence[str] = (),
    ts: str = "timestamp",
    block_rows: int = 4096,
) -> DataFrame:
    """Mean per time bucket on a gapless axis.

    Returns keys, ``pos`` (0 at the first bucket of the series), the bucket
    start, the means and ``was_missing``. Empty buckets come from an axis that
    is unioned to the readings before the aggregation, so filling the axis
    costs no join; a bucket with very many readings is combined map-side.
    """
    step = freq_micros(freq) // 1_000_000
    # Frequencies are whole seconds, so the fraction of a second never matters.
    readings = df.where(F.col(ts).isNotNull()).withColumn("__at", seconds(F.col(ts)))
    day = DAY_US // 1_000_000
    if day % step:
        # Buckets that do not divide a day count from midnight of the first day.
        start = readings.agg((F.min("__at") - F.pmod(F.min("__at"), F.lit(day))).alias("__origin"))
        readings = attach(readings, start)
    else:
        start = None
        readings = readings.withColumn("__origin", F.lit(0).cast("bigint"))
    readings = readings.withColumn("__bucket", floor_div(F.col("__at") - F.col("__origin"), step))

    bounds = readings.groupBy(*keys).agg(F.min("__bucket").alias("__first"), F.max("__bucket").alias("__last"))
    last_block = floor_div(F.col("__last") - F.col("__first"), block_rows)
    # An explicit number of tasks: adaptive execution would merge these few
    # block ids into one task, which would then unfold the whole axis.
    blocks = (
        bounds.where(F.col("__first").isNotNull())
        .withColumn(BLOCK, F.explode(F.sequence(F.lit(0).cast("bigint"), last_block)))
        .repartition(task_count(df), *[F.col(c) for c in (*keys, BLOCK)])
    )
    from_bucket = F.col("__first") + F.col(BLOCK) * block_rows
    to_bucket = F.least(F.col("__last"), from_bucket + (block_rows - 1))
    axis = blocks.select(
        *keys,
        F.explode(F.sequence(from_bucket, to_bucket)).alias("__bucket"),
        *[F.lit(None).cast("double").alias(v) for v in vitals],
        F.col("__first"),
    )
    values = readings.select(
        *keys, "__bucket", *[F.col(v).cast("double").alias(v) for v in vitals],
        F.lit(None).cast("bigint").alias("__first"),
    )
    means = values.unionByName(axis).groupBy(*keys, "__bucket").agg(
        *[F.avg(v).alias(v) for v in vitals], F.max("__first").alias("__first")
    )
    if start is not None:
        means = attach(means, start)
        at = F.col("__bucket") * step + F.col("__origin")
    else:
        at = F.col("__bucket") * step
    return means.select(
        *keys,
        (F.col("__bucket") - F.col("__first")).alias(POS),
        from_micros(at * 1_000_000).alias(ts),
        *vitals,
        any_missing(list(vitals)).alias("was_missing"),
    )


def _fill(
    df: DataFrame, vitals: Sequence[str], max_gap: int, keys: Sequence[str], block_rows: int, fanout: int
) -> DataFrame:
    """``df`` with filled measurements, still partitioned by block and sorted by position."""
    # Expressions are SQL text: hundreds of Column calls would cost more
    # driver time than planning them.
    blocked = with_block(df, block_rows)
    group = ", ".join(q(c) for c in (*keys, BLOCK))
    seen = {v: f"if({q(v)} IS NOT NULL, {POS}, NULL)" for v in vitals}
    edges = blocked.groupBy(*keys, BLOCK).agg(*[F.expr(e) for v in vitals for e in (
        f"max({seen[v]}) AS {q('__last_pos_' + v)}", f"max_by({q(v)}, {seen[v]}) AS {q('__last_' + v)}",
        f"min({seen[v]}) AS {q('__first_pos_' + v)}", f"min_by({q(v)}, {seen[v]}) AS {q('__first_' + v)}",
    )])
    kinds = [n for v in vitals for n in (f"pos_{v}", v)]
    edges = carry_nearest(
        materialise(edges, "edges"), keys,
        {f"__earlier_{k}": f"__last_{k}" for k in kinds}, {f"__later_{k}": f"__first_{k}" for k in kinds}, fanout,
    )

    # The following value is found by a running frame in descending order:
    # a frame that ends at the last row would be rebuilt for every row.
    rows = join_on(by_block(blocked, keys), edges, [*keys, BLOCK], "left")
    for prefix, order in (("__q", "DESC"), ("__p", "ASC")):
        frame = (f"OVER (PARTITION BY {group} ORDER BY {POS} {order} "
                 "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
        rows = rows.selectExpr("*", *[e for v in vitals for e in (
            f"last({seen[v]}, true) {frame} AS {q(prefix + '_pos_' + v)}",
            f"last({q(v)}, true) {frame} AS {q(prefix + '_' + v)}",
        )])

    def either(near: str, far: str, v: str) -> str:
        return f"coalesce({q(near + v)}, {q(far + v)})"

    rows = rows.selectExpr(BLOCK, *[q(c) for c in df.columns], *[e for v in vitals for e in (
        f"{either('__p_pos_', '__earlier_pos_', v)} AS {q('__p_pos_' + v)}", f"{either('__p_', '__earlier_', v)} AS {q('__p_' + v)}",
        f"{either('__q_pos_', '__later_pos_', v)} AS {q('__q_pos_' + v)}", f"{either('__q_', '__later_', v)} AS {q('__q_' + v)}",
    )])

    def filled(v: str) -> str:
        p_pos, p, q_pos, nxt = (q(n + v) for n in ("__p_pos_", "__p_", "__q_pos_", "__q_"))
        return f"""
            CASE WHEN {q(v)} IS NOT NULL THEN {q(v)}
                 WHEN {POS} - {p_pos} <= {max_gap} OR {q_pos} - {POS} <= {max_gap} THEN coalesce(
                     CASE WHEN {q_pos} > {p_pos}
                          THEN {p} + ({nxt} - {p}) * ({POS} - {p_pos}) / ({q_pos} - {p_pos}) END,
                     {p}, {nxt})
            END AS {q(v)}"""

    return rows.selectExpr(BLOCK, *[filled(c) if c in vitals else q(c) for c in df.columns])


def interpolate(
    df: DataFrame,
    vitals: Sequence[str],
    max_gap: int,
    keys: Sequence[str] = (),
    block_rows: int = 4096,
    fanout: int = FANOUT,
) -> DataFrame:
    """Linear interpolation over a gapless axis (``pos`` without holes).

    A null is filled if a value lies within ``max_gap`` rows before or after
    it. The line joins the two neighbours of the whole gap, however far they
    are; beyond the first or last value the nearest value is repeated.
    """
    filled = _fill(df, vitals, max_gap, keys, block_rows, fanout).drop(BLOCK)
    return filled.withColumn("still_missing", any_missing(list(vitals)))


def drop_empty(df: DataFrame, vitals: Sequence[str]) -> DataFrame:
    """Drop rows in which every measurement is null."""
    return df.dropna("all", subset=list(vitals))


def drop_incomplete(df: DataFrame, vitals: Sequence[str]) -> DataFrame:
    """Drop rows in which any measurement is null."""
    return df.dropna("any", subset=list(vitals))


def clean(
    df: DataFrame,
    vitals: Sequence[str],
    limits: Mapping[str, tuple[float, float]],
    freq: str = "1min",
    max_gap: int = 10,
    keys: Sequence[str] = (),
    ts: str = "timestamp",
    block_rows: int = 4096,
) -> DataFrame:
    """Limits, resampling, interpolation, dropping of empty rows, dense positions."""
    present = [v for v in vitals if v in df.columns]
    grid = materialise(resample(apply_limits(df, limits), present, freq, keys, ts, block_rows), "grid")
    filled = _fill(grid, present, max_gap, keys, block_rows, FANOUT)
    keep = F.greatest(*[F.col(v).isNotNull() for v in present]) if len(present) > 1 else F.col(present[0]).isNotNull()
    # The blocks are sorted already, so kept rows are counted in the same pass.
    kept_so_far = F.count_if(keep).over(block_window(keys).rowsBetween(Window.unboundedPreceding, 0))
    kept = materialise(
        drop_empty(filled.withColumn("__kept", kept_so_far), present), "filled"
    )
    counts = kept.groupBy(*keys, BLOCK).agg(F.count(F.lit(1)).alias("__kept_in_block"))
    starts = carry_sum(counts, keys, "__kept_in_block", "__kept_before").drop("__kept_in_block")
    return join_on(kept, starts, [*keys, BLOCK], "left").select(
        *keys,
        (F.col("__kept_before") + F.col("__kept") - 1).alias(POS),
        ts, *present, "was_missing",
        any_missing(present).alias("still_missing"),
    )
