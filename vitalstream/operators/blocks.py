"""Ordered work on one long series without a single-partition window.

A series is cut into blocks of ``size`` consecutive positions. Look-back of a
fixed length is served by a halo: the last rows of a block are also sent to the
next block. Look-back of any length is served by a summary row per block that
is carried over the blocks. A hot key therefore spreads over as many tasks as
it has blocks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from vitalstream.functions.summary import attach, join_on, q
from vitalstream.functions.timeline import floor_div

POS = "pos"
# Names of inner columns start with two underscores, so that no column of a user meets them.
BLOCK = "__block"
HALO = "__is_halo"
GROUP = "__group"
# Below this many bytes per core a table is small.
SMALL_SPLIT = 32 << 20
# Blocks per group when summaries are carried over the blocks of a series.
FANOUT = 4096


def task_count(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame) -> DataFrame:
    """Put a small table on all cores before costly work per row.

    A small table often sits in one file or row group and would keep one task
    busy. A large one has many splits already and is left where it is.
    """
    if df.isStreaming:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return df.repartition(cores) if int(str(size)) < cores * SMALL_SPLIT else df


def by_block(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.repartition(*[F.col(c) for c in (*keys, BLOCK)])


def with_block(df: DataFrame, size: int, pos: str = POS) -> DataFrame:
    return df.withColumn(BLOCK, floor_div(F.col(pos), size))


def with_halo(df: DataFrame, halo: int, size: int, pos: str = POS) -> DataFrame:
    """Add ``block`` and ``is_halo``; the last ``halo`` rows of a block also start the next one."""
    if halo >= size:
        raise ValueError(f"look-back of {halo} rows needs blocks larger than {size} rows")
    own = floor_div(F.col(pos), size)
    if halo == 0:
        return df.withColumns({BLOCK: own, HALO: F.lit(False)})
    in_tail = F.pmod(F.col(pos), F.lit(size)) >= size - halo
    copies = F.when(in_tail, F.array(own, own + 1)).otherwise(F.array(own))
    return df.withColumn(BLOCK, F.explode(copies)).withColumn(HALO, F.col(BLOCK) * size > F.col(pos))


def block_window(keys: Sequence[str], pos: str = POS, reverse: bool = False):
    order = F.col(pos).desc() if reverse else F.col(pos).asc()
    return Window.partitionBy(*keys, BLOCK).orderBy(order)


def carry_nearest(
    edges: DataFrame, keys: Sequence[str], earlier: dict[str, str], later: dict[str, str],
    fanout: int = FANOUT,
) -> DataFrame:
    """Per block, the nearest non-null value of a column in other blocks of the series.

    ``earlier`` and ``later`` map result names to the columns to look up in
    earlier and later blocks. Two levels: inside groups of ``fanout`` blocks,
    then over the groups, so no window holds more than a group or the list of
    groups. ``edges`` is read twice and should be a stored table.
    """
    part = ", ".join(q(c) for c in keys)
    grouped = edges.withColumn(GROUP, floor_div(F.col(BLOCK), fanout))
    near, far = grouped, grouped.groupBy(*keys, GROUP).agg(*[
        F.expr(f"{closest}({q(c)}, if({q(c)} IS NOT NULL, {BLOCK}, NULL)) AS {q('__far_' + n)}")
        for side, closest in ((earlier, "max_by"), (later, "min_by")) for n, c in side.items()
    ])
    for side, order in ((earlier, "ASC"), (later, "DESC")):
        frame = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
        inner = f"OVER (PARTITION BY {part + ', ' if part else ''}{GROUP} ORDER BY {BLOCK} {order} {frame})"
        outer = f"OVER ({'PARTITION BY ' + part if part else ''} ORDER BY {GROUP} {order} {frame})"
        near = near.selectExpr("*", *[f"last({q(c)}, true) {inner} AS {q(n)}" for n, c in side.items()])
        far = far.selectExpr(
            *[q(c) for c in far.columns if c.removeprefix('__far_') not in side],
            *[f"last({q('__far_' + n)}, true) {outer} AS {q('__far_' + n)}" for n in side],
        )
    return join_on(near, far, [*keys, GROUP], "left").selectExpr(
        *[q(c) for c in keys], BLOCK,
        *[f"coalesce({q(n)}, {q('__far_' + n)}) AS {q(n)}" for n in (*earlier, *later)],
    )


def carry_sum(
    edges: DataFrame, keys: Sequence[str], c: str, name: str, fanout: int = FANOUT
) -> DataFrame:
    """Per block, the sum of ``c`` over all earlier blocks of the series."""
    before = (Window.unboundedPreceding, -1)
    inner = Window.partitionBy(*keys, GROUP).orderBy(BLOCK)
    outer = Window.partitionBy(*keys).orderBy(GROUP)
    grouped = edges.withColumn(GROUP, floor_div(F.col(BLOCK), fanout))
    near = grouped.withColumn(name, F.coalesce(F.sum(c).over(inner.rowsBetween(*before)), F.lit(0)))
    far = grouped.groupBy(*keys, GROUP).agg(F.sum(c).alias("__far_sum")).withColumn(
        "__far_sum", F.coalesce(F.sum("__far_sum").over(outer.rowsBetween(*before)), F.lit(0))
    )
    return join_on(near, far, [*keys, GROUP], "left").withColumn(
        name, F.col(name) + F.col("__far_sum")
    ).drop(GROUP, "__far_sum")


def number_rows(
    df: DataFrame, keys: Sequence[str] = (), order: str = POS, size: int = 4096,
    name: str = POS, fanout: int = FANOUT, cut: str | None = None, unique: bool = False,
) -> DataFrame:
    """Dense positions 0, 1, 2, ... in the order of an integer column.

    Rows are counted per block, the counts are summed over the blocks, and a
    row number inside the block is added. Blocks are cut from ``cut``, an
    integer that grows with ``order`` and starts near 0 (default: ``order``).
    With ``unique`` a value of ``order`` that repeats in a series is an error.
    """
    blocked = by_block(with_block(df, size, cut or order), keys)
    counts = blocked.groupBy(*keys, BLOCK).agg(F.count(F.lit(1)).alias("__rows_in_block"))
    starts = carry_sum(counts, keys, "__rows_in_block", "__rows_before", fanout).drop("__rows_in_block")
    window = block_window(keys, order)
    local = F.row_number().over(window) - 1
    if unique:
        local = F.when(
            F.lag(order).over(window) == F.col(order), F.raise_error(F.lit("a time repeats within a series")).cast("int")
        ).otherwise(local)
    numbered = join_on(blocked.withColumn("__row_in_block", local), starts, [*keys, BLOCK], "left")
    out = numbered.withColumn("__dense", (F.col("__rows_before") + F.col("__row_in_block")).cast("bigint"))
    out = out.drop(BLOCK, "__row_in_block", "__rows_before", *([name] if name in df.columns else []))
    return out.withColumnRenamed("__dense", name)


def series_length(df: DataFrame, keys: Sequence[str] = (), pos: str = POS, name: str = "n") -> DataFrame:
    """Rows per series, for a densely numbered table."""
    return df.groupBy(*keys).agg((F.max(pos) + 1).alias(name))


def with_length(df: DataFrame, keys: Sequence[str] = (), pos: str = POS, name: str = "n") -> DataFrame:
    return attach(df, series_length(df, keys, pos, name), keys)
