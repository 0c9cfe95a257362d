"""Sliding windows as rows, for storage; scoring builds them inside its blocks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from vitalstream.functions.summary import join_on, q
from vitalstream.operators.blocks import BLOCK, HALO, POS, by_block, series_length, with_halo
from vitalstream.sources.tables import require_table, write_table


def build_windows(
    df: DataFrame, cols: Sequence[str], length: int, keys: Sequence[str] = (),
    ts: str = "timestamp", block_rows: int = 4096,
) -> DataFrame:
    """Windows of ``length`` rows with stride 1, labelled by their last row.

    Returns keys, ``pos`` and time of the last row, and ``seq``
    (``array<array<float>>``, length x columns). A series shorter than one
    window raises ``ValueError``.
    """
    short = series_length(df, keys).where(F.col("n") < length).first()
    if short is not None or (not keys and df.isEmpty()):
        raise ValueError(f"a series has fewer rows than the window length {length}")
    blocked = by_block(with_halo(df, length - 1, block_rows), keys)
    group = ", ".join(q(c) for c in (*keys, BLOCK))
    row = "array(" + ", ".join(f"CAST({q(c)} AS FLOAT)" for c in cols) + ")"
    seq = (f"collect_list({row}) OVER (PARTITION BY {group} ORDER BY {POS} "
           f"ROWS BETWEEN {length - 1} PRECEDING AND CURRENT ROW) AS seq")
    return (
        blocked.selectExpr(*[q(c) for c in keys], POS, ts, HALO, seq)
        .where(~F.col(HALO) & (F.size("seq") == length)).drop(HALO)
    )


def save_windows(windows: DataFrame, path: str) -> None:
    write_table(windows, path)


def load_windows(spark: SparkSession, path: str) -> DataFrame:
    return require_table(spark, path)


def align_windows(scores: DataFrame, rows: DataFrame, length: int, keys: Sequence[str] = ()) -> DataFrame:
    """Join scores by ``window_index`` to the rows on which the windows end."""
    ends = scores.withColumn(POS, F.col("window_index") + (length - 1)).drop("window_index")
    return join_on(rows, ends, [*keys, POS])
