"""Chronological train/test splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from vitalstream.functions.flags import chronological
from vitalstream.operators.blocks import POS, with_length


def label_split(df: DataFrame, frac: float, keys: Sequence[str] = (), pos: str = POS) -> DataFrame:
    """``split``: the first ``int(n * frac)`` rows of a series are "train"."""
    numbered = with_length(df, keys, pos, "series_n")
    return numbered.withColumn("split", chronological(F.col(pos), F.col("series_n"), frac)).drop("series_n")


def label_window_split(
    df: DataFrame, frac: float, length: int, keys: Sequence[str] = (), pos: str = POS
) -> DataFrame:
    """Split by window index: window ``i`` ends at row ``i + length - 1``.

    ``df`` holds window-end rows of a series whose last position is its last window end.
    """
    numbered = with_length(df, keys, pos, "series_n")
    index, count = F.col(pos) - (length - 1), F.col("series_n") - (length - 1)
    return numbered.withColumn("split", chronological(index, count, frac)).drop("series_n")


def split_frames(df: DataFrame, frac: float, keys: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    labelled = label_split(df, frac, keys)
    return (labelled.where(F.col("split") == "train").drop("split"),
            labelled.where(F.col("split") == "test").drop("split"))


def filter_split(df: DataFrame, which: str, column: str = "split") -> DataFrame:
    """"all", "train" or "test", in any case."""
    which = which.lower()
    if which not in ("all", "train", "test"):
        raise ValueError(f"unknown split {which!r}")
    return df if which == "all" else df.where(F.col(column) == which)
