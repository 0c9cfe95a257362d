"""Scoring of rows as they arrive, with a stored forest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from vitalstream.operators.forest import ForestModel, flag_scores, score_rows


def score_stream(model: ForestModel, rows: DataFrame, keep: Sequence[str], tasks: int | None = None) -> DataFrame:
    """Stateless scoring; scores use the training range, so they do not depend on the micro-batch.

    ``tasks`` spreads micro-batches that arrive in fewer splits than there are cores.
    """
    if tasks:
        rows = rows.repartition(tasks)
    return flag_scores(model, score_rows(model, rows, keep), normalise="model")


def start_scoring(
    model: ForestModel, rows: DataFrame, keep: Sequence[str], out_path: str, checkpoint: str,
    trigger: dict | None = None, tasks: int | None = None,
) -> StreamingQuery:
    """Append scored rows to a parquet table; ``trigger`` defaults to all available input."""
    return (
        score_stream(model, rows, keep, tasks).writeStream.format("parquet").outputMode("append")
        .option("path", out_path).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )
