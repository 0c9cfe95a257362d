"""Sliding-window reconstruction: the optimal linear autoencoder of a given latent size.

Windows are never stored for fitting or scoring. A task sees whole blocks with
their halo and views each block as overlapping windows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from vitalstream.config import WindowModelConfig
from vitalstream.functions.flags import flag
from vitalstream.functions.summary import attach, join_on, long_rows, totals
from vitalstream.operators.blocks import BLOCK, HALO, POS, by_block, series_length, task_count, with_halo
from vitalstream.operators.split import label_window_split
from vitalstream.sources.tables import require_table, write_table

MODEL_SCHEMA = "kind string, idx int, vec array<double>"
# Windows rebuilt at a time, and rows whose windows one task sums up.
CHUNK, TASK_ROWS = 4096, 4_000_000
# Numbers of windows written out at a time, and when the passes of a sketch end.
FLAT_NUMBERS, SUBSPACE_MOVES, SKETCH_SEED = 4_000_000, 1e-8, 42


@dataclass(frozen=True)
class WindowModel:
    """Mean window and orthonormal components, both of ``length * columns`` numbers."""

    columns: list[str]
    length: int
    mean: np.ndarray
    components: np.ndarray

    def reconstruct(self, windows: np.ndarray) -> np.ndarray:
        flat = windows.reshape(len(windows), -1) - self.mean
        return (flat @ self.components.T @ self.components + self.mean).reshape(windows.shape)

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [("mean", 0, self.mean.tolist())]
        rows += [("component", i, c.tolist()) for i, c in enumerate(self.components)]
        write_table(spark.createDataFrame(rows, MODEL_SCHEMA).coalesce(1), f"{path}/vectors")
        shape = spark.createDataFrame([(self.columns, self.length)], "columns array<string>, length int")
        write_table(shape.coalesce(1), f"{path}/shape")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "WindowModel":
        shape = require_table(spark, f"{path}/shape").first()
        rows = require_table(spark, f"{path}/vectors").orderBy("kind", "idx").collect()
        mean = next(np.asarray(r["vec"]) for r in rows if r["kind"] == "mean")
        parts = [r["vec"] for r in rows if r["kind"] == "component"]
        return WindowModel(list(shape["columns"]), shape["length"], mean,
                           np.asarray(parts).reshape(len(parts), len(mean)))


def _require_length(df: DataFrame, length: int, keys: Sequence[str]) -> int:
    """Rows in all series; ``ValueError`` if one is shorter than a window."""
    shortest, total = series_length(df, keys).agg(F.min(F.coalesce("n", F.lit(0))), F.sum("n")).first()
    if shortest is not None and shortest < length:
        raise ValueError(f"a series has fewer rows than the window length {length}")
    return total or 0


def _views(values: np.ndarray, length: int) -> np.ndarray:
    """(rows, columns) -> (rows - length + 1, length, columns) without copying."""
    return np.lib.stride_tricks.sliding_window_view(values, length, axis=0).transpose(0, 2, 1)


def _blocks(df: DataFrame, cols: Sequence[str], length: int, keys: Sequence[str], extra: Sequence[Column],
            block_rows: int) -> DataFrame:
    values = [F.col(c).cast("double").alias(f"__x{i}") for i, c in enumerate(cols)]
    return with_halo(df.select(*keys, POS, *extra, *values), length - 1, block_rows)


def fit_windows(
    df: DataFrame, cols: Sequence[str], cfg: WindowModelConfig = WindowModelConfig(),
    keys: Sequence[str] = (), block_rows: int = 4096,
) -> WindowModel:
    """Principal components of the training windows.

    ``exact``: each task adds up the moment matrix of its windows, (length * columns)
    squared, and one eigenproblem of that size is solved. ``sketch``: subspace iteration from a
    random start; a pass multiplies the moment matrix with ``latent_dim + oversample`` vectors without forming it, so
    a task holds and hands on (length * columns) times as many numbers. Passes end when the
    components' subspace moves by less than 1e-8, or after ``max_passes``. Neither the number nor the size of what tasks hand on grows with the data;
    it is summed by Spark.
    """
    if cfg.solver not in ("exact", "sketch"):
        raise ValueError(f"unknown solver {cfg.solver!r}")
    cols, length = list(cols), cfg.sequence_length
    total_rows = _require_length(df, length, keys)
    n = series_length(df, keys, name="series_n")
    windows = F.col("series_n") - (length - 1)
    in_train = (F.col(POS) - (length - 1)) < F.floor(windows * F.lit(cfg.train_split))
    rows = attach(df.select(*keys, POS, *cols), n, keys)
    blocks = _blocks(rows, cols, length, keys, [in_train.alias("in_train")], block_rows)
    order = [F.col(c) for c in (*keys, BLOCK)]
    # Every task hands on a whole matrix, so there are no more tasks than blocks; a task's rows are bounded.
    tasks = max(1, min(max(task_count(df), total_rows // TASK_ROWS), -(-total_rows // block_rows)))
    placed = blocks.repartition(tasks, *order).sortWithinPartitions(*order, F.col(POS))
    names = [f"__x{i}" for i in range(len(cols))]
    size = length * len(cols)
    block_id = [*keys, BLOCK]

    def flat_windows(frames: Iterator[pd.DataFrame]) -> Iterator[np.ndarray]:
        """The training windows of a task, some at a time."""
        for block in _whole_blocks(frames, block_id):
            if len(block) < length:
                continue
            ends = block.iloc[length - 1:]
            wanted = np.flatnonzero((ends["in_train"] & ~ends[HALO]).to_numpy())
            views = _views(block[names].to_numpy(), length)
            for part in np.array_split(wanted, len(wanted) * size // FLAT_NUMBERS + 1):
                if len(part):
                    yield views[part].reshape(len(part), size)

    latent = min(cfg.latent_dim, size)
    if cfg.solver == "exact":
        mean, components = _exact_components(placed, flat_windows, size, latent)
    else:
        width = min(latent + cfg.oversample, size)
        mean, components = _sketched_components(placed, flat_windows, size, latent, width, cfg.max_passes)
    return WindowModel(cols, length, mean, components)


def _summed(placed: DataFrame, flat_windows: Callable, add: Callable, count: int) -> np.ndarray:
    """The sum over all tasks of ``count`` numbers, to which ``add`` adds a part's windows; in two levels."""

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(count)
        for flat in flat_windows(frames):
            add(total, flat)
        yield pd.DataFrame({"sums": [total]})

    def merged(table: pa.Table) -> pa.Table:
        total = np.zeros(count)
        for one in table.column("sums"):
            total += one.values.to_numpy()
        return pa.table({"sums": pa.array([total], pa.list_(pa.float64()))})

    parts = placed.mapInPandas(sums, "sums array<double>")
    for group in (F.pmod(F.spark_partition_id(), F.lit(64)), F.lit(0)):
        parts = parts.groupBy(group.alias("g")).applyInArrow(merged, "sums array<double>")
    found = parts.toArrow().column("sums")
    return found[0].values.to_numpy().copy() if len(found) else np.zeros(count)


def _exact_components(placed: DataFrame, flat_windows: Callable, size: int, latent: int) -> tuple[np.ndarray, np.ndarray]:
    side = size + 1

    def add(total: np.ndarray, flat: np.ndarray) -> None:
        flat = np.column_stack([flat, np.ones(len(flat))])
        total.reshape(side, side)[:] += flat.T @ flat

    gram = _summed(placed, flat_windows, add, side * side).reshape(side, side)
    count = gram[-1, -1]
    if count == 0:
        raise ValueError("no training windows")
    mean = gram[:-1, -1] / count
    vectors = np.linalg.eigh(gram[:-1, :-1] / count - np.outer(mean, mean))[1]
    return mean, np.ascontiguousarray(vectors[:, ::-1][:, :latent].T)


def _sketched_components(
    placed: DataFrame, flat_windows: Callable, size: int, latent: int, width: int, max_passes: int
) -> tuple[np.ndarray, np.ndarray]:
    def multiplied(basis: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Covariance times ``basis``, and the mean window."""

        def add(total: np.ndarray, flat: np.ndarray) -> None:
            total[:size * width].reshape(size, width)[:] += flat.T @ (flat @ basis)
            total[size * width:-1] += flat.sum(axis=0)
            total[-1] += len(flat)

        total = _summed(placed, flat_windows, add, size * width + size + 1)
        count, mean = total[-1], total[size * width:-1] / max(total[-1], 1)
        if count == 0:
            raise ValueError("no training windows")
        return total[:size * width].reshape(size, width) / count - np.outer(mean, mean @ basis), mean

    basis = np.linalg.qr(np.random.default_rng(SKETCH_SEED).standard_normal((size, width)))[0]
    before = None
    for _ in range(max_passes):
        product, mean = multiplied(basis)
        small = basis.T @ product
        found = basis @ np.linalg.eigh((small + small.T) / 2)[1][:, ::-1][:, :latent]
        if before is not None and np.linalg.norm(found - before @ (before.T @ found), 2) < SUBSPACE_MOVES:
            break
        before, basis = found, np.linalg.qr(product)[0]
    return mean, np.ascontiguousarray(found.T)


def _whole_blocks(frames: Iterator[pd.DataFrame], block_id: Sequence[str]) -> Iterator[pd.DataFrame]:
    """Blocks put together again from sorted Arrow batches that may cut them."""
    rest = None
    for frame in frames:
        if len(frame) == 0:
            continue
        frame = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
        ids = frame[list(block_id)]
        starts = np.flatnonzero((ids != ids.shift()).any(axis=1).to_numpy())
        for a, b in zip(starts, starts[1:]):
            yield frame.iloc[a:b]
        rest = frame.iloc[starts[-1]:]
    if rest is not None:
        yield rest


def score_windows(
    df: DataFrame, cols: Sequence[str], length: int,
    reconstruct: Callable[[np.ndarray], np.ndarray],
    keys: Sequence[str] = (), block_rows: int = 4096, carry: Sequence[str] = (),
) -> DataFrame:
    """``keys, pos, carry..., mse``: mean squared error of each window, at its last row.

    ``reconstruct`` maps (windows, length, columns) to the same shape; any
    trained network can be passed in place of ``WindowModel.reconstruct``.
    """
    _require_length(df, length, keys)
    series = F.xxhash64(*[F.col(c) for c in keys], F.lit(0)).alias("__series")
    blocks = by_block(_blocks(df, cols, length, keys, [*[F.col(c) for c in carry], series], block_rows), keys)
    names = [f"__x{i}" for i in range(len(cols))]
    kept = [*keys, POS, *carry]
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField("mse", T.DoubleType())])

    def ends_of(rows: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        first = np.repeat(starts, np.diff(np.append(starts, len(rows))))
        own = ~rows.column(HALO).to_numpy()
        ends = np.flatnonzero(own & (np.arange(len(rows)) - first >= length - 1))
        x = np.column_stack([rows.column(n).to_numpy() for n in names])
        views = _views(x, length) if len(ends) else None
        mse = [np.empty(0)]
        for part in np.array_split(ends, len(ends) // CHUNK + 1) if len(ends) else []:
            window = views[part - (length - 1)]
            mse.append(((reconstruct(window) - window) ** 2).mean(axis=(1, 2)))
        out = rows.select(kept).take(pa.array(ends)).append_column("mse", pa.array(np.concatenate(mse)))
        return out.combine_chunks()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Sorted rows, many blocks at a time; the last block of a batch may go on in the next.
        rest = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if rest is None else pa.concat_tables([rest, rows])
            if not len(rows):
                continue
            pos, of = rows.column(POS).to_numpy(), rows.column("__series").to_numpy()
            starts = np.flatnonzero(np.append(True, (np.diff(pos) != 1) | (np.diff(of) != 0)))
            rest = rows.slice(starts[-1])
            if starts[-1]:
                yield from ends_of(rows.slice(0, starts[-1]), starts[:-1]).to_batches()
        if rest is not None:
            yield from ends_of(rest, np.array([0])).to_batches()

    order = [F.col(c) for c in (*keys, BLOCK, POS)]
    return blocks.sortWithinPartitions(*order).mapInArrow(score, schema)


def score_threshold(scores: DataFrame, multiplier: float, ddof: int = 0, score: str = "mse") -> DataFrame:
    """One row ``mu, sigma, threshold`` of the given (training) scores."""
    spread = F.stddev_pop(score) if ddof == 0 else F.stddev_samp(score)
    return totals(scores, (), mu=F.avg(score), sigma=spread).withColumn(
        "threshold", F.col("mu") + F.lit(float(multiplier)) * F.col("sigma")
    )


def flag_windows(
    scores: DataFrame, multiplier: float, length: int, frac: float, keys: Sequence[str] = (), ddof: int = 0,
) -> DataFrame:
    """Add ``split``, ``threshold`` (from training windows only) and ``anomaly``."""
    labelled = label_window_split(scores, frac, length, keys)
    cut = score_threshold(labelled.where(F.col("split") == "train"), multiplier, ddof)
    out = attach(labelled, cut.select("threshold"))
    return out.withColumn("anomaly", flag(F.col("mse") > F.col("threshold")))


def window_result(flagged: DataFrame, clean: DataFrame, keys: Sequence[str] = (), ts: str = "timestamp") -> DataFrame:
    """Clean rows on which a window ends, with its score; earlier rows have none."""
    return join_on(clean.drop(POS), flagged, [*keys, ts])


def rethreshold(result: DataFrame, multiplier: float, ddof: int = 1, score: str = "mse") -> DataFrame:
    """New threshold and flags for a scored table, from its training rows, without a refit."""
    cut = score_threshold(result.where(F.col("split") == "train"), multiplier, ddof, score)
    out = attach(result.drop("threshold", "anomaly"), cut.select("threshold"))
    return out.withColumn("anomaly", flag(F.col(score) > F.col("threshold")))


def threshold_sweep(
    result: DataFrame, multipliers: Sequence[float], ddof: int = 1, score: str = "mse"
) -> DataFrame:
    """Per multiplier: threshold from training rows, flagged rows and rate over all rows."""
    cut = score_threshold(result.where(F.col("split") == "train"), 0.0, ddof, score).select("mu", "sigma")
    steps = [F.col("mu") + F.lit(float(k)) * F.col("sigma") for k in multipliers]
    counted = attach(result.select(score), cut).agg(
        F.count(F.lit(1)).alias("n"),
        *[a for i, s in enumerate(steps) for a in (
            F.max(s).alias(f"t{i}"), F.count_if(F.col(score) > s).alias(f"c{i}"))],
    )
    return long_rows(counted, [], [
        {"multiplier": F.lit(float(k)), "threshold": F.col(f"t{i}"), "n_flagged": F.col(f"c{i}"),
         "rate": F.col(f"c{i}") / F.col("n")} for i, k in enumerate(multipliers)
    ])
