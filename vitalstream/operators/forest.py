"""Isolation forest (Liu, Ting, Zhou 2008): sampled on Spark, grown per tree, scored in Arrow batches."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from vitalstream.config import ForestConfig
from vitalstream.functions.flags import chronological, min_max
from vitalstream.functions.quantiles import exact_quantiles
from vitalstream.functions.summary import attach, join_on, long_rows, q
from vitalstream.operators.blocks import POS, spread, task_count, with_length
from vitalstream.sources.tables import require_table, write_table

NODE_SCHEMA = "tree int, slot int, feature int, threshold double, path double, n int, depth int"
META_SCHEMA = ("features array<string>, depth int, max_samples int, contamination double, "
               "threshold double, score_min double, score_max double")
SCORE = "raw_score"
# Hash values are compared as numbers below this one.
RESOLUTION = 1 << 53
# Rows sent down the trees at a time: keeps the working arrays in cache.
CHUNK = 1 << 14
# Levels of a tree looked up at once, and the features and cells (8 bytes each) up to which that is done.
LEVELS, GRID_FEATURES, GRID_CELLS = 4, 8, 1 << 23
# Slots of all trees together, as they are sent to every task: about 1.5 GB.
MAX_SLOTS = 1 << 26


def path_correction(n: float) -> float:
    """Mean path length of an unsuccessful search among n points."""
    if n <= 1:
        return 0.0
    if n <= 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + np.euler_gamma) - 2.0 * (n - 1.0) / n


@dataclass
class ForestModel:
    """Trees as a table; threshold and score range as fitted on the training rows."""

    features: list[str]
    nodes: DataFrame
    depth: int
    max_samples: int
    contamination: float
    threshold: float | None = None
    score_min: float | None = None
    score_max: float | None = None

    def save(self, path: str) -> None:
        spark = self.nodes.sparkSession
        meta = [(self.features, self.depth, self.max_samples, self.contamination,
                 self.threshold, self.score_min, self.score_max)]
        write_table(self.nodes, f"{path}/nodes")
        write_table(spark.createDataFrame(meta, META_SCHEMA).coalesce(1), f"{path}/meta")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "ForestModel":
        meta = require_table(spark, f"{path}/meta").first()
        nodes = require_table(spark, f"{path}/nodes")
        return ForestModel(list(meta["features"]), nodes, *meta[1:])


def sample_for_trees(
    df: DataFrame, row_key: Sequence[str], n: int, trees: int, size: int, seed: int
) -> DataFrame:
    """Candidate rows per ``tree``, about twice ``size`` each, at any table size.

    A row is first kept with the chance that any tree wants it, then offered
    to each tree; both decisions are hashes of the row key, so they do not
    depend on the partitioning or on a retried task.
    """
    pair_chance = min(1.0, 2.0 * size / max(n, 1))
    row_chance = min(1.0, trees * pair_chance)
    key = ", ".join(q(c) for c in row_key)
    ticket = f"pmod(xxhash64({{tree}}, {key}, {seed + 1}), {RESOLUTION})"
    kept = df.where(f"pmod(xxhash64({key}, {seed}), {RESOLUTION}) < {int(row_chance * RESOLUTION)}L")
    wanted = f"{ticket.format(tree='t')} < {int(pair_chance / row_chance * RESOLUTION)}L"
    # The list of trees is cut down before rows are copied for it.
    offers = F.expr(f"explode(filter(sequence(0, {trees - 1}), t -> {wanted}))")
    return kept.withColumn("tree", offers).withColumn("ticket", F.expr(ticket.format(tree="tree")))


def fit_forest(
    train: DataFrame, features: Sequence[str], row_key: Sequence[str], cfg: ForestConfig = ForestConfig()
) -> ForestModel:
    """Grow the trees. ``row_key`` names columns that identify a row."""
    features = list(features)
    n = train.count()
    if n == 0 or not features:
        raise ValueError("no rows or no features to fit the forest on")
    size = min(cfg.max_samples, n)
    depth = max(1, math.ceil(math.log2(max(size, 2))))
    columns = [F.col(c).cast("double").alias(f"f{i}") for i, c in enumerate(features)]
    keyed = spread(train.select(*columns, *[F.col(c).alias(f"k{i}") for i, c in enumerate(row_key)]))
    keys = [f"k{i}" for i in range(len(row_key))]
    seed = cfg.random_state
    offered = sample_for_trees(keyed, keys, n, cfg.n_estimators, size, seed).drop(*keys)
    width = len(features)

    def grow(rows: pd.DataFrame) -> pd.DataFrame:
        tree = int(rows["tree"].iloc[0])
        names = [f"f{i}" for i in range(width)]
        # Equal tickets mean equal row keys; then the values decide.
        order = ["ticket"] if rows["ticket"].is_unique else ["ticket", *names]
        chosen = rows.sort_values(order).head(size)
        return _grow_tree(chosen[names].to_numpy(), tree, depth, seed)

    # An explicit number of tasks: the samples are small, the work on them is not.
    tasks = min(cfg.n_estimators, task_count(train))
    nodes = offered.repartition(tasks, "tree").groupBy("tree").applyInPandas(grow, NODE_SCHEMA)
    # At most n_estimators x 2^(depth+1) small rows: pinned so that every use sees the same trees.
    grown = train.sparkSession.createDataFrame(nodes.toPandas(), NODE_SCHEMA)
    return ForestModel(features, grown, depth, size, cfg.contamination)


def _grow_tree(x: np.ndarray, tree: int, max_depth: int, seed: int) -> pd.DataFrame:
    """Random cuts down to ``max_depth``; slots are numbered as in a binary heap."""
    rng = np.random.default_rng([seed, tree])
    out = []
    todo = [(0, 0, np.arange(len(x)))]
    while todo:
        slot, depth, rows = todo.pop()
        part = x[rows]
        lo, hi = part.min(axis=0), part.max(axis=0)
        varied = np.flatnonzero(hi > lo)
        if depth >= max_depth or len(rows) <= 1 or len(varied) == 0:
            out.append((tree, slot, -1, np.nan, depth + path_correction(len(rows)), len(rows), depth))
            continue
        feature = int(rng.choice(varied))
        cut = float(rng.uniform(lo[feature], hi[feature]))
        cut = min(cut, float(np.nextafter(hi[feature], lo[feature])))
        out.append((tree, slot, feature, cut, np.nan, len(rows), depth))
        right = part[:, feature] > cut
        todo.append((2 * slot + 1, depth + 1, rows[~right]))
        todo.append((2 * slot + 2, depth + 1, rows[right]))
    return pd.DataFrame(out, columns=["tree", "slot", "feature", "threshold", "path", "n", "depth"])


def _forest_arrays(nodes: pd.DataFrame, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Complete trees: a leaf above the last level passes rows on to its leftmost slot."""
    trees = int(nodes["tree"].max()) + 1
    inner, leaves = 2**depth - 1, 2**depth
    feature = np.zeros((trees, inner), dtype=np.intp)
    cut = np.full((trees, inner), np.inf)
    path = np.zeros((trees, leaves))
    split = nodes[nodes["feature"] >= 0]
    feature[split["tree"], split["slot"]] = split["feature"]
    cut[split["tree"], split["slot"]] = split["threshold"]
    ends = nodes[nodes["feature"] < 0]
    # Going left from slot s for k levels leads to slot (s + 1) * 2^k - 1.
    last = (ends["slot"] + 1) * 2 ** (depth - ends["depth"]) - 1
    path[ends["tree"], last - inner] = ends["path"]
    return feature, cut, path


@dataclass
class WalkedTrees:
    """Trees as complete heaps, walked a level at a time."""

    feature: np.ndarray
    cut: np.ndarray
    path: np.ndarray
    depth: int

    def sums(self, x: np.ndarray) -> np.ndarray:
        """Per row the path lengths of all trees, added in the order of the trees."""
        flat, base = np.ascontiguousarray(x).ravel(), np.arange(len(x)) * x.shape[1]
        total = np.zeros(len(x))
        # All indexes lie inside: "wrap" only spares the check of each.
        for feature, cut, path in zip(self.feature, self.cut, self.path):
            slot = np.zeros(len(x), dtype=np.intp)
            for _ in range(self.depth):
                at = feature.take(slot, mode="wrap")
                at += base
                right = flat.take(at, mode="wrap") > cut.take(slot, mode="wrap")
                slot += slot
                slot += 1
                slot += right
            slot -= len(cut)
            total += path.take(slot, mode="wrap")
        return total


@dataclass
class GriddedTrees:
    """Trees of few features as grids: ``LEVELS`` levels below a node are one look-up.

    The cuts below a node divide each feature's values into intervals, and their
    product into cells; a cell leads to one node further down. A value is ranked once among all cuts
    of its feature; per tree the rank gives the interval among the tree's own cuts (``ranks``), and per step
    the intervals of all features (``parts``) add up to the cell.
    """

    cuts: list[np.ndarray]
    ranks: list[list[np.ndarray]]
    steps: list[list[tuple[list[np.ndarray], np.ndarray]]]

    def sums(self, x: np.ndarray) -> np.ndarray:
        """As for walked trees."""
        rank = [np.searchsorted(cuts, x[:, f]) for f, cuts in enumerate(self.cuts)]
        total = np.zeros(len(x))
        for ranks, steps in zip(self.ranks, self.steps):
            place = [own.take(r, mode="wrap").astype(np.intp) for own, r in zip(ranks, rank)]
            node = None
            for parts, ends in steps:
                cell = None
                for part, at in zip(parts, place):
                    share = part.take(at if node is None else node + at, mode="wrap")
                    cell = share if cell is None else np.add(cell, share, out=cell)
                node = ends.take(cell, mode="wrap")
            total += node
        return total


def _below(root: int, levels: int) -> np.ndarray:
    """The slots of the ``levels`` levels that start at slot ``root``, level by level."""
    return np.concatenate([(root + 1) * 2**i - 1 + np.arange(2**i) for i in range(levels)])


def _scorer(feature: np.ndarray, cut: np.ndarray, path: np.ndarray, depth: int, width: int) -> WalkedTrees | GriddedTrees:
    """Grids where they stay small: that follows the model alone, and the sums are the same."""
    starts = range(0, depth, LEVELS)
    real = cut < np.inf
    cells = 0
    if width <= GRID_FEATURES and depth <= 2 * LEVELS:
        for start in starts:
            for root in range(2**start - 1, 2 ** (start + 1) - 1):
                slots = _below(root, min(LEVELS, depth - start))
                used = [((feature[:, slots] == f) & real[:, slots]).sum(axis=1) + 1 for f in range(width)]
                cells += int(np.prod(used, axis=0, dtype=float).sum())
    if not 0 < cells <= GRID_CELLS:
        return WalkedTrees(feature, cut, path, depth)
    cuts = [np.unique(cut[real & (feature == f)]) for f in range(width)]
    ranks, steps = [], []
    for tree in range(len(cut)):
        own = [np.unique(cut[tree][real[tree] & (feature[tree] == f)]) for f in range(width)]
        ranks.append([
            np.searchsorted(np.searchsorted(cuts[f], own[f]), np.arange(len(cuts[f]) + 1)).astype(np.uint16) for f in range(width)
        ])
        places = max(map(len, own)) + 1
        # The number of each slot's cut among the tree's own cuts of its feature.
        number = np.full(cut.shape[1], places)
        for f in range(width):
            mine = real[tree] & (feature[tree] == f)
            number[mine] = np.searchsorted(own[f], cut[tree][mine])
        steps.append([
            _step(feature[tree], number, path[tree], start, min(LEVELS, depth - start), depth, width, places) for start in starts
        ])
    return GriddedTrees(cuts, ranks, steps)


def _step(
    feature: np.ndarray, number: np.ndarray, path: np.ndarray, start: int, levels: int, depth: int, width: int, places: int
) -> tuple[list[np.ndarray], np.ndarray]:
    """For all nodes of level ``start``: what each feature's interval adds to the cell, and where a cell leads."""
    parts, ends, offset = [[] for _ in range(width)], [], 0
    for node in range(2**start):
        root = 2**start - 1 + node
        slots = _below(root, levels)
        slots = slots[number[slots] < places]
        own = [np.unique(number[slots[feature[slots] == f]]) for f in range(width)]
        shape = [len(o) + 1 for o in own]
        cells = np.indices(shape).reshape(width, -1)
        strides = [int(np.prod(shape[f + 1:], dtype=np.int64)) for f in range(width)]
        for f in range(width):
            interval = np.searchsorted(own[f], np.arange(places))
            parts[f].append(interval * strides[f] + (offset if f == 0 else 0))
        at = np.full(cells.shape[1], root)
        for _ in range(levels):
            bound = np.full(len(at), places)
            for f in range(width):
                mine = (feature[at] == f) & (number[at] < places)
                bound[mine] = np.searchsorted(own[f], number[at[mine]])
            at = 2 * at + 1 + (cells[feature[at], np.arange(len(at))] > bound)
        first = 2 ** (start + levels) - 1
        ends.append(path[at - first] if start + levels == depth else (at - first) * places)
        offset += len(at)
    return [np.concatenate(p).astype(np.intp) for p in parts], np.concatenate(ends)


def _mean_depth(x: np.ndarray, trees: WalkedTrees | GriddedTrees, count: int) -> np.ndarray:
    return np.concatenate([trees.sums(x[at:at + CHUNK]) / count for at in range(0, len(x), CHUNK)] or [np.empty(0)])


def score_rows(model: ForestModel, df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """``keep`` columns plus ``raw_score`` = 2^(-mean depth / c(sample size)); works on streams too.

    Kept columns pass through as they are. A row that lacks a feature has no
    score (null).
    """
    slots = model.nodes.select("tree").distinct().count() * 2 ** (model.depth + 1)
    if slots > MAX_SLOTS:
        raise ValueError(f"trees of {slots} slots exceed the {MAX_SLOTS} that are sent to every task")
    arrays = _forest_arrays(model.nodes.toPandas(), model.depth)
    shared = df.sparkSession.sparkContext.broadcast(_scorer(*arrays, model.depth, len(model.features)))
    count = len(arrays[0])
    keep = list(keep)
    norm = path_correction(model.max_samples) or 1.0
    names = [f"__f{i}" for i in range(len(model.features))]
    rows = spread(df.select(*keep, *[F.col(c).cast("double").alias(n) for c, n in zip(model.features, names)]))
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(SCORE, T.DoubleType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = shared.value
        for batch in batches:
            x = np.column_stack([batch.column(n).to_numpy(zero_copy_only=False) for n in names])
            missing = np.isnan(x).any(axis=1)
            raw = 2.0 ** (-_mean_depth(x, trees, count) / norm)
            kept = [batch.column(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(raw, mask=missing)], [*keep, SCORE])

    return rows.mapInArrow(score, schema)


def calibrate(model: ForestModel, train_scores: DataFrame) -> ForestModel:
    """Set the threshold (upper contamination quantile) and the score range from training scores.

    The scores are read more than once and should be a stored table.
    """
    cut = exact_quantiles(train_scores, SCORE, [1 - model.contamination]).first()["value"]
    lo, hi = train_scores.agg(F.min(SCORE), F.max(SCORE)).first()
    return ForestModel(model.features, model.nodes, model.depth, model.max_samples,
                       model.contamination, cut, lo, hi)


def flag_scores(model: ForestModel, scored: DataFrame, normalise: str = "batch") -> DataFrame:
    """``anomaly_if`` (-1/1), ``anomaly`` (0/1) and ``anomaly_score`` in [0, 1].

    ``normalise="batch"`` spreads the scores of this table over [0, 1];
    ``"model"`` uses the training range, clipped, so that a row's score does
    not depend on the rows scored with it.
    """
    if model.threshold is None:
        raise RuntimeError("the forest has no threshold yet: fit or load one first")
    hit = F.col(SCORE) > F.lit(model.threshold)
    if normalise == "batch":
        span = scored.agg(F.min(SCORE).alias("score_lo"), F.max(SCORE).alias("score_hi"))
        scored = attach(scored, span)
        share = min_max(F.col(SCORE), F.col("score_lo"), F.col("score_hi"))
    else:
        share = min_max(F.col(SCORE), F.lit(model.score_min), F.lit(model.score_max))
        share = F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0))
    return scored.withColumns({
        "anomaly_if": F.when(hit, -1).when(~hit, 1), "anomaly": F.when(hit, 1).when(~hit, 0), "anomaly_score": share,
    }).drop("score_lo", "score_hi")


def forest_result(
    flagged: DataFrame, clean: DataFrame, vitals: Sequence[str], frac: float,
    keys: Sequence[str] = (), ts: str = "timestamp", meta: Sequence[str] = ("patient_id", "was_missing"),
) -> DataFrame:
    """Result table with the measurements in their own units and the chronological split."""
    picked = [c for c in dict.fromkeys((*meta, *vitals)) if c in clean.columns and c not in (*keys, ts)]
    joined = join_on(flagged, clean.select(*keys, ts, *picked), [*keys, ts])
    n = with_length(joined, keys, POS, "series_n")
    return n.withColumn("split", chronological(F.col(POS), F.col("series_n"), frac)).select(
        *keys, POS, ts, *picked, "anomaly_if", "anomaly", "anomaly_score", "split"
    )


def contamination_sweep(df: DataFrame, rates: Sequence[float], score: str = "anomaly_score") -> DataFrame:
    """Per rate: the upper quantile of the score and the rows at or above it."""
    cuts = exact_quantiles(df, score, [1 - c for c in rates])
    wide = cuts.agg(*[
        F.max(F.when(F.abs(F.col("prob") - F.lit(1 - c)) < 1e-12, F.col("value"))).alias(f"t{i}")
        for i, c in enumerate(rates)
    ])
    counted = attach(df.select(score), wide).agg(
        F.count(F.lit(1)).alias("n"),
        *[a for i in range(len(rates)) for a in (
            F.max(f"t{i}").alias(f"t{i}"), F.count_if(F.col(score) >= F.col(f"t{i}")).alias(f"c{i}"))],
    )
    return long_rows(counted, [], [
        {"contamination": F.lit(float(c)), "threshold": F.col(f"t{i}"), "n_flagged": F.col(f"c{i}"),
         "rate": F.col(f"c{i}") / F.col("n")} for i, c in enumerate(rates)
    ])
