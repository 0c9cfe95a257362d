"""Additive forecast: piecewise-linear trend plus daily seasonality.

The fit reads the data once: every task sums the Gram matrix of its rows, the
sums meet per series, and a small solve per series yields the coefficients.
Many series are fitted in the same job.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from statistics import NormalDist

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from vitalstream.config import ForecastConfig
from vitalstream.functions.flags import chronological, flag, ratio
from vitalstream.functions.summary import attach, join_on, q, totals
from vitalstream.functions.timeline import DAY_US, micros
from vitalstream.operators.blocks import BLOCK, POS, carry_sum, number_rows, spread, with_block
from vitalstream.operators.clean import require_columns
from vitalstream.sources.tables import materialise, require_table, write_table

SERIES = "series"
# Prior standard deviations of slope/offset and of the seasonal terms.
TREND_PRIOR_SD = 5.0
SEASON_PRIOR_SD = 10.0
# Gram sums a task may hold before it hands them on.
MAX_OPEN_SERIES = 500
# Rounds in which blocks of time are cut anew.
MAX_CUTS = 12


def to_long(df: DataFrame, targets: Sequence[str], ts: str = "timestamp", keys: Sequence[str] = ()) -> DataFrame:
    """``keys..., series, ds, y``: one row per target and time, rows without a value dropped; ``pos`` is kept if there."""
    require_columns(df, [ts, *targets, *keys])
    ids = [*keys, *([POS] if POS in df.columns else [])]
    long = df.select(*ids, F.col(ts).alias("ds"), *[F.col(c).cast("double").alias(c) for c in targets])
    return long.unpivot([*ids, "ds"], list(targets), SERIES, "y").where(F.col("y").isNotNull())


def prepare_target(df: DataFrame, target: str, ts: str = "timestamp") -> DataFrame:
    """``ds, y`` of one target, rows without a value dropped."""
    require_columns(df, [ts, target])
    return df.select(F.col(ts).alias("ds"), F.col(target).cast("double").alias("y")).dropna("any", subset=["y"])


def number_series(long: DataFrame, frac: float, by: Sequence[str] = (SERIES,), block_rows: int = 4096) -> DataFrame:
    """Add ``pos`` and ``split`` to ``by..., ds, y``. A time that repeats within a series is an error.

    Rows that have a ``pos`` already are numbered along it, as it grows with
    time; else blocks are cut from the time.
    """
    timed = long.withColumn("__us", micros(F.col("ds")))
    if POS in long.columns:
        slot = timed.withColumn("__tick", F.col(POS)).drop(POS)
    else:
        slot = _slots_of_time(timed, by, block_rows)
    # Microseconds give the order; ticks only cut the blocks.
    numbered = number_rows(slot, by, "__us", block_rows, POS, cut="__tick", unique=True).drop("__us", "__tick")
    counts = totals(numbered, by, __n=F.count(F.lit(1)))
    return attach(numbered, counts, by).withColumn("split", chronological(F.col(POS), F.col("__n"), frac)).drop("__n")


def _slots_of_time(timed: DataFrame, by: Sequence[str], block_rows: int) -> DataFrame:
    """Add ``__tick``, an estimate of a row's position that grows with time.

    It starts as the share of the time span. As long as a block of ticks holds
    more than twice its rows, the estimate is redone inside the blocks from
    their own time spans and counts, so that a stray early time or a burst does
    not put a series into one block.
    """
    span = totals(timed, by, __lo=F.min("__us"), __hi=F.max("__us"), __m=F.count(F.lit(1)))
    share = (F.col("__us") - F.col("__lo")) * F.lit(1.0) / F.greatest(F.col("__hi") - F.col("__lo"), F.lit(1))
    tick = F.floor(share * (F.col("__m") - 1)).cast("bigint")
    slot = attach(timed, span, by).withColumn("__tick", tick).drop("__lo", "__hi", "__m")
    for _ in range(MAX_CUTS):
        blocked = with_block(slot, block_rows, "__tick")
        counts = materialise(totals(
            blocked, [*by, BLOCK], __lo=F.min("__us"), __hi=F.max("__us"), __m=F.count(F.lit(1))
        ), "slots")
        if (counts.where("__lo < __hi").agg(F.max("__m")).first()[0] or 0) <= 2 * block_rows:
            break
        counts = join_on(counts, carry_sum(counts, by, "__m", "__before").select(*by, BLOCK, "__before"), [*by, BLOCK])
        slot = join_on(blocked, counts, [*by, BLOCK]).withColumn("__tick", F.col("__before") + tick).drop(
            BLOCK, "__lo", "__hi", "__m", "__before"
        )
    return slot


def fit_forecast(numbered: DataFrame, cfg: ForecastConfig = ForecastConfig(), by: Sequence[str] = (SERIES,)) -> DataFrame:
    """Coefficient table, one row per series, from the rows with ``split = 'train'``.

    A series that cannot be fitted gets a row whose ``status`` says why; the
    others are not affected.
    """
    train = numbered.where(F.col("split") == "train").withColumn("us", micros(F.col("ds")))
    stats = totals(
        train, by, n=F.count(F.lit(1)), t0=F.min("us"),
        span=(F.max("us") - F.min("us")).cast("double"), y_scale=F.max(F.abs("y")),
    )
    # Changepoints lie on evenly spaced rows of the first 80 % of the training rows.
    history = F.floor(F.col("n") * 0.8).cast("bigint")
    count = F.greatest(F.least(F.lit(cfg.n_changepoints).cast("bigint"), history - 1), F.lit(0).cast("bigint"))
    marks = (
        stats.withColumns({"history": history, "count": count}).where("count > 0")
        .select(*by, "t0", "span", "count", "history", F.explode(F.expr("sequence(1L, count)")).alias("j"))
        .withColumn(POS, F.rint(F.col("j") * (F.col("history") - 1) / F.col("count")).cast("bigint"))
    )
    at = ratio(F.col("us") - F.col("t0"), F.col("span"))
    # Stored, so that their known size lets the planner leave the rows in place.
    marks = materialise(marks, "marks")
    points = join_on(marks, train.select(*by, POS, "us"), [*by, POS]).groupBy(*by).agg(
        F.sort_array(F.collect_list(at)).alias("changepoints")
    )
    points = join_on(stats, points, by, "left") if by else attach(stats, points)
    points = points.withColumns({
        "changepoints": F.coalesce("changepoints", F.array().cast("array<double>")),
        "span": F.greatest("span", F.lit(1.0)),
        "y_scale": F.when(F.col("y_scale") > 0, F.col("y_scale")).otherwise(1.0),
    })
    # One small row per series; it is joined to the rows and to the solution.
    points = materialise(points, "changepoints")
    inner = {c: f"__{c}" for c in ("us", "y", "t0", "span", "y_scale", "changepoints")}
    rows = attach(
        train.select(*by, *[F.col(c).alias(inner[c]) for c in ("us", "y")]),
        points.select(*by, *[F.col(c).alias(inner[c]) for c in ("t0", "span", "y_scale", "changepoints")]), by,
    )
    order, size = cfg.fourier_order, 2 + cfg.n_changepoints + 2 * cfg.fourier_order + 1
    width = cfg.n_changepoints
    key_fields = [numbered.schema[c] for c in by]
    key_ddl = "".join(f"{q(f.name)} {f.dataType.simpleString()}, " for f in key_fields)
    upper = np.triu_indices(size)

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One packed triangle per series and task, of all the batches of the task."""
        open_sums: dict[tuple, np.ndarray] = {}

        def emit() -> pa.RecordBatch:
            keys = [pa.array(list(v), schema.field(c).type) for c, v in zip(by, zip(*open_sums))]
            packed = pa.array([g[upper] for g in open_sums.values()], pa.list_(pa.float64()))
            open_sums.clear()
            return pa.RecordBatch.from_arrays([*keys, packed], [*by, "__gram"])

        for batch in batches:
            schema = batch.schema
            us, t0, span, y, y_scale = (
                batch.column(c).to_numpy(zero_copy_only=False) for c in ("__us", "__t0", "__span", "__y", "__y_scale")
            )
            columns = {"us": us, "t0": t0, "span": span, "changepoints": batch.column("__changepoints")}
            x = np.column_stack([_design(columns, width, order), y / y_scale])
            for key, rows in _series_rows(batch, by):
                part = x[rows]
                open_sums[key] = open_sums.get(key, 0.0) + part.T @ part
            if len(open_sums) > MAX_OPEN_SERIES:
                yield emit()
        if open_sums:
            yield emit()

    packed = spread(rows).mapInArrow(grams, key_ddl + "__gram array<double>")
    scale = cfg.changepoint_prior_scale

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Adds up the triangles of a series, which follow each other, and solves each series once."""
        names = ["slope", "intercept", "deltas", "season", "sigma", "status"]
        kinds = [pa.float64(), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.float64(), pa.string()]
        key, total = None, None

        def table(done: list[tuple]) -> pa.RecordBatch:
            columns = zip(*[(*k, *_solution(g, upper, size, width, order, scale)) for k, g in done])
            kept = [*[schema.field(c).type for c in by], *kinds]
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kept)], [*by, *names])

        for batch in batches:
            schema, done = batch.schema, []
            found = zip(*[batch.column(c).to_pylist() for c in by]) if by else iter([()] * batch.num_rows)
            for k, gram in zip(found, batch.column("__gram")):
                gram = gram.values.to_numpy()
                if total is not None and k == key:
                    total = total + gram
                    continue
                if total is not None:
                    done.append((key, total))
                key, total = k, gram
            if done:
                yield table(done)
        if total is not None:
            yield table([(key, total)])

    # The sums of a series come to one task as a stream: two are held at a time.
    together = packed.repartition(*by).sortWithinPartitions(*by) if by else packed.repartition(1)
    solved = together.mapInArrow(
        solve, key_ddl + "slope double, intercept double, deltas array<double>, season array<double>, sigma double, status string"
    )
    model = join_on(points, solved, by) if by else attach(points, solved)
    return model.withColumn("status", F.when(F.col("n") < 2, "failed: fewer than 2 rows").otherwise(F.col("status")))


def _series_rows(batch: pa.RecordBatch, by: Sequence[str]) -> Iterator[tuple[tuple, np.ndarray]]:
    """Key and row numbers of each series of a batch; null keys are a series too."""
    if not batch.num_rows:
        return
    code = np.zeros(batch.num_rows, np.int64)
    for c in by:
        one = batch.column(c).dictionary_encode(null_encoding="encode").indices.to_numpy()
        code = np.unique(code * (one.max() + 1) + one, return_inverse=True)[1]
    order = np.argsort(code, kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(code[order])) + 1):
        yield tuple(batch.column(c)[int(rows[0])].as_py() for c in by), rows


def _design(part: Mapping, width: int, order: int) -> np.ndarray:
    """Slope, offset, hinges and daily harmonics of every row; ``part`` holds ``us``, ``t0``, ``span`` and ``changepoints``."""
    us, t0, span = (np.asarray(part[c]) for c in ("us", "t0", "span"))
    t = (us - t0) / span
    points = np.full((len(t), width), np.inf)
    lists = part["changepoints"]
    lists = lists if isinstance(lists, pa.Array) else pa.array(lists)
    points[np.arange(width) < np.asarray(pc.list_value_length(lists))[:, None]] = lists.flatten().to_numpy()
    hinges = np.maximum(t[:, None] - points, 0.0)
    angle = 2 * math.pi * (us % DAY_US) / DAY_US
    waves = [f(k * angle) for k in range(1, order + 1) for f in (np.sin, np.cos)]
    return np.column_stack([t, np.ones_like(t), hinges, *waves])


def _solution(gram: np.ndarray, upper: tuple, size: int, width: int, order: int, scale: float) -> tuple:
    full = np.zeros((size, size))
    full[upper] = gram
    full = full + np.triu(full, 1).T
    try:
        beta, sigma = _map_estimate(full, width, order, scale)
        status = "ok"
    except (np.linalg.LinAlgError, ValueError) as problem:
        beta, sigma, status = np.full(size - 1, np.nan), np.nan, f"failed: {problem}"
    return beta[0], beta[1], beta[2:2 + width], beta[2 + width:], sigma, status


def _map_estimate(gram: np.ndarray, width: int, order: int, scale: float) -> tuple[np.ndarray, float]:
    """Posterior mode under normal priors and a Laplace prior on the hinges.

    The Laplace prior is met by re-weighted ridge steps; hinge columns are
    collinear, so the penalised system is solved and never inverted.
    """
    xx, xy, yy = gram[:-1, :-1], gram[:-1, -1], gram[-1, -1]
    n = xx[1, 1]
    if not np.isfinite(gram).all():
        raise ValueError("values that are not finite")
    hinges = slice(2, 2 + width)
    penalty = np.full(len(xy), 1 / SEASON_PRIOR_SD**2)
    penalty[:2] = 1 / TREND_PRIOR_SD**2
    delta = np.full(width, scale)
    noise = max(yy / n, 1e-12)
    beta = np.zeros(len(xy))
    for _ in range(200):
        penalty[hinges] = 1 / (scale * np.maximum(np.abs(delta), 1e-8))
        new = np.linalg.solve(xx / noise + np.diag(penalty), xy / noise)
        moved = np.abs(new - beta).max()
        beta, delta = new, new[hinges]
        noise = max((yy - 2 * beta @ xy + beta @ xx @ beta) / n, 1e-12)
        if moved < 1e-10:
            break
    return beta, float(np.sqrt(noise))


def predict(numbered: DataFrame, model: DataFrame, cfg: ForecastConfig = ForecastConfig(), by: Sequence[str] = (SERIES,)) -> DataFrame:
    """Add ``yhat, yhat_lower, yhat_upper`` as column expressions.

    The bounds use the closed-form variance of noise plus future trend changes.
    """
    # Arrays are folded by a lambda: written out, the terms make a method that
    # the JVM does not compile.
    rate = "coalesce(aggregate(deltas, 0D, (a, d) -> a + abs(d)) / nullif(size(deltas), 0), 0D) AS rate"
    names = ["t0", "span", "y_scale", "changepoints", "slope", "intercept", "deltas", "season", "sigma"]
    coefficients = model.selectExpr(*[q(c) for c in by], *names, rate)
    rows = attach(numbered.withColumn("us", micros(F.col("ds"))), coefficients, by)
    rows = rows.withColumns({
        "t": (F.col("us") - F.col("t0")) / F.col("span"),
        "angle": F.pmod(F.col("us"), F.lit(DAY_US)) * F.lit(2 * math.pi / DAY_US),
    })
    hinges = ("aggregate(zip_with(changepoints, slice(deltas, 1, size(changepoints)), "
              "(c, d) -> d * greatest(t - c, 0D)), 0D, (a, x) -> a + x)")
    waves = " + ".join(
        f"get(season, {2 * k}) * sin({k + 1} * angle) + get(season, {2 * k + 1}) * cos({k + 1} * angle)"
        for k in range(cfg.fourier_order)
    )
    z = NormalDist().inv_cdf((1 + cfg.interval_width) / 2)
    future = f"2 * rate * rate * {cfg.n_changepoints} * pow(greatest(t - 1, 0D), 3) / 3"
    rows = rows.selectExpr(
        *[q(c) for c in numbered.columns],
        f"y_scale * (slope * t + intercept + {hinges} + {waves or '0D'}) AS yhat",
        f"{z!r}D * y_scale * sqrt(sigma * sigma + {future}) AS half",
    )
    return rows.withColumns({
        "yhat_lower": F.col("yhat") - F.col("half"), "yhat_upper": F.col("yhat") + F.col("half"),
    }).drop("half")


def merge_forecast(actuals: DataFrame, forecast: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Left join of a forecast made elsewhere on ``ds``."""
    return join_on(actuals, forecast.select(*by, "ds", "yhat", "yhat_lower", "yhat_upper"), [*by, "ds"], "left")


def flag_interval(df: DataFrame) -> DataFrame:
    """Residual, score (residual over half the interval) and flag outside the interval."""
    half = (F.col("yhat_upper") - F.col("yhat_lower")) / 2
    residual = F.col("y") - F.col("yhat")
    return df.withColumns({
        "residual": residual,
        "anomaly_score": F.when(half > 0, F.abs(residual) / half).otherwise(0.0),
        "anomaly": flag((F.col("y") < F.col("yhat_lower")) | (F.col("y") > F.col("yhat_upper"))),
    })


def flag_by_residual(
    df: DataFrame, z_thresh: float = 3.0, fit_on: str = "all", by: Sequence[str] = ()
) -> DataFrame:
    """``residual_zscore`` (ddof 1) and ``anomaly_residual`` where it exceeds the threshold.

    ``fit_on="train"`` takes mean and deviation from the training rows only.
    """
    rows = df if fit_on == "all" else df.where(F.col("split") == fit_on)
    stats = totals(rows, by, res_mean=F.avg("residual"), res_std=F.stddev_samp("residual"))
    z = ratio(F.col("residual") - F.col("res_mean"), F.col("res_std"))
    scored = attach(df, stats, by).withColumn("residual_zscore", z).drop("res_mean", "res_std")
    return scored.withColumn("anomaly_residual", flag(F.abs("residual_zscore") > F.lit(float(z_thresh))))


def forecast_and_flag(
    numbered: DataFrame, model: DataFrame, cfg: ForecastConfig = ForecastConfig(), by: Sequence[str] = (SERIES,)
) -> DataFrame:
    flagged = flag_interval(predict(numbered, model, cfg, by))
    return flag_by_residual(flagged, cfg.z_thresh, by=by)


def forecast_all(
    df: DataFrame, targets: Sequence[str], cfg: ForecastConfig = ForecastConfig(), ts: str = "timestamp",
    block_rows: int = 4096, keys: Sequence[str] = (),
) -> tuple[DataFrame, DataFrame]:
    """Fit and score every target of every key in one job: result table and status per key and target.

    Keys may have any name; one that is a name of the result comes back as ``key_<name>``.
    """
    inner = {c: f"__key_{i}" for i, c in enumerate(keys)}
    present, by = [c for c in targets if c in df.columns], [*inner.values(), SERIES]
    # Keys are copied, so that a column may be key and target.
    copied = df.withColumns({n: F.col(q(c)) for c, n in inner.items()})
    numbered = number_series(to_long(copied, present, ts, list(inner.values())), cfg.train_split, by, block_rows)
    numbered = materialise(numbered, "series")
    model = materialise(fit_forecast(numbered, cfg, by), "forecast-model")
    wanted = F.explode(F.array(*[F.lit(c) for c in targets])).alias(SERIES)
    ids = list(inner.values())
    wanted = copied.select(*ids).distinct().select(*ids, wanted) if keys else df.sparkSession.range(1).select(wanted)
    known = join_on(wanted, model.select(*by, "n", "status"), by, "left")
    status = known.withColumn("n", F.coalesce("n", F.lit(0).cast("bigint"))).withColumn(
        "status", F.coalesce("status", F.when(F.col(SERIES).isin(present), "failed: no training rows").otherwise("failed: no such column"))
    )
    good = join_on(numbered, model.where("status = 'ok'").select(*by), by, "left_semi")
    return _named_keys(forecast_and_flag(good, model, cfg, by), inner), _named_keys(status, inner)


def _named_keys(df: DataFrame, inner: dict[str, str]) -> DataFrame:
    taken = {c.lower() for c in df.columns}
    return df.withColumnsRenamed({n: f"key_{c}" if c.lower() in taken else c for c, n in inner.items()})


def save_forecast(model: DataFrame, path: str) -> None:
    write_table(model, path)


def load_forecast(spark: SparkSession, path: str) -> DataFrame:
    return require_table(spark, path)
