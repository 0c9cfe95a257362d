"""Joining detector results and voting."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import combinations
from operator import add

from pyspark.sql import DataFrame, functions as F

from vitalstream.functions.flags import flag, vote_count
from vitalstream.functions.summary import join_on, long_rows, q


def flag_name(model: str) -> str:
    return f"anomaly_{model}"


def align_results(results: Mapping[str, DataFrame], keys: Sequence[str] = (), ts: str = "timestamp") -> DataFrame:
    """Inner join on keys and time: one flag per model, ``split`` of the first model. Null keys match each other."""
    on = [*keys, ts]
    first, *others = [
        df.select(*on, *(["split"] if i == 0 else []), F.col("anomaly").alias(flag_name(name)))
        for i, (name, df) in enumerate(results.items())
    ]
    return reduce(lambda a, b: join_on(a, b, on), others, first)


def add_votes(merged: DataFrame, models: Sequence[str], min_votes: int = 2) -> DataFrame:
    votes = vote_count([flag_name(m) for m in models])
    return merged.withColumn("vote_count", votes).withColumn(
        "anomaly_ensemble", flag(F.col("vote_count") >= min_votes)
    )


def pairwise_agreement(merged: DataFrame, models: Sequence[str]) -> DataFrame:
    """Share of equal flags and number of rows flagged by both, per pair, in one pass."""
    pairs = list(combinations(models, 2))
    aggs = []
    for i, (a, b) in enumerate(pairs):
        fa, fb = q(flag_name(a)), q(flag_name(b))
        aggs += [f"avg(CAST({fa} = {fb} AS INT)) AS agree{i}",
                 f"count_if({fa} = 1 AND {fb} = 1) AS both{i}"]
    wide = merged.agg(*[F.expr(a) for a in aggs])
    return long_rows(wide, [], [
        {"model_a": F.lit(a), "model_b": F.lit(b), "agreement": F.col(f"agree{i}"), "both_flag": F.col(f"both{i}")}
        for i, (a, b) in enumerate(pairs)
    ])


def rates_by_split(merged: DataFrame, models: Sequence[str]) -> DataFrame:
    """Flagged rows and rate per model (and the ensemble) for train, test and all."""
    names = [*models, *(["ensemble"] if "anomaly_ensemble" in merged.columns else [])]
    wide = merged.rollup("split").agg(
        F.count(F.lit(1)).alias("n"),
        *[a for m in names for a in (
            F.sum(flag_name(m)).cast("bigint").alias(f"sum_{m}"), F.avg(flag_name(m)).alias(f"avg_{m}"))],
    ).withColumn("split", F.coalesce("split", F.lit("all")))
    return long_rows(wide, ["split", "n"], [
        {"model": F.lit(m), "n_flagged": F.col(f"sum_{m}"), "rate": F.col(f"avg_{m}")} for m in names
    ])


def unanimous(merged: DataFrame, n_models: int) -> DataFrame:
    return merged.where(F.col("vote_count") == n_models)


def top_unanimous(merged: DataFrame, n: int = 20, n_models: int = 3, ts: str = "timestamp",
                  keys: Sequence[str] = (), severity: Sequence[str] = ()) -> DataFrame:
    """The earliest ``n`` rows that all models flag; with ``severity`` those with the greatest sum of these score columns.

    A null score counts as 0; equal sums come in time order.
    """
    worst = [reduce(add, [F.coalesce(F.col(q(c)).cast("double"), F.lit(0.0)) for c in severity]).desc()] if severity else []
    return unanimous(merged, n_models).orderBy(*worst, ts, *keys).limit(n)


def unanimous_share(merged: DataFrame, n_models: int = 3) -> DataFrame:
    hit = F.col("vote_count") == n_models
    return merged.agg(F.count_if(hit).alias("n_unanimous"), F.avg(hit.cast("int")).alias("share"))
