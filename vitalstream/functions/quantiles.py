"""Exact quantiles that do not need all values in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from vitalstream.functions.summary import join_on, q
from vitalstream.sources.tables import materialise

# Up to this many rows of a group the built-in aggregate may hold every distinct value.
EXACT_ROWS = 2_000_000
# Bins of the first round for each factor of e (about 1,024 for each of 2); beyond ``FAR`` of them lie only infinities.
PER_E, FAR = 1477, 1 << 21
# Parts of a bracket in a later round.
PARTS = 1024


def exact_quantiles(
    df: DataFrame, value: str | Column, probs: Sequence[float], by: Sequence[str] = (),
    exact_rows: int = EXACT_ROWS,
) -> DataFrame:
    """``by..., prob, value``: quantiles with linear interpolation, nulls skipped.

    Small groups use ``percentile``. That aggregate keeps all distinct values
    of a group in one buffer, so larger groups are narrowed first: one pass counts the
    rows by intervals of the logarithm, which brackets each wanted rank. Rounds that cut the
    brackets into equal parts go on until each holds at most ``exact_rows`` rows or a
    single value, and a last one counts the values themselves.
    """
    value = F.col(value) if isinstance(value, str) else value
    # Keys get names of their own, so that none meets an inner column. A null key is a group.
    keys = [f"g{i}" for i in range(len(by))]
    named = [F.col(q(c)).alias(n) for c, n in zip(by, keys)]
    rows = df.select(*named, value.cast("double").alias("v")).where(F.col("v").isNotNull())
    largest = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    if largest <= exact_rows:
        grid = rows.groupBy(*keys).agg(F.percentile("v", F.array(*[F.lit(float(p)) for p in probs])).alias("vs"))
        pairs = F.arrays_zip(F.array(*[F.lit(float(p)) for p in probs]).alias("prob"), F.col("vs").alias("value"))
        out = grid.select(*keys, F.explode(pairs).alias("z")).select(*keys, "z.prob", "z.value")
    else:
        out = _by_brackets(rows, probs, keys, exact_rows)
    return out.select(*[F.col(n).alias(c) for c, n in zip(by, keys)], "prob", "value")


def _by_brackets(rows: DataFrame, probs: Sequence[float], keys: Sequence[str], exact_rows: int) -> DataFrame:
    rows = rows.withColumn("bin", _bin(F.col("v")))
    bins = materialise(rows.groupBy(*keys, "bin").agg(*_ends()), "bins")
    rank = F.col("prob") * (F.col("n") - 1)
    targets = materialise(
        bins.groupBy(*keys).agg(F.sum("inside").alias("n"))
        .withColumn("prob", F.explode(F.array(*[F.lit(float(p)) for p in probs])))
        .withColumns({"k0": F.floor(rank), "part": rank - F.floor(rank)})
        .withColumn("k1", F.least(F.col("k0") + 1, F.col("n") - 1)),
        "ranks",
    )
    ranks = targets.select(*keys, F.explode(F.array("k0", "k1")).alias("k")).distinct()
    before = F.sum("inside").over(Window.partitionBy(*keys).orderBy("bin")) - F.col("inside")
    listed = bins.withColumn("below", before)
    brackets = _holding(join_on(ranks, listed, keys) if keys else ranks.crossJoin(listed))
    while True:
        brackets = materialise(brackets, "brackets")
        widest = brackets.where("lo < hi").agg(F.max("inside")).first()[0]
        if widest is None:
            break
        share = F.floor((F.col("v") - F.col("first")) / (F.col("last") - F.col("first")) * PARTS)
        brackets = _narrow(rows, brackets, keys, F.col("v") if widest <= exact_rows else share)
    found = brackets.select(*keys, "k", F.col("lo").alias("v"))
    low = found.withColumnsRenamed({"k": "k0", "v": "v0"})
    high = found.withColumnsRenamed({"k": "k1", "v": "v1"})
    out = join_on(join_on(targets, low, [*keys, "k0"]), high, [*keys, "k1"])
    value = F.col("v0") + F.col("part") * (F.col("v1") - F.col("v0"))
    return out.select(*keys, "prob", value.alias("value"))


def _bin(v: Column) -> Column:
    """A whole number that never falls as the value grows: intervals of the logarithm, and 0, NaN and infinities apart."""
    size = F.floor(F.least(F.log(F.abs(v)) * PER_E, F.lit(FAR))) + 2 * FAR
    return F.when(F.isnan(v), 4 * FAR).when(v > 0, size).when(v < 0, -size).otherwise(0)


def _ends() -> list[Column]:
    return [F.count(F.lit(1)).alias("inside"), F.min("v").alias("lo"), F.max("v").alias("hi")]


def _holding(brackets: DataFrame) -> DataFrame:
    """Of a rank's possible brackets the one it lies in."""
    return brackets.where((F.col("k") >= F.col("below")) & (F.col("k") < F.col("below") + F.col("inside")))


def _narrow(rows: DataFrame, brackets: DataFrame, keys: Sequence[str], part: Column) -> DataFrame:
    """Brackets of more than one value are cut into parts, in the order of ``part``; the part of each rank is kept."""
    span = [*keys, "bin", "first", "last"]
    wide = brackets.where("lo < hi").withColumnsRenamed({"lo": "first", "hi": "last"})
    spans = wide.select(*span, F.col("below").alias("start")).distinct()
    # Rows meet the few brackets of their bin; brackets of a bin do not overlap.
    inside = join_on(rows, spans, [*keys, "bin"]).where(F.col("v").between(F.col("first"), F.col("last")))
    parts = inside.withColumn("part", part).groupBy(*span, "start", "part").agg(*_ends())
    running = F.sum("inside").over(Window.partitionBy(*span).orderBy("part"))
    parts = parts.withColumn("below", F.col("start") + running - F.col("inside"))
    held = _holding(join_on(wide.select(*span, "k"), parts, span))
    columns = [*keys, "k", "bin", "lo", "hi", "inside", "below"]
    return held.select(*columns).unionByName(brackets.where("NOT lo < hi").select(*columns))
