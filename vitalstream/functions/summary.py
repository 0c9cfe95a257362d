"""Joining small summaries back to rows, and turning wide summaries into long tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F

from vitalstream.sources.tables import materialise


def q(name: str) -> str:
    """A column name quoted for SQL text."""
    return "`" + name.replace("`", "``") + "`"


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on equally named columns, which come once; null keys match each other."""
    if not keys:
        raise ValueError("a join needs keys")
    inner = {k: f"__right_{i}" for i, k in enumerate(keys)}
    right = right.withColumnsRenamed(inner)
    same = reduce(and_, [left[q(k)].eqNullSafe(right[n]) for k, n in inner.items()])
    joined = left.join(right, same, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*inner.values())


def attach(df: DataFrame, stats: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Add the columns of a per-key summary to every row.

    Without keys the summary has one row and is read as a scalar subquery: it
    is computed once and costs neither a join nor a shuffle of ``df``. With
    keys it is stored first, so that the planner knows its true size: a small
    one is broadcast and ``df`` stays where it is, a large one is joined by a
    shuffle that adaptive execution splits at hot keys.
    """
    names = [c for c in stats.columns if c not in keys]
    if keys:
        return join_on(df, materialise(stats, "summary"), keys, "left")
    # One subquery column, taken apart in a second step: a subquery per column
    # would multiply the plan when summaries build on each other.
    cell = stats.select(F.struct(*names).alias("cell")).scalar()
    kept = [q(c) for c in df.columns if c not in names]
    return df.withColumn("__cell", cell).selectExpr(*kept, *[f"__cell.{q(c)} AS {q(c)}" for c in names])


def totals(df: DataFrame, keys: Sequence[str], **aggs: Column) -> DataFrame:
    return df.groupBy(*keys).agg(*[c.alias(n) for n, c in aggs.items()])


def long_rows(wide: DataFrame, ids: Sequence[str], rows: Sequence[Mapping[str, Column]]) -> DataFrame:
    """One output row per mapping and input row; meant for aggregate results."""
    structs = [F.struct(*[c.alias(n) for n, c in row.items()]) for row in rows]
    return wide.select(*ids, F.explode(F.array(*structs)).alias("r")).select(*ids, "r.*")


def long_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``i, v``: every value of the i-th column as a row of its own.

    Statistics of many columns are taken from this by ``groupBy("i")``: a
    single aggregation of hundreds of expressions generates a method that the
    JVM does not compile.
    """
    values = ", ".join(f"CAST({q(c)} AS DOUBLE)" for c in cols)
    return df.selectExpr(f"posexplode(array({values})) AS (i, v)")
