"""Row-wise expressions for limits, flags, votes and scores."""

from __future__ import annotations

from functools import reduce
from operator import add, or_

from pyspark.sql import Column, functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def flag(condition: Column) -> Column:
    """1 where the condition holds, 0 where it is false or unknown."""
    return F.when(condition, 1).otherwise(0)


def within(c: str | Column, lo: float, hi: float) -> Column:
    """The value if inside the closed range, else null (it is not clamped)."""
    c = col(c).cast("double")
    return F.when(c.between(lo, hi), c)


def outside(c: str | Column, lo: float, hi: float) -> Column:
    c = col(c)
    return (c < F.lit(lo)) | (c > F.lit(hi))


def any_missing(cols: list[str]) -> Column:
    return flag(reduce(or_, [F.col(c).isNull() for c in cols]))


def vote_count(flags: list[str]) -> Column:
    return reduce(add, [F.coalesce(F.col(c), F.lit(0)) for c in flags]).cast("int")


def label(c: str | Column) -> Column:
    """0/1 flag -> "normal"/"anomaly"."""
    return F.when(col(c) == 1, "anomaly").when(col(c) == 0, "normal")


def ratio(a: Column, b: Column) -> Column:
    """a / b, and null where b is zero or null (ANSI mode would raise)."""
    return F.when(b != 0, a / b)


def min_max(score: Column, lo: Column, hi: Column, eps: float = 1e-8) -> Column:
    return (score - lo) / (hi - lo + F.lit(eps))


def chronological(pos: Column, n: Column, frac: float) -> Column:
    """"train" for the first ``int(n * frac)`` positions, "test" after them."""
    return F.when(pos < F.floor(n * F.lit(float(frac))), "train").otherwise("test")
