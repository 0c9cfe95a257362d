"""Time arithmetic on ``timestamp_ntz`` that does not depend on the session time zone."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, functions as F

DAY_US = 86_400_000_000
# Microseconds per unit of a frequency string.
UNIT_US = {
    "s": 1_000_000,
    "min": 60_000_000,
    "h": 3_600_000_000,
    "d": DAY_US,
}


def freq_micros(freq: str) -> int:
    """``"15min"`` -> microseconds. Units: s, min, h, d."""
    match = re.fullmatch(r"\s*(\d*)\s*(s|min|h|d)\s*", freq.lower())
    if not match or match.group(1) == "0":
        raise ValueError(f"unknown frequency {freq!r}")
    return int(match.group(1) or 1) * UNIT_US[match.group(2)]


def seconds(ts: Column) -> Column:
    """Whole seconds since 1970-01-01, rounded down, as BIGINT."""
    ts = ts.cast("timestamp_ntz")
    of_day = F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)
    return F.unix_date(ts.cast("date")).cast("bigint") * 86_400 + of_day


def micros(ts: Column) -> Column:
    """Microseconds since 1970-01-01 as BIGINT."""
    # Zones differ by whole seconds, so the fraction may come from any zone.
    fraction = F.pmod(F.unix_micros(ts.cast("timestamp")), F.lit(1_000_000))
    return seconds(ts) * F.lit(1_000_000) + fraction


def from_micros(us: Column) -> Column:
    return F.timestamp_add("MICROSECOND", us, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def floor_div(value: Column, step: int) -> Column:
    """Integer division rounding down, also for negative values."""
    return F.call_function("div", value - F.pmod(value, F.lit(step)), F.lit(step))


def minute_of_day(ts: Column) -> Column:
    ts = ts.cast("timestamp_ntz")
    return F.hour(ts) * 60 + F.minute(ts)


def sin_time(ts: Column) -> Column:
    """Sine of the minute of the day on a 24 h circle; seconds are ignored."""
    return F.sin(F.lit(2 * math.pi) * minute_of_day(ts) / 1440)


def cos_time(ts: Column) -> Column:
    return F.cos(F.lit(2 * math.pi) * minute_of_day(ts) / 1440)
