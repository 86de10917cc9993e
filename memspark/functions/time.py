"""Ages, decays and bounds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MICROS = 86_400_000_000


def ntz(value: str) -> Column:
    return F.lit(value).cast("timestamp_ntz")


def micros(c: Column) -> Column:
    """Microseconds since the epoch of a naive UTC timestamp."""
    return F.unix_micros(c.cast("timestamp"))


def age_days(as_of: Column, c: Column) -> Column:
    return F.greatest(F.lit(0.0), (micros(as_of) - micros(c)) / F.lit(float(DAY_MICROS)))


def whole_days(as_of: Column, c: Column) -> Column:
    return F.floor((micros(as_of) - micros(c)) / F.lit(float(DAY_MICROS)))


def half_life(age: Column, days: float) -> Column:
    return F.pow(F.lit(2.0), -age / F.lit(float(days)))


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """Null stays null (``least`` and ``greatest`` alone would skip it)."""
    return F.when(c.isNotNull(), F.least(F.lit(high), F.greatest(F.lit(low), c)))
