"""Exact decimal averages and tolerant number parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def exact_avg(total: Column, count: Column) -> Column:
    """Mean of decimals from a sum and a count with 18 digits after the point.

    `avg` on DECIMAL keeps four extra digits only, so rounding its result again could
    differ from rounding the true mean. NULL when nothing was counted.
    """
    return total.cast("decimal(38,18)") / F.nullif(count, F.lit(0)).cast("decimal(20,0)")


def market_mood(mean_change: Column) -> Column:
    """Bullish above 1, Bearish below -1, Neutral otherwise and for NULL."""
    return F.when(mean_change > 1, "Bullish").when(mean_change < -1, "Bearish").otherwise("Neutral")


def clamp(value: Column, low: float | None, high: float | None) -> Column:
    """Limit to [low, high]; NULL stays NULL (`least`/`greatest` alone would skip it)."""
    limited = value
    if high is not None:
        limited = F.least(F.lit(high), limited)
    if low is not None:
        limited = F.greatest(F.lit(low), limited)
    return F.when(value.isNotNull(), limited)


def leading_number(text: Column) -> Column:
    """The number a text starts with, NULL if it starts with something else."""
    head = F.regexp_extract(text, r"^\s*([-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)", 1)
    return head.try_cast("double")


def pct_change(new: Column, old: Column, scale: int = 2) -> Column:
    """Percent change, NULL where the old value is 0 or missing."""
    wide = (new.cast("decimal(20,2)") - old.cast("decimal(20,2)")).cast("decimal(38,18)")
    return F.round(wide / F.nullif(old.cast("decimal(20,2)"), F.lit(0).cast("decimal(20,2)")) * 100, scale)
