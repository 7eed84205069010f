"""Figures as short text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KB, MB, GB = 1 << 10, 1 << 20, 1 << 30


def mmss(seconds: Column) -> Column:
    """``mm:ss``, minutes unbounded."""
    whole = F.floor(seconds)
    return F.format_string("%02d:%02d", F.floor(whole / 60), whole % 60)


def elapsed(seconds: Column) -> Column:
    """``250ms``, ``12.5s`` or ``03:20``."""
    return (
        F.when(seconds < 1, F.format_string("%dms", F.round(seconds * 1000).cast("bigint")))
        .when(seconds < 60, F.format_string("%.1fs", seconds.cast("double")))
        .otherwise(mmss(seconds))
    )


def byte_size(amount: Column) -> Column:
    """B, KB and MB rounded, GB with two decimals; the sign is kept."""
    size = F.abs(amount)

    def whole(unit: int) -> Column:
        return F.round(size / unit).cast("bigint")

    text = (
        F.when(size >= GB, F.format_string("%.2fGB", size / GB))
        .when(size >= MB, F.format_string("%dMB", whole(MB)))
        .when(size >= KB, F.format_string("%dKB", whole(KB)))
        .otherwise(F.format_string("%dB", size.cast("bigint")))
    )
    return F.concat(F.when(amount < 0, F.lit("-")).otherwise(F.lit("")), text)


def short_count(number: Column) -> Column:
    """Thousands, millions and billions with one decimal."""
    choice = None
    for unit, letter in ((10**9, "B"), (10**6, "M"), (10**3, "K")):
        text = F.format_string(f"%.1f{letter}", number / unit)
        test = number >= unit
        choice = F.when(test, text) if choice is None else choice.when(test, text)
    return choice.otherwise(number.cast("string"))


def rate_text(rate: Column) -> Column:
    """``1.5K`` from a thousand on, whole numbers below."""
    return F.when(rate >= 1000, F.format_string("%.1fK", rate / 1000)).otherwise(
        F.round(rate).cast("bigint").cast("string")
    )


def clock(ts: Column) -> Column:
    return F.date_format(ts, "HH:mm:ss")
