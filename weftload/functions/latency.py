"""Latency columns: histogram buckets and effective latency."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values: (upper limit, bucket width) in milliseconds; above the last, the cap.
BANDS = [(100, 1), (1_000, 10), (10_000, 100), (100_000, 1_000)]
CAP = 100_000


def latency_bucket(latency: Column) -> Column:
    """Upper bound of the bucket; samples at or below 0 count as the first bucket."""
    choice = F.when(latency.isNull(), F.lit(None).cast("bigint"))
    for limit, width in BANDS:
        choice = choice.when(
            latency <= limit, F.greatest(F.ceil(latency / width), F.lit(1).cast("bigint")) * width
        )
    return choice.otherwise(F.lit(CAP).cast("bigint"))


def bucket_middle(bucket: Column) -> Column:
    """The value a bucket stands for: its upper bound less half its width."""
    choice = None
    for limit, width in BANDS:
        half = F.lit(width / 2)
        test = bucket <= limit
        choice = F.when(test, half) if choice is None else choice.when(test, half)
    return bucket - choice.otherwise(F.lit(BANDS[-1][1] / 2))


def delayed_latency(service_ms: Column, delay_ms: Column) -> Column:
    """A sample closes when the reply is there and the delay has passed."""
    return F.greatest(service_ms, delay_ms)


def magnitude_bin(value: Column, steps: int = 64) -> Column:
    """Order-preserving bin of a number: equal ratios, ``steps`` bins per doubling.

    Only order matters to its users, so rounding of the logarithm is harmless:
    logarithms are monotone.
    """
    offset = 1 << 20
    # Infinite values share the bin above all others.
    size = F.floor(F.least(F.log2(F.abs(value)), F.lit(1024.0)) * steps) + offset
    return (
        F.when(value == 0, F.lit(0).cast("bigint"))
        .when(value > 0, size)
        .otherwise(-size)
    )
