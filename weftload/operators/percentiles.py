"""Nearest-rank percentiles over any number of samples, exact or by histogram.

The exact form narrows down by counting instead of sorting: a first pass counts the
samples per order-preserving bin, which names the bin that holds each wanted rank; every
further pass cuts the picked intervals into parts and picks the part that holds the rank,
until it is a single value. An interval of few samples is cut into its values at once.
Every pass aggregates before it shuffles, so the shuffles carry one row per
part and task, no matter how many samples a key has. A sort-based or a
``percentile_disc`` aggregate would bring all distinct values of a key to one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftload.functions.latency import bucket_middle, latency_bucket, magnitude_bin
from weftload.session import written_table

FINE_BINS = 4096
#: Intervals with at most so many samples are cut into values; bounds what a window sees.
FEW_SAMPLES = 1 << 16


def nearest_rank(total: Column, percent: Column) -> Column:
    """1-based nearest rank in whole numbers: ceil(n * p / 100), at least 1."""
    rank = F.call_function("div", total * percent + 99, F.lit(100).cast("bigint"))
    return F.greatest(rank, F.lit(1).cast("bigint"))


def count_bins(
    samples: DataFrame, keys: Sequence[str], value: str, extra: dict[str, Column] | None = None
) -> DataFrame:
    """First pass: samples per (key, bin). ``extra`` adds grouping columns that are
    functions of the value; they ride along for free."""
    extra = extra or {}
    v = F.col(value).cast("double")
    return (
        samples.where(v.isNotNull() & ~F.isnan(v))
        .select(*keys, v.alias("_v"), magnitude_bin(v).alias("_bin"),
                *[c.alias(n) for n, c in extra.items()])
        .groupBy(*keys, "_bin", *extra)
        .agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    )


def _cover(counted: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Adds how many samples lie before a row and up to it."""
    upto = Window.partitionBy(*keys).orderBy(order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    return counted.withColumn("_upto", F.sum("_n").over(upto)).withColumn(
        "_before", F.col("_upto") - F.col("_n")
    )


def exact_percentiles(
    samples: DataFrame,
    keys: Sequence[str],
    value: str,
    percents: Sequence[int],
    prefix: str = "p",
    bins: DataFrame | None = None,
    few: int = FEW_SAMPLES,
) -> DataFrame:
    """One row per key with ``p<percent>`` columns: sorted[ceil(n * p / 100) - 1].

    Samples that are null or not a number are left out.

    ``bins`` may pass in the (materialised) result of ``count_bins``. The tables that say
    where to look further are written to the shared folder, so that the optimizer knows
    their size when it chooses how to join them with the samples.
    """
    keys = list(keys)
    if bins is None:
        bins = written_table(count_bins(samples, keys, value), "bins")
    bins = bins.groupBy(*keys, "_bin").agg(
        F.sum("_n").alias("_n"), F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi")
    )
    total = Window.partitionBy(*keys)
    wanted = F.explode(F.array(*[F.lit(p) for p in percents]))
    picks = (
        _cover(bins, keys, "_bin")
        .withColumn("_total", F.sum("_n").over(total))
        .withColumn("_p", wanted)
        .withColumn("_rank", nearest_rank(F.col("_total"), F.col("_p")))
        .where("_before < _rank AND _rank <= _upto")
        .select(*keys, "_p", "_bin", "_lo", "_hi", "_n",
                (F.col("_rank") - F.col("_before")).alias("_rank"))
    )
    picks = written_table(picks, "picks")
    v = F.col(value).cast("double")
    base = samples.where(v.isNotNull() & ~F.isnan(v)).select(*keys, v.alias("_v"))
    while not picks.where("_lo < _hi").isEmpty():
        picks = written_table(_finer(base, keys, picks, few), "picks")
    exact = picks.select(*keys, "_p", F.col("_lo").alias("_v"))
    return exact.groupBy(*keys).agg(
        *[F.max(F.when(F.col("_p") == p, F.col("_v"))).alias(f"{prefix}{p}") for p in percents]
    )


def _finer(base: DataFrame, keys: list[str], picks: DataFrame, few: int) -> DataFrame:
    """Cut every picked interval into equal parts, or into its values, and pick again.

    The ends of an interval always fall in different parts, so each pass narrows it.
    """
    interval = [*keys, "_bin", "_lo", "_hi"]
    cut = picks.where("_lo < _hi")
    inside = (
        base.withColumn("_bin", magnitude_bin(F.col("_v")))
        .join(cut.select(*interval, "_n").distinct(), [*keys, "_bin"])
        .where("_v >= _lo AND _v <= _hi")
    )
    share = (F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))
    part = F.when(F.col("_n") <= few, F.col("_v")).otherwise(F.floor(share * FINE_BINS).cast("double"))
    counted = inside.groupBy(*interval, part.alias("_part")).agg(
        F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_a"), F.max("_v").alias("_b")
    )
    narrowed = (
        _cover(counted, interval, "_part")
        .join(cut.drop("_n"), interval)
        .where("_before < _rank AND _rank <= _upto")
        .select(*keys, "_p", "_bin", F.col("_a").alias("_lo"), F.col("_b").alias("_hi"), "_n",
                (F.col("_rank") - F.col("_before")).alias("_rank"))
    )
    return narrowed.unionByName(picks.where("_lo = _hi"))


def latency_histogram(samples: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Samples per (key, bucket): at most 370 rows per key, mergeable by adding up.

    Samples that are null or not a number are left out.
    """
    return (
        samples.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
        .groupBy(*keys, latency_bucket(F.col(value)).alias("bucket"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def counted_percentiles(
    counted: DataFrame, keys: Sequence[str], value: str, percents: Sequence[int],
    prefix: str = "p", count: str = "n", extra: Sequence[Column] = (),
) -> DataFrame:
    """Nearest-rank percentiles of (key, value, count) rows, in whole-number arithmetic.

    Meant for values with few distinct outcomes: buckets, rates. ``extra`` aggregates are
    taken along.
    """
    keys = list(keys)
    ordered = Window.partitionBy(*keys).orderBy(value).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    cumulative = counted.withColumn("_upto", F.sum(count).over(ordered)).withColumn(
        "_total", F.sum(count).over(Window.partitionBy(*keys))
    )
    return cumulative.groupBy(*keys).agg(
        *[
            F.min(F.when(F.col("_upto") * 100 >= F.col("_total") * p, F.col(value)))
            .alias(f"{prefix}{p}")
            for p in percents
        ],
        *extra,
    )


def histogram_percentiles(
    histogram: DataFrame, keys: Sequence[str], percents: Sequence[int], prefix: str = "p"
) -> DataFrame:
    """Middle of the first bucket whose cumulative count reaches the rank."""
    found = counted_percentiles(histogram, keys, "bucket", percents, prefix)
    return found.select(
        *keys, *[bucket_middle(F.col(f"{prefix}{p}")).alias(f"{prefix}{p}") for p in percents]
    )
