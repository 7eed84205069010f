"""Rates per interval and progress over time.

All of these first count per (process, tick). A busy process is pre-aggregated on the
map side; what the windows then see is bounded by the length of the run in ticks, not
by the number of operations.

Ticks are fixed tumbling windows. A closed-loop tool would end an interval at the first
completion after one second; fixed windows give the same figure for steady load and do
not depend on arrival order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftload.operators.percentiles import counted_percentiles
from weftload.operators.ticks import fill_ticks, tick_number, tick_time

QPS_PERCENTS = [1, 5, 95, 99]


def tick_start(ts: Column, seconds: int) -> Column:
    """Start of the tumbling window ``ts`` falls in."""
    return F.window(ts, f"{seconds} seconds")["start"]


def seconds_between(start: Column, end: Column) -> Column:
    """Seconds with fraction, for timestamps with or without a zone."""
    return F.timestamp_diff("MICROSECOND", start, end) / 1_000_000


def ops_per_tick(
    ops: DataFrame, keys: Sequence[str], tick_seconds: int, ts: str = "start_ts"
) -> DataFrame:
    """Counts per (key, tick): statements, nominal and exact rows."""
    return ops.groupBy(*keys, tick_start(F.col(ts), tick_seconds).alias("tick")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("batch_size").cast("bigint")).alias("ops_nominal"),
        F.sum(F.col("n_rows").cast("bigint")).alias("ops_exact"),
    )


def qps_series(
    ticks: DataFrame,
    keys: Sequence[str],
    tick_seconds: int,
    rate_seconds: int = 1,
    drop_last: bool = True,
    fill_empty: bool = False,
) -> DataFrame:
    """Rate per tick, rounded. ``rate_seconds`` is the unit (1 = per second).

    The last tick of a key is usually cut short and left out by default. Ticks without
    any operation are absent unless ``fill_empty``.
    """
    by_key = Window.partitionBy(*keys)
    kept = ticks.select(*keys, "tick", "n", F.max("tick").over(by_key).alias("_last"))
    if drop_last:
        kept = kept.where(F.col("tick") < F.col("_last"))
    if fill_empty:
        kept = fill_gaps(kept, keys, tick_seconds)
    rate = F.round(F.col("n") * rate_seconds / tick_seconds).cast("bigint")
    return kept.select(*keys, "tick", "n", rate.alias("qps"))


def fill_gaps(ticks: DataFrame, keys: Sequence[str], tick_seconds: int) -> DataFrame:
    """Adds ticks with ``n = 0`` between the first and the last one of a key, gap by gap in blocks."""
    kind = dict(ticks.dtypes)["tick"]
    numbered = ticks.withColumn("tick_no", tick_number(F.col("tick"), kind, tick_seconds))
    filled = fill_ticks(numbered, keys, ["n"])
    return filled.select(
        *keys, tick_time(F.col("tick_no"), kind, tick_seconds).alias("tick"),
        F.when(F.col("is_carried"), F.lit(0)).otherwise(F.col("n")).alias("n"),
    )


def qps_summary(series: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rounded mean and nearest-rank percentiles of the rate.

    Rates are whole numbers with few distinct values, so they are counted by value first.
    """
    keys = list(keys)
    counted = series.groupBy(*keys, "qps").agg(F.count(F.lit(1)).alias("_c"))
    mean = F.round(F.sum(F.col("qps") * F.col("_c")) / F.sum("_c")).cast("bigint")
    return counted_percentiles(
        counted, keys, "qps", QPS_PERCENTS, "qps_p", "_c", [mean.alias("qps_avg")]
    )


def _so_far(keys: Sequence[str]):
    return Window.partitionBy(*keys).orderBy("tick").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )


def dps_series(ticks: DataFrame, keys: Sequence[str], tick_seconds: int) -> DataFrame:
    """Documents written so far per elapsed second, at the end of each tick."""
    first = F.min("tick").over(Window.partitionBy(*keys))
    docs = F.sum("ops_exact").over(_so_far(keys))
    return (
        ticks.select(*keys, "tick", docs.alias("docs"), first.alias("_first"))
        .withColumn(
            "elapsed_s",
            F.timestamp_diff("SECOND", F.col("_first"), F.col("tick")) + tick_seconds,
        )
        .withColumn("dps", F.col("docs") / F.col("elapsed_s"))
        .drop("_first")
    )


def progress_percent(ticks: DataFrame, keys: Sequence[str], total: Column) -> DataFrame:
    """Share of ``total`` done by the end of each tick, in whole percent; null without a total."""
    done = F.sum("n").over(_so_far(keys))
    return ticks.withColumn("processed", done).withColumn(
        "progress",
        F.when(total > 0, F.round(F.col("processed") * 100 / total).cast("bigint")),
    )
