"""A row for every tick: values carried over gaps, however long a gap or a key is.

Time is cut into blocks of ticks. What a key's block leaves behind is one small row, and
from these rows follows what each block starts with. So a gap is filled block by block,
by rows that are dealt out before they are filled; no array is longer than a block, and
a busy key is spread over its blocks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_TICKS = 1024


def tick_number(ts: Column, kind: str, seconds: int) -> Column:
    """Number of the tumbling window that ``ts`` (of type ``kind``) falls in."""
    if kind == "timestamp_ntz":
        start = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
        whole = F.timestamp_diff("MICROSECOND", start, ts)
    else:
        whole = F.unix_micros(ts)
    return F.floor(whole / (seconds * 1_000_000)).cast("bigint")


def tick_time(number: Column, kind: str, seconds: int) -> Column:
    """Start of a tick, the inverse of ``tick_number``."""
    if kind == "timestamp_ntz":
        start = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
        return F.timestamp_add("SECOND", number * seconds, start)
    return F.timestamp_seconds(number * seconds)


def _block_of(number: Column) -> Column:
    return F.floor(number / BLOCK_TICKS).cast("bigint")


def _blocks(
    events: DataFrame, keys: list[str], columns: Sequence[str], until: Column | None
) -> DataFrame:
    """One row per key and block, empty blocks included: its bounds and what it starts with."""
    left = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_no"))).alias(c) for c in columns]
    held = events.groupBy(*keys, "_block").agg(
        *left, F.min("_no").alias("_first"), F.max("_no").alias("_last")
    )
    order = Window.partitionBy(*keys).orderBy("_block")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*keys)
    end = F.max("_last").over(whole) if until is None else until
    held = held.select(
        *keys, "_block", "_first",
        F.struct(*[F.last(c, True).over(earlier).alias(c) for c in columns],
                 F.lit(None).cast("int").alias("_")).alias("_before"),
        F.struct(*[F.last(c, True).over(upto).alias(c) for c in columns],
                 F.lit(None).cast("int").alias("_")).alias("_after"),
        F.min("_first").over(whole).alias("_start"),
        end.alias("_end"),
        F.lead("_block").over(order).alias("_next"),
    )
    final = F.coalesce(F.col("_next") - 1, _block_of(F.col("_end")))
    held = held.withColumn(
        "_at", F.explode(F.sequence(F.col("_block"), F.greatest(final, F.col("_block"))))
    )
    own = F.col("_at") == F.col("_block")
    return held.select(
        *keys, F.col("_at").alias("_block"),
        F.when(own, F.col("_first")).alias("_first"),
        F.when(own, F.col("_before")).otherwise(F.col("_after")).alias("_in"),
        F.greatest(F.col("_at") * BLOCK_TICKS, F.col("_start")).alias("_from"),
        F.least((F.col("_at") + 1) * BLOCK_TICKS - 1, F.col("_end")).alias("_to"),
    )


def fill_ticks(
    events: DataFrame, keys: Sequence[str], columns: Sequence[str], until: Column | None = None,
    number: str = "tick_no",
) -> DataFrame:
    """A row for every tick of a key, from its first event to ``until`` (None: its last event).

    ``events`` has one row per key and tick number; events after ``until`` are left out.
    Each column holds its last value that is not null. ``is_carried`` marks ticks without an event.
    """
    keys = list(keys)
    numbered = events.select(*keys, F.col(number).cast("bigint").alias("_no"), *columns)
    if until is not None:
        numbered = numbered.where(F.col("_no") <= until)
    numbered = numbered.withColumn("_block", _block_of(F.col("_no")))
    blocks = _blocks(numbered, keys, columns, until)

    order = Window.partitionBy(*keys, "_block").orderBy("_no")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = numbered.select(
        *keys, "_block", "_no", F.lead("_no").over(order).alias("_next"),
        *[F.last(c, True).over(upto).alias(c) for c in columns],
    )
    bounds = blocks.select(*keys, "_block", "_to", "_in")
    joined = local.join(bounds, [*keys, "_block"]) if keys else local.join(bounds, "_block")
    own = joined.select(
        *keys,
        F.explode(F.sequence("_no", F.coalesce(F.col("_next") - 1, F.col("_to")))).alias(number),
        *[F.coalesce(F.col(c), F.col("_in")[c]).alias(c) for c in columns],
        F.col("_no").alias("_own"),
    ).withColumn("is_carried", F.col(number) != F.col("_own")).drop("_own")
    # The ticks of a block before its first event.
    stop = F.coalesce(F.col("_first") - 1, F.col("_to"))
    head = blocks.where(F.col("_from") <= stop).select(
        *keys, F.explode(F.sequence(F.col("_from"), stop)).alias(number),
        *[F.col("_in")[c].alias(c) for c in columns],
        F.lit(True).alias("is_carried"),
    )
    return own.unionByName(head)
