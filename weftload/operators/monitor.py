"""Merging progress records with table status.

Records are first reduced to the newest one per process and tick, by an aggregate that
combines on the map side. The windows behind it are bounded by the number of ticks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftload.operators.throughput import seconds_between, tick_start
from weftload.operators.ticks import fill_ticks, tick_number, tick_time

# The status variables, and the result column of each.
STATUS_VARIABLES = {
    "disk_chunks": "disk_chunks",
    "optimizing": "is_optimizing",
    "disk_bytes": "disk_bytes",
    "ram_bytes": "ram_bytes",
    "indexed_documents": "indexed_documents",
}
IDLE_COUNTER = 4
MIN_COUNTER_SECONDS = 0.1
RETENTION_SECONDS = 5


def status_snapshot(status: DataFrame, keys: Sequence[str] = ("ts", "target")) -> DataFrame:
    """Key/value rows to one row per key; missing or unreadable values are 0."""
    value = F.col("value").try_cast("bigint")
    return status.groupBy(*keys).agg(
        *[
            F.coalesce(F.max(F.when(F.col("variable") == v, value)), F.lit(0)).alias(name)
            for v, name in STATUS_VARIABLES.items()
        ]
    )


def newest_status(status: DataFrame, keys: Sequence[str] = ("target",)) -> DataFrame:
    """The newest value of each variable per table; at equal times the largest one stands.

    A newest value that is unreadable counts as 0, like a variable that was never reported.
    """
    value = F.col("value").try_cast("bigint")

    def latest(variable: str) -> Column:
        return F.max_by(value, F.when(F.col("variable") == variable, F.struct(F.col("ts"), value)))

    return status.groupBy(*keys).agg(
        *[F.coalesce(latest(v), F.lit(0)).alias(name) for v, name in STATUS_VARIABLES.items()]
    )


def _seconds(seconds: int) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(seconds))


def session_count(listing: DataFrame, keys: Sequence[str] = ("ts",)) -> DataFrame:
    """Open sessions per tick: the rows of a listing."""
    return listing.groupBy(*keys).agg(F.count(F.lit(1)).alias("sessions"))


FIXED_WIDTH = ("tinyint", "smallint", "int", "bigint", "float", "double", "boolean", "date",
               "timestamp", "timestamp_ntz")


def newest(records: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The newest whole record per key; later ``order`` columns break ties.

    With one order column and plain numbers or times, the record is kept column by column:
    a hash aggregate, where a struct needs a sort in every task first. Each column then
    sees the same rows in the same order, so all come from the same record.
    """
    rest = [c for c in records.columns if c not in keys]
    types = dict(records.dtypes)
    if len(order) == 1 and all(types[c] in FIXED_WIDTH for c in rest):
        return records.groupBy(*keys).agg(*[F.max_by(c, order[0]).alias(c) for c in rest])
    latest = F.max_by(F.struct(*rest), F.struct(*order))
    return records.groupBy(*keys).agg(latest.alias("_r")).select(*keys, "_r.*")


def newest_per_tick(
    records: DataFrame, keys: Sequence[str], tick_seconds: int, order: Sequence[str]
) -> DataFrame:
    ticked = records.withColumn("tick", tick_start(F.col("ts"), tick_seconds))
    return newest(ticked, [*keys, "tick"], order)


def deltas(per_tick: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Seconds and rows since the record of the previous tick that has one."""
    before = Window.partitionBy(*keys).orderBy("tick")
    return per_tick.withColumn(
        "dt", seconds_between(F.lag("ts").over(before), F.col("ts"))
    ).withColumn("dn", F.col("processed") - F.lag("processed").over(before))


def carry_forward(
    per_tick: DataFrame, keys: Sequence[str], tick_seconds: int, last_tick: Column
) -> DataFrame:
    """A row for every tick from a key's first one to ``last_tick``.

    Columns hold their last value that is not null. Gaps are filled in blocks, see ``fill_ticks``.
    """
    kind = dict(per_tick.dtypes)["tick"]
    columns = [c for c in per_tick.columns if c not in keys and c != "tick"]
    numbered = per_tick.withColumn("tick_no", tick_number(F.col("tick"), kind, tick_seconds))
    filled = fill_ticks(numbered, keys, columns, tick_number(last_tick, kind, tick_seconds))
    return filled.select(
        *keys, tick_time(F.col("tick_no"), kind, tick_seconds).alias("tick"), *columns, "is_carried"
    )


def counter_usage(counters: DataFrame, host: str = "host") -> DataFrame:
    """Busy share in whole percent from cumulative counters; the 4th one is idle time.

    Null for the first record, for records closer than 0.1 s and without any change.
    """
    before = Window.partitionBy(host).orderBy("ts")
    total = F.aggregate("counters", F.lit(0).cast("bigint"), lambda a, v: a + v)
    idle = F.element_at("counters", IDLE_COUNTER)
    changes = counters.select(
        host, "ts",
        seconds_between(F.lag("ts").over(before), F.col("ts")).alias("_dt"),
        (total - F.lag(total).over(before)).alias("_total"),
        (idle - F.lag(idle).over(before)).alias("_idle"),
    )
    share = F.round(F.round((1 - F.col("_idle") / F.col("_total")) * 100, 1)).cast("bigint")
    valid = (F.col("_dt") >= MIN_COUNTER_SECONDS) & (F.col("_total") != 0)
    return changes.select(host, "ts", F.when(valid, share).alias("usage"))


def size_window(
    samples: DataFrame, keys: Sequence[str], size: str, seconds: int = RETENTION_SECONDS
) -> DataFrame:
    """Smallest, largest and growth of a size over the last ``seconds``, both ends included.

    A sliding frame would be aggregated afresh for every sample. Here time is cut into
    blocks as long as the frame. A frame then is the end of one block and the start of the
    next, and both are running aggregates: forwards from the start of a block, and backwards
    from the end of the block before, read off at the time the frame opens. The work per
    sample does not depend on how many samples a frame holds, and a busy key is spread over
    its blocks.
    """
    keys = list(keys)
    block = F.window("_at", f"{seconds} seconds")["start"]
    # Samples with the same time are peers of a frame.
    merged = samples.groupBy(*keys, F.col("ts").alias("_at")).agg(
        F.count(F.lit(1)).alias("_n"), F.min(size).alias("_min"), F.max(size).alias("_max")
    )
    rows = (Window.unboundedPreceding, Window.currentRow)

    forwards = Window.partitionBy(*keys, "_block").orderBy("_at").rowsBetween(*rows)
    started = merged.withColumn("_block", block).select(
        *keys, F.col("_at").alias("ts"), F.col("_max").alias("_own"),
        F.sum("_n").over(forwards).alias("_n1"),
        F.min("_min").over(forwards).alias("_min1"),
        F.max("_max").over(forwards).alias("_max1"),
        F.first("_min").over(forwards).alias("_first1"),
    )

    opening = merged.select(
        *keys, (F.col("_at") - _seconds(seconds)).alias("_at"), F.col("_at").alias("ts")
    )
    marked = merged.unionByName(opening, allowMissingColumns=True).withColumn("_block", block)
    # Backwards; a sample at the very time a frame opens belongs to it and comes first.
    backwards = (
        Window.partitionBy(*keys, "_block")
        .orderBy(F.desc("_at"), F.col("ts").isNotNull())
        .rowsBetween(*rows)
    )
    ended = marked.select(
        *keys, "ts",
        F.sum("_n").over(backwards).alias("_n0"),
        F.min("_min").over(backwards).alias("_min0"),
        F.max("_max").over(backwards).alias("_max0"),
        F.last("_min", ignorenulls=True).over(backwards).alias("_first0"),
    ).where("ts IS NOT NULL")

    return started.join(ended, [*keys, "ts"]).select(
        *keys, "ts",
        (F.coalesce("_n0", F.lit(0)) + F.col("_n1")).alias("n"),
        F.least("_min0", "_min1").alias("size_min"),
        F.greatest("_max0", "_max1").alias("size_max"),
        (F.col("_own") - F.coalesce("_first0", "_first1")).alias("growth"),
    )


def with_config(records: DataFrame, config: DataFrame) -> DataFrame:
    """Process settings by process number; records of unknown processes are skipped."""
    return records.join(config, "process_index")


def watched_tables(config: DataFrame) -> DataFrame:
    """Each table once."""
    return config.where("target <> ''").select("target").distinct()


def with_status(records: DataFrame, config: DataFrame, status: DataFrame) -> DataFrame:
    """Adds the status of the process's own table, or of the first process's table.

    ``records`` have a ``target``; ``status`` has one row per target. The fallback is a
    single row, looked up as a scalar.
    """
    names = list(STATUS_VARIABLES.values())
    first = config.where("target <> ''").agg(F.min_by("target", "process_index")).scalar()
    fallback = (
        status.where(F.col("target") == first).agg(F.max(F.struct(*names))).scalar()
    )
    own = status.select("target", F.struct(*names).alias("_own"))
    return (
        records.join(own, "target", "left")
        .withColumn("_status", F.coalesce("_own", fallback))
        .select(*records.columns, *[F.col(f"_status.{n}").alias(n) for n in names])
    )


def inserted_docs(stats: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Documents over all tables; processes on the same table see the same documents."""
    per_table = (
        stats.where("load_type = 'insert'")
        .groupBy(*keys, "target")
        .agg(F.max("indexed_documents").alias("_docs"))
    )
    return per_table.groupBy(*keys).agg(F.sum("_docs").alias("inserted"))


def combined_status(stats: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One line: chunks and bytes of writing processes, merging if any process's table is."""
    writes = F.col("load_type").isin("insert", "replace")

    def written(name: str) -> Column:
        return F.coalesce(F.sum(F.when(writes, F.col(name)).otherwise(F.lit(0))), F.lit(0))

    return stats.groupBy(*keys).agg(
        written("disk_chunks").alias("chunks"),
        written("disk_bytes").alias("size"),
        F.coalesce(F.bool_or(F.col("is_optimizing") > 0), F.lit(False)).alias("is_optimizing"),
        F.count(F.lit(1)).alias("processes"),
    )


def active_spans(
    records: DataFrame, keys: Sequence[str], gap_seconds: int, ts: str = "ts"
) -> DataFrame:
    """When a process was active: records at most ``gap_seconds`` apart belong together.

    Records are first merged into cells no longer than the gap. A cell can never hold a
    break, so breaks are only looked for between cells.
    """
    cells = records.groupBy(*keys, tick_start(F.col(ts), gap_seconds).alias("_cell")).agg(
        F.min(ts).alias("_from"), F.max(ts).alias("_to"), F.count(F.lit(1)).alias("_n")
    )
    order = Window.partitionBy(*keys).orderBy("_cell")
    pause = seconds_between(F.lag("_to").over(order), F.col("_from"))
    opens = F.when(pause <= gap_seconds, F.lit(0)).otherwise(F.lit(1))
    return (
        cells.withColumn("_opens", opens)
        .withColumn(
            "span_no",
            F.sum("_opens").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
        )
        .groupBy(*keys, "span_no")
        .agg(
            F.min("_from").alias("started"), F.max("_to").alias("ended"), F.sum("_n").alias("n")
        )
    )


def merged_spans(spans: DataFrame, keys: Sequence[str], gap_seconds: int) -> DataFrame:
    """Spans (started, ended) that are at most ``gap_seconds`` apart, or overlap, as one."""
    order = Window.partitionBy(*keys).orderBy("started", "ended")
    reach = F.max("ended").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(seconds_between(reach, F.col("started")) <= gap_seconds, F.lit(0)).otherwise(F.lit(1))
    number = F.sum("_opens").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (
        spans.withColumn("_opens", opens)
        .withColumn("_no", number)
        .groupBy(*keys, "_no")
        .agg(F.min("started").alias("started"), F.max("ended").alias("ended"))
        .drop("_no")
    )
