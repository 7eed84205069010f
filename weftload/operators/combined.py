"""One combined line per tick over all processes: who runs, and the state of their tables.

A line needs no record of its own tick. Which processes run is kept as changes: a span
of activity adds one process to its table at its first tick and takes it away after its
last. Status reports are changes as well. All changes of a table meet in one stream per (table,
block of ticks), and what they leave is carried from tick to tick. Only tables times ticks
are ever spelled out, not processes times ticks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftload.functions import formats as fmt
from weftload.operators.blocks import running_sums
from weftload.operators.monitor import STATUS_VARIABLES, active_spans, newest
from weftload.operators.throughput import seconds_between
from weftload.operators.ticks import fill_ticks, tick_number, tick_time

STATUS_NAMES = list(STATUS_VARIABLES.values())
SHOWN = ("shown", "writing", "inserting")


def tables_of(config: DataFrame) -> DataFrame:
    """Each configured table with the one whose status it shows.

    A process without a table shows the status of the first process that has one.
    """
    first = config.where("target <> ''").agg(F.min_by("target", "process_index")).scalar()
    named = F.when(F.col("target") == "", first).otherwise(F.col("target"))
    return config.select("target", named.alias("_status_of")).distinct()


def running_changes(spans: DataFrame, config: DataFrame, kind: str, seconds: int, start: Column) -> DataFrame:
    """How many processes run on a table, how many of them write, how many insert: a row
    per table and tick at which that changes."""
    writes = F.col("load_type").isin("insert", "replace")
    first = F.greatest(tick_number(F.col("started"), kind, seconds), start)
    after = tick_number(F.col("ended"), kind, seconds) + 1
    known = spans.join(config.select("process_index", "target", "load_type"), "process_index")
    known = known.where(after > start)
    step = F.explode(F.array(F.struct(first.alias("tick_no"), F.lit(1).alias("d")),
                             F.struct(after.alias("tick_no"), F.lit(-1).alias("d")))).alias("s")
    steps = known.select("target", writes.alias("w"), (F.col("load_type") == "insert").alias("i"), step)
    d = F.col("s.d").cast("bigint")
    changes = steps.groupBy("target", F.col("s.tick_no").alias("tick_no")).agg(
        F.sum(d).alias("_shown"), F.sum(F.when(F.col("w"), d).otherwise(0)).alias("_writing"),
        F.sum(F.when(F.col("i"), d).otherwise(0)).alias("_inserting"),
    )
    summed = running_sums(changes, ["target"], "tick_no", {n: f"_{n}" for n in SHOWN})
    return summed.select("target", "tick_no", *SHOWN)


def status_changes(status: DataFrame, tables: DataFrame, kind: str, seconds: int, start: Column) -> DataFrame:
    """What a table reported newly in a tick, a column per variable; earlier reports count at ``start``.

    At equal times the largest value stands; an unreadable one counts as 0.
    """
    value = F.coalesce(F.col("value").try_cast("bigint"), F.lit(0))
    number = F.greatest(tick_number(F.col("ts"), kind, seconds), start)

    def latest(variable: str) -> Column:
        return F.max_by(value, F.when(F.col("variable") == variable, F.struct(F.col("ts"), value)))

    named = status.where(F.col("variable").isin(list(STATUS_VARIABLES))).withColumnRenamed("target", "_status_of")
    return named.groupBy("_status_of", number.alias("tick_no")).agg(
        *[latest(v).alias(name) for v, name in STATUS_VARIABLES.items()]
    ).join(tables, "_status_of").drop("_status_of")


def combined_ticks(
    spans: DataFrame, config: DataFrame, status: DataFrame, seconds: int,
    start: Column, end: Column, origin: Column | None = None,
) -> DataFrame:
    """A line for every tick number from ``start`` to ``end``, given the spans of activity.

    ``spans``: process_index, started, ended. ``config``: process_index, target, load_type.
    ``status``: ts, target, variable, value. Ticks without any running process have zeros.
    Elapsed time counts from the tick ``origin`` (None: ``start``).
    """
    kind = dict(spans.dtypes)["started"]
    running = running_changes(spans, config, kind, seconds, start)
    reported = status_changes(status, tables_of(config), dict(status.dtypes)["ts"], seconds, start)
    columns = [*SHOWN, *STATUS_NAMES]
    changes = running.unionByName(reported, allowMissingColumns=True).groupBy("target", "tick_no").agg(
        *[F.max(c).alias(c) for c in columns]
    )
    state = fill_ticks(changes, ["target"], columns, end)
    n = {c: F.coalesce(F.col(c), F.lit(0)) for c in columns}
    lines = state.groupBy("tick_no").agg(
        F.sum(n["shown"]).alias("processes"),
        F.sum(n["writing"] * n["disk_chunks"]).alias("chunks"),
        F.bool_or((n["shown"] > 0) & (n["is_optimizing"] > 0)).alias("is_optimizing"),
        F.sum(n["writing"] * n["disk_bytes"]).alias("size"),
        F.sum(F.when(n["inserting"] > 0, n["indexed_documents"]).otherwise(0)).alias("inserted"),
    )
    elapsed = (F.col("tick_no") - (start if origin is None else origin)) * seconds
    return lines.select(tick_time(F.col("tick_no"), kind, seconds).alias("tick"), elapsed.alias("elapsed_s"), "*")


def with_series(lines: DataFrame, series: DataFrame, name: str, seconds: int, start: Column, end: Column) -> DataFrame:
    """Adds the newest value of a series (ts, ``name``) as of each tick; null before its first one."""
    kind = dict(series.dtypes)["ts"]
    number = F.greatest(tick_number(F.col("ts"), kind, seconds), start)
    per_tick = series.where(F.col(name).isNotNull()).groupBy(number.alias("tick_no")).agg(
        F.max_by(name, F.struct("ts", name)).alias(name)
    )
    return lines.join(fill_ticks(per_tick, [], [name], end).drop("is_carried"), "tick_no", "left")


def combined_per_tick(
    records: DataFrame, config: DataFrame, status: DataFrame, seconds: int, gap_seconds: int,
    series: dict[str, DataFrame] | None = None,
) -> DataFrame:
    """A line for every tick from the first record to the last, with all fields.

    ``records``: process_index, ts and more. A process runs while its records are at most
    ``gap_seconds`` apart, and leaves the line after the tick of the last one. ``series`` adds
    figures that belong to no process (sessions, CPU use), by name.
    """
    spans = active_spans(records, ["process_index"], gap_seconds)
    kind = dict(records.dtypes)["ts"]
    number = tick_number(F.col("ts"), kind, seconds)
    start, end = records.agg(F.min(number)).scalar(), records.agg(F.max(number)).scalar()
    lines = combined_ticks(spans, config, status, seconds, start, end)
    for name, values in (series or {}).items():
        lines = with_series(lines, values, name, seconds, start, end)
    return lines.drop("tick_no")


def shown_line(lines: DataFrame) -> DataFrame:
    """The figures of a line as it is displayed."""
    busy = F.when(F.col("is_optimizing"), F.lit("1")).otherwise(F.lit(""))
    return lines.select(
        "tick", fmt.elapsed(F.col("elapsed_s")).alias("elapsed"), F.col("chunks").cast("string").alias("chunks"),
        busy.alias("merging"), fmt.byte_size(F.col("size")).alias("disk"), fmt.short_count(F.col("inserted")).alias("inserted"),
    )


def processes_per_tick(
    records: DataFrame, columns: Sequence[str], order: Sequence[str], seconds: int, gap_seconds: int
) -> DataFrame:
    """The newest figures of each running process for every tick: process_index, tick, columns, is_carried."""
    kind = dict(records.dtypes)["ts"]
    ticked = records.withColumn("tick_no", tick_number(F.col("ts"), kind, seconds))
    figures = newest(ticked.select("process_index", "tick_no", "ts", *columns), ["process_index", "tick_no"], order)
    bounds = ticked.groupBy("process_index", "tick_no").agg(F.min("ts").alias("_from"), F.max("ts").alias("_to"))
    by_time = Window.partitionBy("process_index").orderBy("tick_no")
    pause = seconds_between(F.col("_to"), F.lead("_from").over(by_time))
    bounds = bounds.select("process_index", "tick_no", F.coalesce(pause <= gap_seconds, F.lit(False)).alias("_goes_on"))
    per_tick = figures.join(bounds, ["process_index", "tick_no"])
    filled = fill_ticks(per_tick, ["process_index"], [*columns, "_goes_on"])
    return filled.where(~F.col("is_carried") | F.col("_goes_on")).select(
        "process_index", tick_time(F.col("tick_no"), kind, seconds).alias("tick"), *columns, "is_carried"
    )
