"""The analytics as Structured Streaming jobs.

Event time must be TIMESTAMP (``event_time`` converts). ``run_available`` drains what is
there and returns the final table; in production start the same plans with a processing
time trigger and ``append`` or ``update`` output.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftload.functions.latency import latency_bucket
from weftload.operators.combined import combined_ticks
from weftload.operators.monitor import (
    STATUS_VARIABLES,
    active_spans,
    combined_status,
    inserted_docs,
    merged_spans,
    newest,
    with_config,
    with_status,
)
from weftload.operators.ticks import tick_number
from weftload.session import shared_dir


def stream_table(
    spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 1000
) -> DataFrame:
    """A Parquet table as a stream of its files.

    The source takes a folder or a glob; as a one-way alternation the path may also name a
    table that is a single file.
    """
    folder, _, name = path.rstrip("/").rpartition("/")
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(f"{folder}/{{{name}}}")


def event_time(stream: DataFrame, ts: str, late: str = "1 hour") -> DataFrame:
    """``ts`` as TIMESTAMP with a watermark; zoneless times are refused as event time."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)


def run_available(
    stream: DataFrame, label: str, mode: str = "complete",
    finish: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Process all available input and return the last output as a table.

    Every trigger writes its own folder, so a repeated trigger overwrites its own output
    and nothing passes through the driver.
    """
    spark = stream.sparkSession
    root = shared_dir(spark, label)
    last: dict[str, int] = {}

    def store(batch: DataFrame, epoch: int) -> None:
        result = finish(batch) if finish else batch
        result.write.mode("overwrite").parquet(f"{root}/out/{epoch}")
        last["epoch"] = epoch
        last["schema"] = result.schema

    query = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", f"{root}/state")
        .trigger(availableNow=True)
        .foreachBatch(store)
        .start()
    )
    query.awaitTermination()
    if "epoch" not in last:
        raise RuntimeError("the stream had no input")
    return spark.read.schema(last["schema"]).parquet(f"{root}/out/{last['epoch']}")


def run_appended(stream: DataFrame, label: str, root: str | None = None) -> DataFrame:
    """Process all available input in append mode; returns all rows the watermark has closed.

    State is dropped as it is closed. The file sink writes each trigger's rows once, so a
    restart on the same ``root`` goes on where the last run stopped.
    """
    spark = stream.sparkSession
    root = root or shared_dir(spark, label)
    query = (
        stream.writeStream.outputMode("append").format("parquet")
        .option("path", f"{root}/out").option("checkpointLocation", f"{root}/state")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/out")


def qps_stream(
    ops: DataFrame, keys: Sequence[str], tick_seconds: int, rate_seconds: int = 1,
    ts: str = "start_ts",
) -> DataFrame:
    """Operations and rate per (key, tick)."""
    counted = ops.groupBy(*keys, F.window(ts, f"{tick_seconds} seconds").alias("_w")).agg(
        F.count(F.lit(1)).alias("n")
    )
    rate = F.round(F.col("n") * rate_seconds / tick_seconds).cast("bigint")
    return counted.select(*keys, F.col("_w.start").alias("tick"), "n", rate.alias("qps"))


def size_stream(
    samples: DataFrame, keys: Sequence[str], size: str, length: str, slide: str, ts: str = "ts"
) -> DataFrame:
    """Smallest and largest size per sliding window."""
    return (
        samples.groupBy(*keys, F.window(ts, length, slide).alias("_w"))
        .agg(F.count(F.lit(1)).alias("n"), F.min(size).alias("size_min"),
             F.max(size).alias("size_max"))
        .select(*keys, F.col("_w.start").alias("window_start"), "n", "size_min", "size_max")
    )


def newest_stream(records: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The newest record per key; state is one record per key."""
    return newest(records, keys, order)


def histogram_stream(samples: DataFrame, keys: Sequence[str], latency: str) -> DataFrame:
    """Latency histogram; state is at most 370 counters per key."""
    return (
        samples.where(F.col(latency).isNotNull() & ~F.isnan(F.col(latency).cast("double")))
        .groupBy(*keys, latency_bucket(F.col(latency)).alias("bucket"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def span_stream(records: DataFrame, keys: Sequence[str], gap: str, ts: str = "ts") -> DataFrame:
    """Active spans per key, emitted (append) once the watermark has passed their end."""
    return (
        records.groupBy(*keys, F.session_window(ts, gap).alias("_s"))
        .agg(F.min(ts).alias("started"), F.max(ts).alias("ended"), F.count(F.lit(1)).alias("n"))
        .drop("_s")
    )


def combined_lines(
    records: DataFrame, config: DataFrame, status: DataFrame, root: str | None = None
) -> DataFrame:
    """One combined line per trigger; returns all lines with their ``epoch``.

    Processes without a new record keep their last one: the newest record per process is
    carried from trigger to trigger as a small table. Two tables take turns, so a repeated
    trigger or a restart on the same ``root`` starts from the right one. ``combined_stream``
    gives a line per tick instead, whatever a trigger holds.
    """
    spark = records.sparkSession
    root = root or shared_dir(spark, "combined")

    def step(batch: DataFrame, epoch: int) -> None:
        known = newest(batch, ["process_index"], ["ts", "processed"])
        if epoch > 0:
            before = spark.read.schema(known.schema).parquet(f"{root}/known/{(epoch - 1) % 2}")
            known = newest(known.unionByName(before), ["process_index"], ["ts", "processed"])
        path = f"{root}/known/{epoch % 2}"
        known.write.mode("overwrite").parquet(path)
        line = combined_line(spark.read.schema(known.schema).parquet(path), config, status)
        line.write.mode("overwrite").parquet(f"{root}/lines/epoch={epoch}")

    query = (
        records.writeStream.option("checkpointLocation", f"{root}/state")
        .trigger(availableNow=True)
        .foreachBatch(step)
        .start()
    )
    query.awaitTermination()
    return spark.read.parquet(f"{root}/lines")


def combined_line(known: DataFrame, config: DataFrame, status: DataFrame) -> DataFrame:
    """Newest record per process to one line over all processes."""
    stats = with_status(with_config(known, config), config, status)
    docs = inserted_docs(stats).select(F.coalesce("inserted", F.lit(0)).alias("inserted"))
    return combined_status(stats).withColumn("inserted", docs.scalar())


def distinct_records(records: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each record once, though files may be replayed: repeats are looked for within the watermark."""
    return records.dropDuplicatesWithinWatermark([*keys])


def with_spans(
    records: DataFrame, keys: Sequence[str], gap: str, longest: str, ts: str = "ts"
) -> DataFrame:
    """Records with the span of activity they belong to (``started``, ``ended``), once it is closed.

    A stream-stream join of the records with the session spans made of them. A record waits
    until its span can no longer grow; one whose span goes on for more than ``longest`` after it
    is given out without a span, so the state of both sides is bounded by the watermark.
    """
    spans = records.groupBy(*[F.col(k).alias(f"_{k}") for k in keys], F.session_window(ts, gap).alias("_s")).agg(
        F.min(ts).alias("started"), F.max(ts).alias("ended")
    )
    spans = spans.withColumn("_end", F.window_time("_s")).drop("_s")
    inside = F.col(ts).between(F.col("_end") - F.expr(f"INTERVAL {longest}"), F.col("_end"))
    on = [*[F.col(k) == F.col(f"_{k}") for k in keys], inside, F.col(ts).between(F.col("started"), F.col("ended"))]
    return records.join(spans, reduce(Column.__and__, on), "left_outer").drop("_end", *[f"_{k}" for k in keys])


def _of(pick: Callable, *values: int | None) -> int | None:
    """The least or largest of those that are known."""
    return pick((v for v in values if v is not None), default=None)


CLOCK = "origin long, last long, records_us long, status_us long, closed long, epoch long"
LINES = (
    "tick timestamp, elapsed_s long, tick_no long, processes long, chunks long, is_optimizing boolean, "
    "size long, inserted long"
)


def combined_stream(
    records: DataFrame, status: DataFrame, config: DataFrame, seconds: int, gap_seconds: int,
    late_seconds: int, root: str | None = None,
) -> DataFrame:
    """The combined line per tick as a stream; returns the lines of all ticks so far.

    ``records`` (process_index, ts) and ``status`` (ts, target, variable, value) come in as
    streams, in any portions. A tick is closed, and its line written for good, once the newest
    time of either stream is ``late_seconds`` and ``gap_seconds`` past its end (the slower stream
    counts): then no process can turn out to have gone on through it. So lines do not depend
    on what a trigger holds. Ticks that are still open when the input ends get a line that is
    not stored.

    Between triggers three tables are kept: spans of activity that may still grow or
    reach into open ticks, the newest status of each table as of the first open tick with
    all later ones, and one row of times. Two sets of tables take turns, so a repeated
    trigger or a restart on the same ``root`` starts from the right one. Input that is later
    than ``late_seconds`` cannot change closed ticks; it counts from the first open one.
    """
    spark = records.sparkSession
    root = root or shared_dir(spark, "combined")
    events = records.select("ts", F.col("process_index").cast("bigint").alias("process_index")).unionByName(
        status.select("ts", "target", "variable", "value"), allowMissingColumns=True
    )
    number = tick_number(F.col("ts"), "timestamp", seconds)

    spans_kept = "process_index long, started timestamp, ended timestamp"
    status_kept = "ts timestamp, target string, variable string, value string"

    def kept(name: str, slot: int, schema: str) -> DataFrame:
        return spark.read.schema(schema).parquet(f"{root}/{name}/slot={slot}")

    def keep(df: DataFrame, name: str, slot: int) -> None:
        df.write.mode("overwrite").parquet(f"{root}/{name}/slot={slot}")

    def step(batch: DataFrame, epoch: int) -> None:
        slot, before = epoch % 2, (epoch - 1) % 2
        keep(batch, "batch", slot)
        batch = kept("batch", slot, events.schema).where("ts IS NOT NULL")
        points = batch.where("process_index IS NOT NULL")
        reports = batch.where(F.col("variable").isin(list(STATUS_VARIABLES))).select("ts", "target", "variable", "value")
        spans = active_spans(points, ["process_index"], gap_seconds).select("process_index", "started", "ended")
        origin, last = points.agg(F.min(number), F.max(number)).first()
        time, of_record = F.unix_micros("ts"), F.col("process_index").isNotNull()
        times = batch.agg(F.max(F.when(of_record, time)), F.max(F.when(~of_record, time))).first()
        records_us, status_us, closed = *times, None
        if epoch > 0:
            spans = spans.unionByName(kept("spans", before, spans_kept))
            reports = reports.unionByName(kept("status", before, status_kept))
            clock = kept("clock", before, CLOCK).first()
            closed = clock.closed
            origin = _of(min, origin, clock.origin) if closed is None else clock.origin
            last = _of(max, last, clock.last)
            records_us, status_us = _of(max, records_us, clock.records_us), _of(max, status_us, clock.status_us)
        spans = merged_spans(spans, ["process_index"], gap_seconds)
        lines = spark.createDataFrame([], LINES)
        if origin is not None and status_us is not None:
            start = origin if closed is None else closed + 1
            until = (min(records_us, status_us) // 1_000_000 - late_seconds - gap_seconds) // seconds - 1
            until = min(last, until)
            if until >= start:
                lines = combined_ticks(spans, config, reports, seconds, F.lit(start), F.lit(until), F.lit(origin))
                closed = until
        lines.write.mode("overwrite").parquet(f"{root}/lines/epoch={epoch}")
        if closed is not None:
            spans = spans.where(tick_number(F.col("ended"), "timestamp", seconds) > closed)
        keep(spans, "spans", slot)
        open_tick = number if closed is None else F.greatest(number, F.lit(closed + 1))
        value = F.coalesce(F.col("value").try_cast("bigint"), F.lit(0))
        newest_report = F.max_by(F.struct("ts", "value"), F.struct(F.col("ts"), value)).alias("_r")
        reports = reports.groupBy("target", "variable", open_tick.alias("_open")).agg(newest_report)
        keep(reports.select("_r.ts", "target", "variable", "_r.value"), "status", slot)
        keep(spark.createDataFrame([(origin, last, records_us, status_us, closed, epoch)], CLOCK), "clock", slot)

    query = (
        events.writeStream.option("checkpointLocation", f"{root}/state")
        .trigger(availableNow=True)
        .foreachBatch(step)
        .start()
    )
    query.awaitTermination()
    lines = spark.read.schema(LINES).parquet(f"{root}/lines").drop("epoch")
    clock = spark.read.schema(f"{CLOCK}, slot int").parquet(f"{root}/clock").orderBy(F.desc("epoch")).first()
    if clock.origin is None:
        return lines
    start = clock.origin if clock.closed is None else clock.closed + 1
    if clock.last < start:
        return lines
    pending = combined_ticks(
        kept("spans", clock.slot, spans_kept), config, kept("status", clock.slot, status_kept), seconds,
        F.lit(start), F.lit(clock.last), F.lit(clock.origin),
    )
    return lines.unionByName(pending)
