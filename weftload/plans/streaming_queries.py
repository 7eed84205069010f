"""Registered queries: streaming jobs run over the whole tables until they are drained.

``complete`` output equals the batch result. ``append`` output, with bounded state, is compared
on the windows that the watermark has closed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftload.operators.monitor import newest_status
from weftload.operators.percentiles import histogram_percentiles
from weftload.plans import check_sql as c
from weftload.plans.analysis_queries import OPS_ROWS, TICKS
from weftload.plans.inputs import (
    CONFIG,
    LIVE_STATUS,
    OPS,
    PROGRESS,
    SIZES,
    STATUS,
    USER_PROGRESS,
    read,
    select,
)
from weftload.plans.monitoring_queries import (
    COMBINED,
    COMBINED_PER_TICK,
    HOUR,
    LIVE_GAP,
    PROGRESS_ROWS,
    SIZE_ROWS,
    STATS,
    USER_ROWS,
    USER_SPANS,
    _newest,
)
from weftload.plans.registry import query
from weftload.session import shared_dir
from weftload.sources.files import stream_progress, write_progress
from weftload.streaming import live

DAY = 86400


def stream(spark, folder, source, ts: str) -> DataFrame:
    table, columns, condition = source
    path = f"{folder}/{table}.parquet"
    rows = live.stream_table(spark, path, read(spark, folder, table).schema)
    return live.event_time(rows.where(condition).selectExpr(*columns), ts)


def zoneless(df: DataFrame, *names: str) -> DataFrame:
    """Times as they are in the tables."""
    for name in names:
        df = df.withColumn(name, F.col(name).cast("timestamp_ntz"))
    return df


@query("stream_qps", f"SELECT process_index, tick, n, n AS qps FROM {TICKS}")
def stream_qps(spark, folder):
    ops = stream(spark, folder, OPS, "start_ts")
    plan = live.qps_stream(ops, ["process_index"], 3600, 3600)
    return zoneless(live.run_available(plan, "qps"), "tick")


@query(
    "stream_size",
    f"""SELECT target, window_start, count(*) AS n, min(disk_bytes) AS size_min, max(disk_bytes) AS size_max FROM (
 SELECT target, disk_bytes, unnest(generate_series(date_trunc('day', ts) - INTERVAL 4 DAYS, date_trunc('day', ts),
  INTERVAL 1 DAY)) AS window_start FROM {SIZE_ROWS}) GROUP BY target, window_start""",
)
def stream_size(spark, folder):
    samples = stream(spark, folder, SIZES, "ts")
    plan = live.size_stream(samples, ["target"], "disk_bytes", "5 days", "1 day")
    return zoneless(live.run_available(plan, "size"), "window_start")


@query("stream_last", _newest(PROGRESS_ROWS))
def stream_last(spark, folder):
    records = stream(spark, folder, PROGRESS, "ts")
    plan = live.newest_stream(records, ["process_index"], ["processed"])
    return zoneless(live.run_available(plan, "last"), "ts")


@query(
    "stream_hist",
    f"SELECT process_index, {c.BUCKET} AS bucket, count(*) AS n FROM {OPS_ROWS} GROUP BY ALL",
)
def stream_hist(spark, folder):
    ops = stream(spark, folder, OPS, "start_ts")
    plan = live.histogram_stream(ops, ["process_index"], "latency_ms")
    return live.run_available(plan, "hist")


@query("stream_hist_pct", c.histogram_percentiles(OPS_ROWS, "process_index", [50, 95, 99]))
def stream_hist_pct(spark, folder):
    """Percentiles from the histogram, computed at every trigger."""
    ops = stream(spark, folder, OPS, "start_ts")
    plan = live.histogram_stream(ops, ["process_index"], "latency_ms")
    return live.run_available(
        plan, "hist-pct",
        finish=lambda h: histogram_percentiles(h, ["process_index"], [50, 95, 99]),
    )


@query(
    "stream_combined",
    f"""SELECT c.*, (SELECT CAST(sum(d) AS BIGINT) FROM (SELECT target, max(indexed_documents) AS d
 FROM {STATS} WHERE load_type = 'insert' GROUP BY target)) AS inserted FROM ({COMBINED}) c""",
)
def stream_combined(spark, folder):
    """The combined line after the last trigger."""
    records = stream(spark, folder, USER_PROGRESS, "ts")
    config = select(spark, folder, CONFIG)
    status = newest_status(select(spark, folder, STATUS))
    lines = live.combined_lines(records, config, status)
    last = lines.agg(F.max("epoch")).scalar()
    return lines.where(F.col("epoch") == last).drop("epoch")


QPS_CLOSED = f"""SELECT process_index, tick, n, n AS qps FROM {TICKS}
 WHERE tick + INTERVAL 1 HOUR <= (SELECT max(start_ts) FROM {OPS_ROWS}) - INTERVAL 1 HOUR"""


@query("stream_qps_append", QPS_CLOSED)
def stream_qps_append(spark, folder):
    """Rates of the hours that the watermark has closed; their state is dropped."""
    ops = stream(spark, folder, OPS, "start_ts")
    plan = live.qps_stream(ops, ["process_index"], HOUR, HOUR)
    return zoneless(live.run_appended(plan, "qps"), "tick")


@query(
    "stream_size_append",
    f"""SELECT target, window_start, count(*) AS n, min(disk_bytes) AS size_min, max(disk_bytes) AS size_max FROM (
 SELECT target, disk_bytes, unnest(generate_series(date_trunc('day', ts) - INTERVAL 4 DAYS, date_trunc('day', ts),
  INTERVAL 1 DAY)) AS window_start FROM {SIZE_ROWS})
 WHERE window_start + INTERVAL 5 DAYS <= (SELECT max(ts) FROM {SIZE_ROWS}) - INTERVAL 1 HOUR GROUP BY target, window_start""",
)
def stream_size_append(spark, folder):
    """Sliding windows of sizes that the watermark has closed."""
    samples = stream(spark, folder, SIZES, "ts")
    plan = live.size_stream(samples, ["target"], "disk_bytes", "5 days", "1 day")
    return zoneless(live.run_appended(plan, "size"), "window_start")


@query("stream_combined_ticks", f"SELECT * EXCLUDE (workers) FROM ({COMBINED_PER_TICK})")
def stream_combined_ticks(spark, folder):
    """The combined line per hour from streams of records and of status reports."""
    lines = live.combined_stream(
        stream(spark, folder, USER_PROGRESS, "ts"), stream(spark, folder, LIVE_STATUS, "ts"),
        select(spark, folder, CONFIG), HOUR, LIVE_GAP, HOUR,
    )
    return zoneless(lines.drop("tick_no"), "tick")


@query(
    "stream_progress_files",
    f"SELECT CAST(process_index AS INT) AS process_index, ts, processed, CAST(qps AS STRING) AS qps FROM {PROGRESS_ROWS}",
)
def stream_progress_files(spark, folder):
    """Progress files that are replayed as a whole: each record comes out once."""
    records = select(spark, folder, PROGRESS).select(
        F.col("ts").cast("timestamp").alias("ts"), "process_index", "processed",
        F.col("qps").cast("string").alias("qps"),
    )
    path = shared_dir(spark, "progress")
    write_progress(records, path)
    write_progress(records, path)
    found = live.distinct_records(
        live.event_time(stream_progress(spark, path), "ts", "60 days"), ["process_index", "processed"]
    )
    found = found.select("ts", "process_index", "processed", "qps")
    return zoneless(live.run_appended(found, "progress"), "ts")


@query(
    "stream_spans",
    f"""WITH spans AS ({USER_SPANS})
SELECT r.process_index, r.ts, r.processed, s.started, s.ended FROM {USER_ROWS} r JOIN spans s
 ON s.process_index = r.process_index AND r.ts BETWEEN s.started AND s.ended
WHERE s.ended + INTERVAL 12 HOUR <= (SELECT max(ts) FROM {USER_ROWS}) - INTERVAL 1 HOUR""",
)
def stream_spans(spark, folder):
    """Records with their span of activity, for the spans that the watermark has closed: who left, and when."""
    records = stream(spark, folder, USER_PROGRESS, "ts").select("process_index", "ts", "processed")
    found = live.with_spans(records, ["process_index"], "12 hours", "60 days")
    return zoneless(live.run_appended(found, "spans"), "ts", "started", "ended").where("started IS NOT NULL")
