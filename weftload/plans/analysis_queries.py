"""Registered queries: latency, rates and run reports over the operation log.

The log has three processes, so each of them holds a third of all rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftload.functions.formats import rate_text
from weftload.functions.latency import delayed_latency, latency_bucket
from weftload.operators.percentiles import (
    exact_percentiles,
    histogram_percentiles,
    latency_histogram,
)
from weftload.operators.throughput import (
    dps_series,
    ops_per_tick,
    progress_percent,
    qps_series,
    qps_summary,
)
from weftload.plans import check_sql as c
from weftload.plans import report as rp
from weftload.plans.inputs import OPS, SLOW_OPS, select, sql
from weftload.plans.registry import query

HOUR = 3600
KEYS = "process_index, threads, batch_size"
OPS_ROWS = sql(OPS)
SLOW_ROWS = sql(SLOW_OPS)
PERCENTS = [50, 95, 99]


def ops(spark, folder) -> DataFrame:
    return select(spark, folder, OPS)


@query(
    "run_counts",
    f"""SELECT {KEYS}, count(*) AS queries, CAST(sum(batch_size) AS BIGINT) AS ops_nominal,
 CAST(sum(n_rows) AS BIGINT) AS ops_exact FROM {OPS_ROWS} GROUP BY {KEYS}""",
)
def run_counts(spark, folder):
    return rp.run_counts(ops(spark, folder))


@query(
    "latency_bucket",
    f"SELECT run_key, latency_ms, {c.BUCKET} AS bucket FROM {SLOW_ROWS}",
)
def bucket(spark, folder):
    return select(spark, folder, SLOW_OPS).withColumn(
        "bucket", latency_bucket(F.col("latency_ms"))
    )


@query(
    "latency_hist",
    f"SELECT run_key, {c.BUCKET} AS bucket, count(*) AS n FROM {SLOW_ROWS} GROUP BY ALL",
)
def latency_hist(spark, folder):
    return latency_histogram(select(spark, folder, SLOW_OPS), ["run_key"], "latency_ms")


@query(
    "latency_exact",
    f"""SELECT p.*, lat_avg FROM ({c.nearest_rank('latency_ms', 'process_index', OPS_ROWS, PERCENTS)}) p
 JOIN (SELECT process_index, round(avg(latency_ms), 6) AS lat_avg FROM {OPS_ROWS} GROUP BY ALL)
 USING (process_index)""",
)
def latency_exact(spark, folder):
    log = ops(spark, folder)
    mean = log.groupBy("process_index").agg(F.round(F.avg("latency_ms"), 6).alias("lat_avg"))
    return exact_percentiles(log, ["process_index"], "latency_ms", PERCENTS).join(
        mean, "process_index"
    )


@query("latency_exact_slow", c.nearest_rank("latency_ms", "run_key", SLOW_ROWS, [1, 5, *PERCENTS]))
def latency_exact_slow(spark, folder):
    return exact_percentiles(
        select(spark, folder, SLOW_OPS), ["run_key"], "latency_ms", [1, 5, *PERCENTS]
    )


@query("latency_hist_pct", c.histogram_percentiles(SLOW_ROWS, "run_key", PERCENTS))
def latency_hist_pct(spark, folder):
    histogram = latency_histogram(select(spark, folder, SLOW_OPS), ["run_key"], "latency_ms")
    return histogram_percentiles(histogram, ["run_key"], PERCENTS)


@query(
    "latency_delay",
    f"SELECT op_id, greatest(latency_ms, 20.0 * threads) AS latency_ms FROM {OPS_ROWS}",
)
def latency_delay(spark, folder):
    """Each thread count has its own pause between statements."""
    return ops(spark, folder).select(
        "op_id",
        delayed_latency(F.col("latency_ms"), F.lit(20.0) * F.col("threads")).alias("latency_ms"),
    )


TICKS = (
    "(SELECT process_index, date_trunc('hour', start_ts) AS tick, count(*) AS n, "
    f"sum(n_rows) AS docs FROM {OPS_ROWS} GROUP BY ALL)"
)
SERIES = (
    "(SELECT process_index, tick, n, n AS qps FROM (SELECT *, max(tick) OVER "
    f"(PARTITION BY process_index) AS last_tick FROM {TICKS}) WHERE tick < last_tick)"
)


def ticks(spark, folder) -> DataFrame:
    return ops_per_tick(ops(spark, folder), ["process_index"], HOUR)


@query("qps_series", f"SELECT * FROM {SERIES}")
def series(spark, folder):
    """Rate per hour in hourly ticks; the log spans a month."""
    return qps_series(ticks(spark, folder), ["process_index"], HOUR, HOUR)


@query(
    "qps_series_filled",
    f"""WITH t AS (SELECT process_index, date_trunc('minute', start_ts) - to_minutes(CAST(minute(start_ts) % 10 AS BIGINT)) AS tick
   FROM {OPS_ROWS}),
n AS (SELECT process_index, tick, count(*) AS n FROM t GROUP BY ALL),
k AS (SELECT * FROM (SELECT *, max(tick) OVER (PARTITION BY process_index) AS last_tick FROM n) WHERE tick < last_tick),
s AS (SELECT process_index, unnest(generate_series(min(tick), max(tick), INTERVAL 10 MINUTES)) AS tick FROM k GROUP BY process_index)
SELECT s.process_index, s.tick, coalesce(k.n, 0) AS n, CAST(round(coalesce(k.n, 0) * 6) AS BIGINT) AS qps
FROM s LEFT JOIN k ON s.process_index = k.process_index AND s.tick = k.tick""",
)
def series_filled(spark, folder):
    per_tick = ops_per_tick(ops(spark, folder), ["process_index"], 600)
    return qps_series(per_tick, ["process_index"], 600, HOUR, fill_empty=True)


QPS_SUMMARY = (
    f"SELECT q.*, qps_avg FROM ({c.nearest_rank('qps', 'process_index', SERIES, [1, 5, 95, 99], 'qps_p')}) q "
    f"JOIN (SELECT process_index, CAST(round(avg(qps)) AS BIGINT) AS qps_avg FROM {SERIES} "
    "GROUP BY process_index) USING (process_index)"
)


@query("qps_summary", QPS_SUMMARY)
def summary(spark, folder):
    return qps_summary(series(spark, folder), ["process_index"])


@query(
    "dps_series",
    f"""WITH d AS (SELECT process_index, tick,
 CAST(sum(docs) OVER (PARTITION BY process_index ORDER BY tick) AS BIGINT) AS docs,
 date_diff('second', min(tick) OVER (PARTITION BY process_index), tick) + 3600 AS elapsed_s FROM {TICKS}),
r AS (SELECT *, docs * 3600.0 / elapsed_s AS r FROM d)
SELECT process_index, tick, docs, elapsed_s, round(docs / elapsed_s, 9) AS dps,
 CAST(CAST(round(r) AS BIGINT) AS STRING) AS shown FROM r""",
)
def dps(spark, folder):
    found = dps_series(ticks(spark, folder), ["process_index"], HOUR)
    return found.withColumn("shown", rate_text(F.col("dps") * HOUR)).withColumn(
        "dps", F.round("dps", 9)
    )


@query(
    "progress_pct",
    f"""WITH p AS (SELECT process_index, tick, n,
 CAST(sum(n) OVER (PARTITION BY process_index ORDER BY tick) AS BIGINT) AS processed FROM {TICKS})
SELECT process_index, tick, processed, CAST(round(processed * 100 / 4000) AS BIGINT) AS progress FROM p""",
)
def progress(spark, folder):
    found = progress_percent(ticks(spark, folder), ["process_index"], F.lit(4000))
    return found.select("process_index", "tick", "processed", "progress")


# ---------------------------------------------------------------- reports

FIGURES = [f"lat_p{p}" for p in PERCENTS] + [f"lat_hist_p{p}" for p in PERCENTS]
def _run_series(source: str) -> str:
    return f"""(SELECT *, n AS qps FROM (SELECT *, max(tick) OVER (PARTITION BY {KEYS}) AS last_tick FROM (
 SELECT {KEYS}, date_trunc('hour', start_ts) AS tick, count(*) AS n FROM {source} GROUP BY ALL))
 WHERE tick < last_tick)"""


def _report(source: str) -> str:
    series = _run_series(source)
    return f"""
WITH ops AS (SELECT * FROM {source}),
t AS (SELECT {KEYS}, count(*) AS queries, CAST(sum(batch_size) AS BIGINT) AS ops_nominal,
  CAST(sum(n_rows) AS BIGINT) AS ops_exact, round(avg(latency_ms), 6) AS lat_avg,
  date_diff('microsecond', min(start_ts), max(start_ts + to_microseconds(CAST(round(latency_ms * 1000) AS BIGINT))))
    / 1000000 AS elapsed_s
  FROM ops GROUP BY {KEYS}),
e AS ({c.nearest_rank('latency_ms', KEYS, 'ops', PERCENTS, 'lat_p')}),
h AS ({c.histogram_percentiles('ops', KEYS, PERCENTS, 'lat_hist_p')}),
qa AS (SELECT {KEYS}, CAST(round(avg(qps)) AS BIGINT) AS qps_avg FROM {series} GROUP BY {KEYS}),
q AS ({c.nearest_rank('qps', KEYS, series, [1, 5, 95, 99], 'qps_p')})
SELECT t.*, CASE WHEN elapsed_s > 0 THEN CAST(round(ops_nominal / elapsed_s) AS BIGINT) ELSE 0 END AS ops_per_s,
  qps_avg, qps_p1, qps_p5, qps_p95, qps_p99, {', '.join(FIGURES)}
FROM t JOIN e USING ({KEYS}) JOIN h USING ({KEYS}) JOIN qa USING ({KEYS}) JOIN q USING ({KEYS})"""


REPORT = _report(OPS_ROWS)


def report(spark, folder) -> DataFrame:
    return rp.run_report(ops(spark, folder), tick_seconds=HOUR, rate_seconds=HOUR)


def rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("lat_avg", F.round("lat_avg", 6))


@query("run_report", REPORT)
def run_report(spark, folder):
    return rounded(report(spark, folder))


# The third process runs one template at a time, under a number of its own.
APART = "CASE WHEN process_index = 3 THEN CAST(10 + template_idx AS INT) ELSE process_index END"
APART_ROWS = f"(SELECT {APART} AS process_index, * EXCLUDE (process_index) FROM {OPS_ROWS})"


@query(
    "run_report_templates",
    f"""SELECT r.* EXCLUDE (ops_nominal, ops_per_s), n_templates, any_insert,
 CASE WHEN NOT (n_templates > 1 AND any_insert) THEN ops_nominal END AS ops_nominal,
 CASE WHEN NOT (n_templates > 1 AND any_insert) THEN ops_per_s END AS ops_per_s
 FROM ({_report(APART_ROWS)}) r JOIN (SELECT {KEYS}, count(DISTINCT template_idx) AS n_templates,
  bool_or(load_type IN ('insert', 'replace')) AS any_insert FROM {APART_ROWS} GROUP BY {KEYS}) USING ({KEYS})""",
)
def run_report_templates(spark, folder):
    """The report blanks totals of mixed loads itself."""
    log = ops(spark, folder).withColumn("process_index", F.expr(APART))
    return rounded(rp.run_report(log, tick_seconds=HOUR, rate_seconds=HOUR, template="template_idx"))


@query(
    "run_report_mixed",
    f"""WITH t AS (SELECT threads, count(*) AS queries, count(DISTINCT load_type) AS n_templates,
  bool_or(load_type IN ('insert', 'replace')) AS any_insert, CAST(sum(batch_size) AS BIGINT) AS total
  FROM {OPS_ROWS} GROUP BY threads)
SELECT threads, queries, n_templates, any_insert,
  CASE WHEN NOT (n_templates > 1 AND any_insert) THEN total END AS ops_nominal FROM t
UNION ALL
SELECT CAST(100 + template_idx AS INT), count(*), 1, bool_or(load_type IN ('insert', 'replace')),
  CAST(sum(batch_size) AS BIGINT) FROM {OPS_ROWS} GROUP BY template_idx""",
)
def run_report_mixed(spark, folder):
    """Runs by thread count are mixes with inserts, runs by template are not."""
    log = ops(spark, folder)

    def counted(label) -> DataFrame:
        return log.groupBy(label.cast("int").alias("threads")).agg(
            F.count(F.lit(1)).alias("queries"),
            F.count_distinct("load_type").alias("n_templates"),
            F.bool_or(F.col("load_type").isin("insert", "replace")).alias("any_insert"),
            F.sum(F.col("batch_size").cast("bigint")).alias("ops_nominal"),
        )

    both = counted(F.col("threads")).unionByName(counted(F.col("template_idx") + 100))
    return rp.blank_mixed(both.withColumn("ops_per_s", F.col("ops_nominal"))).drop("ops_per_s")


TIME = (
    "printf('%02d:%02d', CAST(floor(floor(elapsed_s) / 60) AS BIGINT), "
    "CAST(floor(elapsed_s) AS BIGINT) % 60)"
)


@query(
    "report_json",
    f"""SELECT process_index, threads, batch_size, {TIME} AS time, ops_nominal AS total_operations,
 ops_per_s AS operations_per_second, qps_avg, qps_p99, qps_p95, qps_p5, qps_p1, round(lat_avg, 1) AS latency_avg,
 lat_hist_p50 AS latency_p50, lat_hist_p95 AS latency_p95, lat_hist_p99 AS latency_p99, 'custom' AS column_name, 'a/b' AS column_value
 FROM ({REPORT})""",
)
def report_json(spark, folder):
    """The nested report, written as text and read back into columns."""
    nested = rp.report_json(report(spark, folder), "custom/a/b")
    schema = nested.schema["report"].dataType
    read = nested.select("process_index", F.to_json("report").alias("j")).select(
        "process_index", F.from_json("j", schema).alias("r")
    )
    return read.select(
        "process_index", "r.threads", "r.batch_size", "r.time", "r.total_operations",
        "r.operations_per_second", F.col("r.qps.avg").alias("qps_avg"),
        *[F.col(f"r.qps.p{p}").alias(f"qps_p{p}") for p in (99, 95, 5, 1)],
        F.col("r.latency.avg").alias("latency_avg"),
        *[F.col(f"r.latency.p{p}").alias(f"latency_p{p}") for p in (50, 95, 99)],
        F.col("r.custom_column.name").alias("column_name"),
        F.col("r.custom_column.value").alias("column_value"),
    )


@query(
    "report_table",
    f"""SELECT threads AS "Threads", batch_size AS "Batch", {TIME} AS "Time",
 CAST(ops_nominal AS STRING) AS "Total Docs", CAST(ops_per_s AS STRING) AS "Docs/Sec", qps_avg AS "Avg QPS",
 qps_p99 AS "p99 QPS", qps_p95 AS "p95 QPS", qps_p5 AS "p5 QPS", qps_p1 AS "p1 QPS",
 round(lat_avg, 1) AS "Lat Avg", lat_hist_p50 AS "Lat p50", lat_hist_p95 AS "Lat p95", lat_hist_p99 AS "Lat p99"
 FROM ({REPORT})""",
)
def report_table(spark, folder):
    return rp.report_table(report(spark, folder), insert=True)


@query(
    "report_custom",
    f"""SELECT 'a/b' AS custom, threads AS "Threads", batch_size AS "Batch", {TIME} AS "Time",
 CAST(ops_nominal AS STRING) AS "Total Ops", qps_avg AS "Avg QPS",
 qps_p99 AS "p99 QPS", qps_p95 AS "p95 QPS", qps_p5 AS "p5 QPS", qps_p1 AS "p1 QPS",
 round(lat_avg, 1) AS "Lat Avg", lat_hist_p50 AS "Lat p50", lat_hist_p95 AS "Lat p95", lat_hist_p99 AS "Lat p99"
 FROM ({REPORT})""",
)
def report_custom(spark, folder):
    return rp.report_table(report(spark, folder), insert=False, custom="custom/a/b")


LONG = [
    ("total_time_s", "elapsed_s", False), ("total_queries", "queries", False),
    ("threads", "threads", False), ("batch_size", "batch_size", False),
    ("total_docs", "ops_nominal", True), ("docs_per_s", "ops_per_s", True),
    ("qps_avg", "qps_avg", False), ("qps_p1", "qps_p1", True), ("qps_p5", "qps_p5", True),
    ("qps_p95", "qps_p95", False), ("qps_p99", "qps_p99", False), ("lat_avg", "lat_avg", False),
    ("lat_p50", "lat_hist_p50", False), ("lat_p95", "lat_hist_p95", False),
    ("lat_p99", "lat_hist_p99", False),
]
LOAD_TYPE = "CASE WHEN process_index = 2 THEN 'select' ELSE 'insert' END"


@query(
    "report_long",
    f"WITH r AS ({REPORT}) "
    + " UNION ALL ".join(
        f"SELECT {KEYS}, CAST({i} AS INT) AS line, '{name}' AS name, CAST({column} AS DOUBLE) AS value "
        f"FROM r WHERE {'process_index <> 2' if insert else 'true'}"
        for i, (name, column, insert) in enumerate(LONG)
    ),
)
def report_long(spark, folder):
    typed = rounded(report(spark, folder)).withColumn("load_type", F.expr(LOAD_TYPE))
    return rp.report_long(typed)
