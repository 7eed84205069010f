"""The run report: one row per (process, threads, batch size)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftload.functions.formats import mmss
from weftload.functions.latency import latency_bucket
from weftload.operators.percentiles import count_bins, exact_percentiles, histogram_percentiles
from weftload.operators.throughput import qps_series, qps_summary, seconds_between, tick_start
from weftload.session import written_table

RUN_KEYS = ["process_index", "threads", "batch_size"]
LATENCY_PERCENTS = [50, 95, 99]


def per_second(amount: Column, seconds: Column) -> Column:
    """Rounded rate; 0 when no time has passed."""
    return F.when(seconds > 0, F.round(amount / seconds)).otherwise(F.lit(0)).cast("bigint")


def run_counts(ops: DataFrame, keys: Sequence[str] = RUN_KEYS) -> DataFrame:
    """Statements, nominal rows (batch size per statement) and exact rows."""
    return ops.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("queries"),
        F.sum(F.col("batch_size").cast("bigint")).alias("ops_nominal"),
        F.sum(F.col("n_rows").cast("bigint")).alias("ops_exact"),
    )


def run_report(
    ops: DataFrame,
    keys: Sequence[str] = RUN_KEYS,
    tick_seconds: int = 1,
    rate_seconds: int = 1,
    exact: bool = True,
    histogram: bool = True,
    drop_last: bool = True,
    template: str | None = None,
) -> DataFrame:
    """Counts, rates and latency percentiles of an operation log.

    With a ``template`` column (and ``load_type``), the report also holds how many templates a run
    has and whether any of them inserts; total and rate of such mixes are null (``blank_mixed``).

    Three narrow scans of ``ops``: per (run, tick) for counts and rates; per (run, bin)
    for both kinds of percentile; and the few bins that hold the exact ranks. Elapsed is
    from the first start to the last completion.
    """
    keys = list(keys)
    end = F.col("start_ts") + F.make_dt_interval(
        F.lit(0), F.lit(0), F.lit(0),
        (F.coalesce(F.col("latency_ms"), F.lit(0.0)) / 1000).cast("decimal(18,6)"),
    )
    # Keys that are also summed (batch_size) need a second name.
    source = ops.select(
        *keys, F.col("batch_size").cast("bigint").alias("_nominal"), "n_rows", "start_ts",
        "latency_ms", end.alias("_end"), tick_start(F.col("start_ts"), tick_seconds).alias("tick"),
    )
    per_tick = source.groupBy(*keys, "tick").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("_nominal").alias("ops_nominal"),
        F.sum(F.col("n_rows").cast("bigint")).alias("ops_exact"),
        F.sum("latency_ms").alias("_latency"),
        F.count("latency_ms").alias("_samples"),
        F.min("start_ts").alias("_start"),
        F.max("_end").alias("_end"),
    )
    # A row per run and tick; totals and rates both start from it.
    ticks = written_table(per_tick, "ticks")
    elapsed = seconds_between(F.min("_start"), F.max("_end"))
    totals = (
        ticks.groupBy(*keys)
        .agg(
            elapsed.alias("elapsed_s"),
            F.sum("n").alias("queries"),
            F.sum("ops_nominal").alias("ops_nominal"),
            F.sum("ops_exact").alias("ops_exact"),
            (F.sum("_latency") / F.sum("_samples")).alias("lat_avg"),
        )
        .withColumn("ops_per_s", per_second(F.col("ops_nominal"), F.col("elapsed_s")))
    )
    series = qps_series(ticks, keys, tick_seconds, rate_seconds, drop_last)
    report = totals.join(qps_summary(series, keys), keys, "left").na.fill(
        0, ["qps_avg", "qps_p1", "qps_p5", "qps_p95", "qps_p99"]
    )
    if exact or histogram:
        bins = written_table(
            count_bins(ops, keys, "latency_ms", {"bucket": latency_bucket(F.col("latency_ms"))}),
            "bins",
        )
        if exact:
            found = exact_percentiles(ops, keys, "latency_ms", LATENCY_PERCENTS, "lat_p", bins)
            report = report.join(found, keys, "left")
        if histogram:
            merged = bins.groupBy(*keys, "bucket").agg(F.sum("_n").alias("n"))
            found = histogram_percentiles(merged, keys, LATENCY_PERCENTS, "lat_hist_p")
            report = report.join(found, keys, "left")
    # No samples: every latency figure is 0.
    report = report.na.fill(0.0, [c for c in report.columns if c.startswith("lat_")])
    return report if template is None else blank_mixed(report.join(run_mix(ops, keys, template), keys))


def run_mix(ops: DataFrame, keys: Sequence[str], template: str) -> DataFrame:
    """Templates per run, and whether any of them inserts. A row per run and template is shuffled."""
    writes = F.col("load_type").isin("insert", "replace")
    each = ops.groupBy(*keys, template).agg(F.coalesce(F.bool_or(writes), F.lit(False)).alias("_writes"))
    return each.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_templates"), F.bool_or("_writes").alias("any_insert")
    )


def blank_mixed(report: DataFrame) -> DataFrame:
    """Rows per second say nothing when a mix of templates contains inserts: null then."""
    mixed = (F.col("n_templates") > 1) & F.col("any_insert")
    for name in ("ops_nominal", "ops_per_s"):
        report = report.withColumn(name, F.when(~mixed, F.col(name)))
    return report


def report_json(report: DataFrame, custom: str = "", latency: str = "lat_hist_p") -> DataFrame:
    """The nested form, one typed struct per run; ``to_json`` or ``write.json`` it."""
    column = custom_column(custom)
    parts = [
        F.col("threads"),
        F.col("batch_size"),
        mmss(F.col("elapsed_s")).alias("time"),
        F.col("ops_nominal").alias("total_operations"),
        F.col("ops_per_s").alias("operations_per_second"),
        F.struct(
            *[F.col(f"qps_{n}").alias(n) for n in ("avg", "p99", "p95", "p5", "p1")]
        ).alias("qps"),
        F.struct(
            F.round("lat_avg", 1).alias("avg"),
            *[F.round(f"{latency}{p}", 1).alias(f"p{p}") for p in LATENCY_PERCENTS],
        ).alias("latency"),
    ]
    if column:
        name, value = column
        parts.append(
            F.struct(F.lit(name).alias("name"), F.lit(value).alias("value")).alias("custom_column")
        )
    return report.select("process_index", F.struct(*parts).alias("report"))


def custom_column(text: str) -> tuple[str, str] | None:
    """``name/value`` split at the first slash; nothing without one."""
    name, slash, value = text.partition("/")
    return (name, value) if slash else None


# Column titles of the compact table, in order.
INSERT_TITLES = [
    "Threads", "Batch", "Time", "Total Docs", "Docs/Sec", "Avg QPS", "p99 QPS", "p95 QPS",
    "p5 QPS", "p1 QPS", "Lat Avg", "Lat p50", "Lat p95", "Lat p99",
]
OTHER_TITLES = [
    "Threads", "Batch", "Time", "Total Ops", "Avg QPS", "p99 QPS", "p95 QPS",
    "p5 QPS", "p1 QPS", "Lat Avg", "Lat p50", "Lat p95", "Lat p99",
]


def report_table(
    report: DataFrame, insert: bool, custom: str = "", latency: str = "lat_hist_p"
) -> DataFrame:
    """The compact table of insert runs or of all other runs; write it with ``sep=';'``."""
    total = F.coalesce(F.col("ops_nominal").cast("string"), F.lit("N/A"))
    rate = F.coalesce(F.col("ops_per_s").cast("string"), F.lit("N/A"))
    values = [
        F.col("threads"), F.col("batch_size"), mmss(F.col("elapsed_s")), total,
        *([rate] if insert else []),
        *[F.col(f"qps_{n}") for n in ("avg", "p99", "p95", "p5", "p1")],
        F.round("lat_avg", 1),
        *[F.round(f"{latency}{p}", 1) for p in LATENCY_PERCENTS],
    ]
    titles = INSERT_TITLES if insert else OTHER_TITLES
    column = custom_column(custom)
    lead = [F.lit(column[1]).alias(column[0])] if column else []
    return report.select(*lead, *[v.alias(t) for v, t in zip(values, titles)])


def report_long(report: DataFrame, latency: str = "lat_hist_p") -> DataFrame:
    """One row per figure: ``(run keys, line, name, value)``.

    Insert runs list document counts and all four rate percentiles, other runs the upper two.
    """
    insert = F.col("load_type").isin("insert", "replace")

    def figure(name: str, value: Column, shown: Column | None = None) -> Column:
        return F.struct(
            F.lit(name).alias("name"),
            value.cast("double").alias("value"),
            (shown if shown is not None else F.lit(True)).alias("shown"),
        )

    figures = F.array(
        figure("total_time_s", F.col("elapsed_s")),
        figure("total_queries", F.col("queries")),
        figure("threads", F.col("threads")),
        figure("batch_size", F.col("batch_size")),
        figure("total_docs", F.col("ops_nominal"), insert),
        figure("docs_per_s", F.col("ops_per_s"), insert),
        figure("qps_avg", F.col("qps_avg")),
        figure("qps_p1", F.col("qps_p1"), insert),
        figure("qps_p5", F.col("qps_p5"), insert),
        figure("qps_p95", F.col("qps_p95")),
        figure("qps_p99", F.col("qps_p99")),
        figure("lat_avg", F.col("lat_avg")),
        *[figure(f"lat_p{p}", F.col(f"{latency}{p}")) for p in LATENCY_PERCENTS],
    )
    return (
        report.select(*RUN_KEYS, F.posexplode(figures).alias("line", "_f"))
        .where("_f.shown")
        .select(*RUN_KEYS, "line", F.col("_f.name").alias("name"), F.col("_f.value").alias("value"))
    )
