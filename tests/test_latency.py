"""Percentiles, buckets, rates and reports."""

import datetime as dt
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from weftload.functions.latency import bucket_middle, latency_bucket
from weftload.operators.percentiles import exact_percentiles, histogram_percentiles, latency_histogram
from weftload.operators.throughput import ops_per_tick, qps_series
from weftload.plans.report import (
    blank_mixed,
    report_json,
    report_long,
    report_table,
    run_report,
)
from weftload.sources.files import write_report_json, write_report_table

PERCENTS = [1, 5, 50, 95, 99]


def nearest(values, p):
    ordered = sorted(values)
    return ordered[max(math.ceil(len(ordered) * p / 100), 1) - 1]


def samples():
    rng = random.Random(11)
    data = {
        "hot": [rng.expovariate(1 / 50) for _ in range(3000)] + [77.5] * 1500,
        "one": [3.25],
        "ties": [5.0] * 40,
        "wide": [10 ** rng.uniform(-3, 6) for _ in range(500)],
        "signed": [rng.uniform(-5, 5) for _ in range(200)] + [0.0] * 50,
        "grid": [float(i) for i in range(1, 101)],
        "open": [1.0, 2.0, math.inf, math.inf],
    }
    return data


@pytest.mark.parametrize("few", [0, 1 << 16])
def test_exact_percentiles(spark, few):
    """Without intervals of few samples, every value is found by passes over ever finer parts."""
    data = samples()
    rows = [(k, v) for k, values in data.items() for v in values] + [("none", None), ("hot", None), ("hot", math.nan)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    found = exact_percentiles(df, ["k"], "v", PERCENTS, few=few).collect()
    assert {r.k for r in found} == set(data)
    for row in found:
        for p in PERCENTS:
            assert row[f"p{p}"] == nearest(data[row.k], p), (row.k, p)


def test_exact_percentiles_take_as_many_passes_as_needed(spark, monkeypatch):
    """Two clusters of values within one bin, each far narrower than a part of the one around it."""
    from weftload.operators import percentiles

    monkeypatch.setattr(percentiles, "FINE_BINS", 8)
    passes = []
    finer = percentiles._finer
    monkeypatch.setattr(percentiles, "_finer", lambda *a: passes.append(1) or finer(*a))
    values = [1.0] + [1.005 + i * 1e-9 for i in range(200)] + [1.005 + 1e-5 + i * 1e-12 for i in range(300)]
    df = spark.createDataFrame([("k", v) for v in values], "k string, v double").repartition(4)
    found = exact_percentiles(df, ["k"], "v", PERCENTS, few=10).first()
    assert [found[f"p{p}"] for p in PERCENTS] == [nearest(values, p) for p in PERCENTS]
    assert len(passes) >= 3


def test_no_number_is_no_sample(spark):
    df = spark.createDataFrame([("k", 1.5), ("k", math.nan), ("k", None)], "k string, latency_ms double")
    assert [tuple(r) for r in latency_histogram(df, ["k"], "latency_ms").collect()] == [("k", 2, 1)]


def test_known_histogram_figures(spark):
    """A second and a bit is reported as 1050, half a second and a bit as 505."""
    df = spark.createDataFrame(
        [("s", 1000.4 + i / 10) for i in range(10)] + [("h", 500.6 + i / 10) for i in range(10)],
        "k string, latency_ms double",
    )
    found = histogram_percentiles(latency_histogram(df, ["k"], "latency_ms"), ["k"], [50, 95, 99])
    rows = {r.k: r for r in found.collect()}
    assert (rows["s"].p50, rows["s"].p95, rows["s"].p99) == (1050.0, 1050.0, 1050.0)
    assert (rows["h"].p50, rows["h"].p95, rows["h"].p99) == (505.0, 505.0, 505.0)


@pytest.mark.parametrize(
    ("latency", "bucket"),
    [(-1, 1), (0, 1), (0.2, 1), (1, 1), (1.01, 2), (100, 100), (100.1, 110), (1000, 1000),
     (1000.1, 1100), (10000, 10000), (10001, 11000), (100000, 100000), (5e6, 100000)],
)
def test_buckets(spark, latency, bucket):
    row = spark.range(1).select(latency_bucket(F.lit(float(latency)))).first()
    assert row[0] == bucket


def test_histogram_is_within_half_a_bucket(spark):
    rng = random.Random(3)
    values = [10 ** rng.uniform(0, 4.99) for _ in range(4000)]
    df = spark.createDataFrame([("a", v) for v in values], "k string, latency_ms double")
    row = histogram_percentiles(latency_histogram(df, ["k"], "latency_ms"), ["k"], PERCENTS).first()
    for p in PERCENTS:
        exact = nearest(values, p)
        width = 1 if exact <= 100 else 10 if exact <= 1000 else 100 if exact <= 10000 else 1000
        assert abs(row[f"p{p}"] - exact) <= width / 2 + 1e-9
    assert spark.range(1).select(bucket_middle(F.lit(100000))).first()[0] == 99500.0


START = dt.datetime(2024, 5, 1, 12, 0, 0)


def ops(spark, rows):
    full = [
        (p, t, b, n, START + dt.timedelta(seconds=s), latency) for p, t, b, n, s, latency in rows
    ]
    return spark.createDataFrame(
        full,
        "process_index int, threads int, batch_size int, n_rows int, start_ts timestamp_ntz, latency_ms double",
    )


def test_report_of_ten_paced_inserts(spark):
    """One insert per second: ten queries, about one document per second, p50 = 1050."""
    log = ops(spark, [(1, 1, 1, 1, i * 1.001, 1000.6 + i / 100) for i in range(10)])
    row = run_report(log).first()
    assert (row.queries, row.ops_nominal, row.ops_exact, row.ops_per_s) == (10, 10, 10, 1)
    assert row.qps_avg == 1
    assert 1000 < row.lat_avg < 1010
    assert (row.lat_hist_p50, row.lat_hist_p95, row.lat_hist_p99) == (1050.0,) * 3
    assert row.lat_p50 == pytest.approx(1000.64)


def test_report_counts_and_missing_samples(spark):
    log = ops(spark, [(1, 2, 10, 10, 0, 5.0), (1, 2, 10, 3, 1, None), (2, 1, 1, 1, 0, None)])
    rows = {r.process_index: r for r in run_report(log).collect()}
    assert (rows[1].ops_nominal, rows[1].ops_exact) == (20, 13)
    assert rows[1].lat_avg == 5.0
    assert (rows[2].lat_avg, rows[2].lat_p50, rows[2].lat_hist_p99, rows[2].qps_avg) == (0, 0, 0, 0)
    assert rows[2].ops_per_s == 0 and rows[2].elapsed_s == 0


def test_qps_fill_and_last(spark):
    log = ops(spark, [(1, 1, 1, 1, s, 1.0) for s in (0, 0.5, 3, 3.1, 3.2, 5)])
    ticks = ops_per_tick(log, ["process_index"], 1)

    def rates(**options):
        found = qps_series(ticks, ["process_index"], 1, **options).orderBy("tick").collect()
        return [r.qps for r in found]

    assert rates() == [2, 3]
    assert rates(drop_last=False) == [2, 3, 1]
    assert rates(fill_empty=True) == [2, 0, 0, 3]


def test_report_shapes(spark, tmp_path):
    log = ops(spark, [(1, 4, 1000, 1000, i / 10, 77.0) for i in range(30)])
    report = run_report(log)
    table = report_table(report, insert=True, custom="custom/abc")
    write_report_table(table.coalesce(1), str(tmp_path / "csv"))
    lines = next((tmp_path / "csv").glob("part-*.csv")).read_text().splitlines()
    assert lines[0] == (
        "custom;Threads;Batch;Time;Total Docs;Docs/Sec;Avg QPS;p99 QPS;p95 QPS;p5 QPS;p1 QPS;"
        "Lat Avg;Lat p50;Lat p95;Lat p99"
    )
    assert lines[1].startswith("abc;4;1000;00:02;30000;")
    assert "Docs/Sec" not in report_table(report, insert=False).columns
    write_report_json(report_json(report, "a/b/c").coalesce(1), str(tmp_path / "json"))
    data = json.loads(next((tmp_path / "json").glob("part-*.json")).read_text())
    assert data["threads"] == 4 and data["total_operations"] == 30000
    assert data["latency"]["p50"] == 76.5
    assert data["custom_column"] == {"name": "a", "value": "b/c"}
    assert "custom_column" not in report_json(report, "plain").schema["report"].dataType.names
    long = report_long(report.withColumn("load_type", F.lit("select"))).collect()
    names = {r.name for r in long}
    assert "total_docs" not in names and "qps_p1" not in names and "qps_p95" in names
    mixed = blank_mixed(report.withColumn("n_templates", F.lit(2)).withColumn("any_insert", F.lit(True)))
    shown = report_table(mixed, insert=True).first()
    assert shown["Total Docs"] == "N/A" and shown["Docs/Sec"] == "N/A"
