"""Streams over several files give what the batch form gives."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from weftload.operators import combined as comb
from weftload.operators import monitor as mon
from weftload.operators.percentiles import latency_histogram
from weftload.operators.throughput import ops_per_tick
from weftload.sources.files import read_progress, stream_progress, write_progress
from weftload.streaming import live

START = dt.datetime(2024, 5, 1, 12, 0, 0)


@pytest.fixture(scope="module")
def log(spark, tmp_path_factory):
    """Four files in time order; one process writes most of the log."""
    path = str(tmp_path_factory.mktemp("log") / "log.parquet")
    base = spark.range(4000).select(
        F.col("id").alias("processed"),
        F.when(F.col("id") % 10 < 7, 1).otherwise(F.col("id") % 4 + 2).cast("int").alias("process_index"),
        (F.lit(START).cast("timestamp") + F.make_dt_interval(secs=(F.col("id") * 3).cast("decimal(18,6)"))).alias("ts"),
        ((F.col("id") * 7919 % 1300) / 7).alias("latency_ms"),
        F.lit(2).alias("batch_size"),
        F.lit(2).alias("n_rows"),
    )
    for part in range(4):
        base.where(F.col("processed").between(part * 1000, part * 1000 + 999)).coalesce(1).write.mode(
            "append"
        ).parquet(path)
    table = spark.read.parquet(path)
    stream = live.event_time(live.stream_table(spark, path, table.schema, files_per_batch=1), "ts")
    return table, stream


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_rates(log):
    table, stream = log
    found = live.run_available(live.qps_stream(stream, ["process_index"], 60, 60, "ts"), "t-qps")
    batch = ops_per_tick(table, ["process_index"], 60, "ts")
    assert rows(found.select("process_index", "tick", "n")) == rows(batch.select("process_index", "tick", "n"))


def test_sliding_sizes(log):
    table, stream = log
    found = live.run_available(
        live.size_stream(stream, ["process_index"], "processed", "5 minutes", "1 minute"), "t-size"
    )
    batch = live.size_stream(table, ["process_index"], "processed", "5 minutes", "1 minute")
    assert rows(found) == rows(batch)


def test_newest(log):
    table, stream = log
    slim = ["process_index", "ts", "processed"]
    found = live.run_available(
        live.newest_stream(stream.select(slim), ["process_index"], ["ts", "processed"]), "t-last"
    )
    assert rows(found) == rows(mon.newest(table.select(slim), ["process_index"], ["ts", "processed"]))


def test_histogram(log):
    table, stream = log
    found = live.run_available(live.histogram_stream(stream, ["process_index"], "latency_ms"), "t-hist")
    assert rows(found) == rows(latency_histogram(table, ["process_index"], "latency_ms"))


def test_combined_lines_carry_old_processes(spark, tmp_path):
    """The second file has one process only; the other one keeps its last record."""
    path = str(tmp_path / "p.parquet")
    parts = [[(1, START, 5), (2, START, 7)], [(1, START + dt.timedelta(seconds=1), 9)]]
    schema = "process_index int, ts timestamp, processed long"
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
    config = spark.createDataFrame(
        [(1, "t", "insert"), (2, "t2", "replace")], "process_index int, target string, load_type string"
    )
    status = spark.createDataFrame(
        [("t", 1, 0, 465, 1, 6), ("t2", 1, 0, 465, 1, 6)],
        "target string, disk_chunks long, is_optimizing long, disk_bytes long, ram_bytes long, indexed_documents long",
    )
    stream = live.event_time(
        live.stream_table(spark, path, spark.read.parquet(path).schema, files_per_batch=1), "ts"
    )
    root = str(tmp_path / "root")
    lines = live.combined_lines(stream, config, status, root).orderBy("epoch").collect()
    assert len(lines) == 2
    assert [(r["size"], r.processes, r.inserted) for r in lines][-1] == (930, 2, 6)
    # A restart goes on where the first run stopped.
    late = [(3, START, 1), (1, START + dt.timedelta(seconds=2), 11)]
    spark.createDataFrame(late, schema).coalesce(1).write.mode("append").parquet(path)
    more = config.unionByName(
        spark.createDataFrame([(3, "t", "insert")], config.schema)
    )
    lines = live.combined_lines(stream, more, status, root).orderBy("epoch").collect()
    assert [r.processes for r in lines][-1] == 3 and len(lines) == 3


def test_spans_are_emitted_when_closed(spark, tmp_path):
    """Append output holds back what the watermark has not passed."""
    path = str(tmp_path / "s.parquet")
    schema = "process_index int, ts timestamp"
    for seconds in ([0, 5, 8, 60], [64, 300], [900]):
        data = [(1, START + dt.timedelta(seconds=s)) for s in seconds]
        spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(path)
    table = spark.read.parquet(path)
    stream = live.event_time(live.stream_table(spark, path, table.schema, 1), "ts", "10 seconds")
    out = str(tmp_path / "out")
    query = (
        live.span_stream(stream, ["process_index"], "20 seconds")
        .writeStream.outputMode("append").format("parquet")
        .option("path", out).option("checkpointLocation", str(tmp_path / "state"))
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    found = {(r.started, r.ended, r.n) for r in spark.read.parquet(out).collect()}
    batch = {(r.started, r.ended, r.n) for r in mon.active_spans(table, ["process_index"], 20).collect()}
    assert found and found < batch
    assert (START, START + dt.timedelta(seconds=8), 3) in found


def test_progress_files(spark, tmp_path):
    path = str(tmp_path / "progress")
    records = spark.range(20).select(
        (F.lit(START).cast("timestamp") + F.make_dt_interval(secs=F.col("id").cast("decimal(18,6)"))).alias("ts"),
        (F.col("id") % 3).cast("int").alias("process_index"),
        F.col("id").alias("processed"), F.lit("12%").alias("progress"),
    )
    write_progress(records, path)
    slim = ["process_index", "ts", "processed", "progress"]
    assert rows(read_progress(spark, path).select(slim)) == rows(records.select(slim))
    plan = live.newest_stream(
        live.event_time(stream_progress(spark, path), "ts").select("process_index", "ts", "processed"),
        ["process_index"], ["ts", "processed"],
    )
    found = live.run_available(plan, "t-progress")
    assert {r.process_index: r.processed for r in found.collect()} == {0: 18, 1: 19, 2: 17}


def written_in_order(spark, path, data, schema, files):
    """Rows (tuples with a time first) to Parquet files in time order."""
    data = sorted(data, key=lambda r: r[0])
    for part in range(files):
        a, b = part * len(data) // files, (part + 1) * len(data) // files
        spark.createDataFrame(data[a:b], schema).coalesce(1).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


@pytest.fixture(scope="module")
def live_session(spark, tmp_path_factory):
    """Records of processes that come, pause and leave, and status reports, in six files each."""
    import random

    rng = random.Random(9)
    records, reports = [], []
    for p in range(1, 8):
        t = rng.uniform(0, 200)
        for n in range(30):
            t += rng.choice([1, 4, 4, 30]) * rng.random()
            records.append((START + dt.timedelta(seconds=round(t, 3)), p, n))
    for _ in range(400):
        name = rng.choice(["disk_chunks", "optimizing", "disk_bytes", "indexed_documents", "other"])
        at = START + dt.timedelta(seconds=round(rng.uniform(-20, 500), 3))
        reports.append((at, rng.choice(["a", "b"]), name, rng.choice(["0", "3", "8", "n/a"])))
    root = tmp_path_factory.mktemp("live")
    paths = str(root / "records.parquet"), str(root / "status.parquet")
    tables = (
        written_in_order(spark, paths[0], records, "ts timestamp, process_index long, processed long", 6),
        written_in_order(spark, paths[1], reports, "ts timestamp, target string, variable string, value string", 6),
    )
    config = spark.createDataFrame(
        [(1, "a", "insert"), (2, "b", "replace"), (3, "", "insert"), (4, "a", "select"), (5, "c", "insert"), (6, "b", "insert")],
        "process_index long, target string, load_type string",
    )
    return paths, tables, config


@pytest.mark.parametrize("files", [1, 5])
def test_combined_line_per_tick(spark, live_session, tmp_path, files):
    """As the batch form, whatever a trigger holds; the second run finds nothing new and gives the same lines."""
    paths, (records, status), config = live_session
    batch = comb.combined_per_tick(records, config, status, 5, 20)
    columns = batch.columns
    streams = [live.event_time(live.stream_table(spark, p, t.schema, files), "ts") for p, t in zip(paths, (records, status))]
    root = str(tmp_path / "root")
    found = live.combined_stream(*streams, config, 5, 20, 30, root)
    assert rows(found.select(columns)) == rows(batch)
    stored = spark.read.parquet(f"{root}/lines")
    assert 0 < stored.count() < batch.count()
    if files == 5:
        again = live.combined_stream(*streams, config, 5, 20, 30, root)
        assert rows(again.select(columns)) == rows(batch)
        assert len(list((tmp_path / "root" / "spans").glob("slot=*"))) <= 2


def late_log(spark, path):
    """Seconds 0 to 299 in order; then a row that is ten minutes late, which append output leaves out."""
    seconds = [*range(0, 300, 3), *range(900, 930, 3)]
    written_in_order(spark, path, [(START + dt.timedelta(seconds=s), 1, s) for s in seconds], LOG, 3)
    spark.createDataFrame([(START, 1, -1), (START + dt.timedelta(seconds=960), 1, 960)], LOG).coalesce(1).write.mode("append").parquet(path)
    return live.event_time(live.stream_table(spark, path, spark.read.parquet(path).schema, 1), "ts", "30 seconds")


LOG = "ts timestamp, process_index int, size long"


def test_rates_in_append_mode(spark, tmp_path):
    stream = late_log(spark, str(tmp_path / "log.parquet"))
    found = live.run_appended(live.qps_stream(stream, ["process_index"], 60, 60, "ts"), "append").orderBy("tick").collect()
    ticks = [(int((r.tick - START).total_seconds()), r.n) for r in found]
    assert ticks == [(60 * k, 20) for k in range(5)]  # 900 is open: the newest row is at 960, the watermark at 930


def test_sizes_in_append_mode(spark, tmp_path):
    stream = late_log(spark, str(tmp_path / "log.parquet"))
    plan = live.size_stream(stream, ["process_index"], "size", "2 minutes", "1 minute")
    found = {int((r.window_start - START).total_seconds()): (r.n, r.size_min, r.size_max) for r in live.run_appended(plan, "append").collect()}
    assert found == {-60: (20, 0, 57), **{60 * k: (40, 60 * k, 60 * k + 117) for k in range(4)}, 240: (20, 240, 297)}


def test_replayed_files_give_each_record_once(spark, tmp_path):
    """Files written again, within a run and before a restart."""
    path, root = str(tmp_path / "progress"), str(tmp_path / "root")
    records = spark.range(40).select(
        (F.lit(START).cast("timestamp") + F.make_dt_interval(secs=F.col("id").cast("decimal(18,6)"))).alias("ts"),
        (F.col("id") % 3).cast("int").alias("process_index"), F.col("id").alias("processed"),
    )

    def run():
        stream = live.event_time(stream_progress(spark, path, 2), "ts", "1 hour")
        plan = live.distinct_records(stream, ["process_index", "processed"]).select(records.columns)
        return rows(live.run_appended(plan, "dedup", root))

    write_progress(records.where("id < 25"), path)
    write_progress(records.where("id < 25"), path)
    assert run() == rows(records.where("id < 25"))
    write_progress(records.where("id >= 20"), path)
    assert run() == rows(records)


def test_records_with_their_spans(spark, tmp_path):
    path = str(tmp_path / "s.parquet")
    data = [(START + dt.timedelta(seconds=s), p, s) for p, times in ((1, (0, 5, 8, 60, 64)), (2, (3, 70)), (3, (400,))) for s in times]
    written_in_order(spark, path, data, LOG, 4)
    stream = live.event_time(live.stream_table(spark, path, spark.read.parquet(path).schema, 1), "ts", "10 seconds")
    found = live.run_appended(live.with_spans(stream, ["process_index"], "20 seconds", "1 hour"), "spans")
    seconds = lambda t: int((t - START).total_seconds())
    got = {(r.process_index, r.size): (seconds(r.started), seconds(r.ended)) for r in found.where("started IS NOT NULL").collect()}
    assert got == {(1, 0): (0, 8), (1, 5): (0, 8), (1, 8): (0, 8), (1, 60): (60, 64), (1, 64): (60, 64), (2, 3): (3, 3), (2, 70): (70, 70)}
