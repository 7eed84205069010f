"""The combined line per tick, against the published session of two processes and against plain loops."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from weftload.operators import combined as comb
from weftload.operators.blocks import rank_within, running_sum, with_blocks
from weftload.operators import blocks
from weftload.operators.monitor import merged_spans
from weftload.operators.ticks import BLOCK_TICKS, fill_ticks, tick_number, tick_time
from weftload.plans.workload import statements
from weftload.spec import WorkloadSpec

START = dt.datetime(2024, 5, 1, 12, 0, 0)
RECORDS = "process_index long, ts timestamp_ntz, processed long"
CONFIG = "process_index long, target string, load_type string"
STATUS = "ts timestamp_ntz, target string, variable string, value string"


def at(seconds):
    return START + dt.timedelta(seconds=seconds)


def test_two_processes_then_one(spark):
    """Both processes show 930 B; the second one ends, and 465 B are left."""
    records = spark.createDataFrame(
        [(1, at(s + 0.2), s) for s in range(10)] + [(2, at(s / 2 + 0.1), s) for s in range(9)], RECORDS
    )
    config = spark.createDataFrame([(1, "t", "insert"), (2, "t2", "insert")], CONFIG)
    reports = [(at(s), t, v, str(n)) for s in range(10) for t, docs in (("t", s), ("t2", min(2 * s, 10)))
               for v, n in (("disk_bytes", 465), ("indexed_documents", docs), ("disk_chunks", 0), ("optimizing", 0))]
    status = spark.createDataFrame(reports, STATUS)
    lines = comb.combined_per_tick(records, config, status, 1, 2)
    shown = comb.shown_line(lines).orderBy("tick").collect()
    assert [r.disk for r in shown] == ["930B"] * 5 + ["465B"] * 5
    assert [r.inserted for r in shown] == ["0", "3", "6", "9", "12", "5", "6", "7", "8", "9"]
    assert [r.elapsed for r in shown] == ["0ms", *[f"{s}.0s" for s in range(1, 10)]]
    assert {r.chunks for r in shown} == {"0"} and {r.merging for r in shown} == {""}


VARIABLES = {"disk_chunks": "disk_chunks", "optimizing": "is_optimizing", "disk_bytes": "disk_bytes", "indexed_documents": "indexed_documents"}


@pytest.fixture(scope="module")
def session(spark):
    rng = random.Random(3)
    targets = ["a", "b", "", "c"]
    config = [(p, targets[p % 4], rng.choice(["insert", "replace", "select", "insert"])) for p in range(1, 13)]
    records = []
    for p in range(1, 15):  # 13 and 14 are not configured
        t = rng.uniform(0, 300)
        for n in range(rng.randrange(1, 25)):
            t += rng.choice([1, 5, 20, 90]) * rng.random()
            records.append((p, at(round(t, 3)), n))
    status = [(at(round(rng.uniform(-50, 700), 3)), rng.choice(["a", "b", "zz"]),
               rng.choice([*VARIABLES, "killed_rate"]), rng.choice(["0", "1", "2", "17", "n/a"])) for _ in range(300)]
    return config, records, status


def loops(session, seconds, gap):
    config, records, status = session
    tick = lambda ts: int((ts - START).total_seconds() // seconds)
    spans = []
    for p in {r[0] for r in records}:
        times = sorted(r[1] for r in records if r[0] == p)
        begin = times[0]
        for one, two in zip(times, [*times[1:], None]):
            if two is None or (two - one).total_seconds() > gap:
                spans.append((p, tick(begin), tick(one)))
                begin = two
    first_target = next(t for _, t, _ in sorted(config) if t)
    out = {}
    ticks = [tick(r[1]) for r in records]
    for k in range(min(ticks), max(ticks) + 1):
        running = {p for p, a, b in spans if a <= k <= b}
        stats = []
        for p, target, load in config:
            if p not in running:
                continue
            now = {}
            for name in VARIABLES:
                seen = [(ts, int(v) if v != "n/a" else 0) for ts, t, n, v in status if t == (target or first_target) and n == name and tick(ts) <= k]
                now[VARIABLES[name]] = max(seen)[1] if seen else 0
            stats.append((target, load, now))
        writing = [s for _, load, s in stats if load in ("insert", "replace")]
        docs = {}
        for target, load, s in stats:
            if load == "insert":
                docs[target] = max(docs.get(target, 0), s["indexed_documents"])
        out[k] = (len(stats), sum(s["disk_chunks"] for s in writing), any(s["is_optimizing"] for _, _, s in stats),
                  sum(s["disk_bytes"] for s in writing), sum(docs.values()))
    return out


@pytest.mark.parametrize("seconds,gap", [(10, 30), (1, 15)])
def test_against_loops(spark, session, seconds, gap):
    config, records, status = session
    lines = comb.combined_per_tick(
        spark.createDataFrame(records, RECORDS).repartition(3), spark.createDataFrame(config, CONFIG),
        spark.createDataFrame(status, STATUS), seconds, gap,
    ).collect()
    wanted = loops(session, seconds, gap)
    found = {int((r.tick - START).total_seconds() // seconds): (r.processes, r.chunks, r.is_optimizing, r["size"], r.inserted) for r in lines}
    assert found == wanted and len(lines) == len(wanted)
    assert min(r.elapsed_s for r in lines) == 0


def test_processes_per_tick(spark, session):
    _, records, _ = session
    found = comb.processes_per_tick(spark.createDataFrame(records, RECORDS), ["processed"], ["ts", "processed"], 10, 30).collect()
    tick = lambda ts: int((ts - START).total_seconds() // 10)
    wanted = {}
    for p in {r[0] for r in records}:
        own = sorted((r[1], r[2]) for r in records if r[0] == p)
        for (ts, n), after in zip(own, [*own[1:], None]):
            goes_on = after is not None and (after[0] - ts).total_seconds() <= 30
            for k in range(tick(ts), tick(after[0]) if goes_on and tick(after[0]) > tick(ts) else tick(ts) + 1):
                wanted[p, k] = (n, k != tick(ts))
    assert {(r.process_index, tick(r.tick)): (r.processed, r.is_carried) for r in found} == wanted


def test_a_year_without_records_is_filled_in_blocks(spark):
    year = 365 * 86400
    events = spark.createDataFrame([(1, 5, 7), (1, 5 + year, 9), (2, 100, 1)], "k int, tick_no long, v long")
    filled = fill_ticks(events, ["k"], ["v"])
    found = filled.groupBy("k").agg(F.count("*").alias("n"), F.sum("v").alias("s"), F.count_if("is_carried").alias("c"), F.max("tick_no").alias("m"))
    assert {tuple(r) for r in found.collect()} == {(1, year + 1, 7 * year + 9, year - 1, year + 5), (2, 1, 1, 0, 100)}


def test_fill_ticks_columns_and_ends(spark):
    rng = random.Random(5)
    span = 3 * BLOCK_TICKS
    rows = {(k, rng.randrange(-span, span)): (rng.choice([None, rng.randrange(9)]), rng.choice([None, "x", "y"])) for k in (1, 2) for _ in range(40)}
    events = spark.createDataFrame([(k, n, a, b) for (k, n), (a, b) in rows.items()], "k int, tick_no long, a int, b string")
    end = span // 2
    found = {(r.k, r.tick_no): (r.a, r.b, r.is_carried) for r in fill_ticks(events, ["k"], ["a", "b"], F.lit(end)).collect()}
    wanted = {}
    for k in (1, 2):
        a = b = None
        for n in range(min(n for j, n in rows if j == k), end + 1):
            if (k, n) in rows:
                a, b = (new if new is not None else old for new, old in zip(rows[k, n], (a, b)))
            wanted[k, n] = (a, b, (k, n) not in rows)
    assert found == wanted
    assert fill_ticks(events.limit(0), ["k"], ["a"]).collect() == []


def test_tick_numbers_go_both_ways(spark):
    df = spark.createDataFrame([(at(0.5),), (dt.datetime(1969, 12, 31, 23, 59, 59),)], "ts timestamp_ntz")
    for kind in ("timestamp_ntz", "timestamp"):
        n = tick_number(F.col("ts").cast(kind), kind, 60)
        rows = df.select(tick_time(n, kind, 60).cast("timestamp_ntz").alias("t")).collect()
        assert [r.t for r in rows] == [START, dt.datetime(1969, 12, 31, 23, 59)]


def test_spans_are_merged(spark):
    spans = [(1, at(0), at(10)), (1, at(12), at(13)), (1, at(2), at(5)), (1, at(30), at(31)), (2, at(0), at(0))]
    df = spark.createDataFrame(spans, "p int, started timestamp_ntz, ended timestamp_ntz")
    found = {tuple(r) for r in merged_spans(df, ["p"], 2).collect()}
    assert found == {(1, at(0), at(13)), (1, at(30), at(31)), (2, at(0), at(0))}


IDS = {
    "dense": list(range(3000)),
    "far apart": [i * 1_000_003 for i in range(3000)],
    "clusters": list(range(2500)) + [10**15 + i * 10**12 for i in range(50)] + [5 * 10**17],
    "below zero": [i * i - 10**12 for i in range(2000)],
}


@pytest.mark.parametrize("name", IDS)
def test_ranks_and_sums_for_any_ids(spark, name, monkeypatch):
    monkeypatch.setattr(blocks, "TREE_ROWS", 16)  # blocks of blocks of blocks
    rng = random.Random(1)
    data = [(rng.randrange(2) * rng.randrange(2), i, rng.randrange(9)) for i in IDS[name]]
    rng.shuffle(data)
    df = spark.createDataFrame(data, "k int, i long, v long")
    held = [r["count"] for r in with_blocks(df, "i", 32)[0].groupBy("_block").count().collect()]
    assert max(held) <= 64 and len(held) <= 4 * len(data) / 32
    rank, total, wanted = {}, {}, {}
    for k, i, v in sorted(data, key=lambda r: r[1]):
        rank[k], total[k] = rank.get(k, -1) + 1, total.get(k, 0) + v
        wanted[i] = (rank[k], total[k])
    sums = {r.i: r.s for r in running_sum(df, ["k"], "i", "v", "s", 32).collect()}
    ranks = {r.i: r["rank"] for r in rank_within(df, ["k"], "i", "rank", 32).collect()}
    assert {i: (ranks[i], sums[i]) for i in ranks} == wanted


def test_batches_of_ids_with_gaps(spark):
    spec = WorkloadSpec.of("insert into t(id) values(<increment>)", total=4, batch_size=3)
    rows = spark.createDataFrame([(i,) for i in (96, 0, 64, 32)], "row_id long")
    found = statements(spark, spec, rows).orderBy("pos").collect()
    assert [(r.pos, r.n_rows, r.stmt) for r in found] == [
        (64, 3, "insert into t(id) values(1),(2),(3);"), (97, 1, "insert into t(id) values(4);")
    ]
