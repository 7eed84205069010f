"""Progress and status, against plain loops; change logs; keyword matching."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from weftload.operators import monitor as mon
from weftload.operators import replay as rep
from weftload.operators import match
from weftload.operators.match import bulk_match, in_parts, joined_in_parts, match_counts, part_counts
from weftload.functions import formats as fmt
from weftload.plans.workload import statements
from weftload.spec import WorkloadSpec

START = dt.datetime(2024, 5, 1, 12, 0, 0)


def at(seconds):
    return START + dt.timedelta(seconds=seconds)


STATUS_SCHEMA = "target string, disk_chunks long, is_optimizing long, disk_bytes long, ram_bytes long, indexed_documents long"


def test_two_processes_then_one(spark):
    """465 B + 465 B on two tables; when one process ends, 465 B are left."""
    status = spark.createDataFrame([("t", 1, 0, 465, 1, 6), ("t2", 1, 1, 465, 1, 6)], STATUS_SCHEMA)
    config = spark.createDataFrame(
        [(1, "t", "insert"), (2, "t2", "insert")], "process_index int, target string, load_type string"
    )
    records = spark.createDataFrame([(1, 5), (2, 6)], "process_index int, processed long")

    def line(known):
        stats = mon.with_status(mon.with_config(known, config), config, status)
        return mon.combined_status(stats).first(), mon.inserted_docs(stats).first()

    both, docs = line(records)
    assert (both["size"], both.chunks, both.is_optimizing, docs.inserted) == (930, 2, True, 12)
    left, docs = line(records.where("process_index = 1"))
    assert (left["size"], left.is_optimizing, docs.inserted) == (465, False, 6)


def test_documents_per_table_not_per_process(spark):
    stats = spark.createDataFrame(
        [("t", "insert", 10), ("t", "insert", 12), ("u", "insert", 5), ("u", "replace", 99), ("v", "select", 7)],
        "target string, load_type string, indexed_documents long",
    )
    assert mon.inserted_docs(stats).first().inserted == 17


def test_status_falls_back_to_the_first_table(spark):
    status = spark.createDataFrame([("a", 1, 0, 10, 0, 3), ("b", 2, 0, 20, 0, 4)], STATUS_SCHEMA)
    config = spark.createDataFrame(
        [(3, "a", "select"), (1, "", "other"), (2, "b", "insert"), (4, "zzz", "insert")],
        "process_index int, target string, load_type string",
    )
    records = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 9)], "process_index int")
    found = mon.with_status(mon.with_config(records, config), config, status).collect()
    assert {r.process_index: r.disk_bytes for r in found} == {1: 20, 2: 20, 3: 10, 4: 20}
    assert sorted(r.target for r in mon.watched_tables(config).collect()) == ["a", "b", "zzz"]


def test_snapshot_defaults(spark):
    rows = [(START, "t", "disk_bytes", "12"), (START, "t", "optimizing", "x"), (START, "u", "other", "5")]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, target string, variable string, value string")
    found = {r.target: r for r in mon.status_snapshot(df).collect()}
    assert (found["t"].disk_bytes, found["t"].is_optimizing, found["t"].ram_bytes) == (12, 0, 0)
    assert found["u"].indexed_documents == 0


@pytest.fixture(scope="module")
def records(spark):
    """One process writes most of the records."""
    rng = random.Random(7)
    data = []
    for i in range(1500):
        process = 1 if rng.random() < 0.7 else rng.randrange(2, 6)
        second = round(rng.uniform(0, 2000) ** 1.2, 3)
        data.append((process, at(second), i))
    df = spark.createDataFrame(data, "process_index int, ts timestamp_ntz, processed long")
    return data, df.repartition(5)


def test_newest_and_deltas(records):
    data, df = records
    per_tick = mon.newest_per_tick(df, ["process_index"], 60, ["ts", "processed"])
    best = {}
    for p, ts, n in data:
        key = (p, int((ts - START).total_seconds() // 60))
        best[key] = max(best.get(key, (ts, n)), (ts, n))
    found = mon.deltas(per_tick, ["process_index"]).collect()
    assert len(found) == len(best)
    for row in found:
        key = (row.process_index, int((row.ts - START).total_seconds() // 60))
        assert best[key] == (row.ts, row.processed)
        before = [k for k in best if k[0] == key[0] and k[1] < key[1]]
        if before:
            last = best[max(before)]
            assert row.dn == row.processed - last[1]
            assert row.dt == pytest.approx((row.ts - last[0]).total_seconds())
        else:
            assert row.dn is None and row.dt is None


def test_newest_by_one_column(records):
    data, df = records
    found = mon.newest(df, ["process_index"], ["processed"])
    best = {}
    for p, ts, n in data:
        best[p] = max(best.get(p, (n, ts)), (n, ts))
    assert {r.process_index: (r.processed, r.ts) for r in found.collect()} == best


def test_carry_forward(records):
    data, df = records
    per_tick = mon.newest_per_tick(df, ["process_index"], 60, ["ts", "processed"])
    last = per_tick.agg(F.max("tick")).scalar()
    found = mon.carry_forward(per_tick, ["process_index"], 60, last).collect()
    end = max(int((ts - START).total_seconds() // 60) for _, ts, _ in data)
    for process in {p for p, _, _ in data}:
        mine = sorted((r.tick, r.processed, r.is_carried) for r in found if r.process_index == process)
        own = [(ts, n) for p, ts, n in data if p == process]
        first = min(int((ts - START).total_seconds() // 60) for ts, _ in own)
        assert len(mine) == end - first + 1
        for tick, processed, carried in mine:
            known = [r for r in own if r[0] < tick + dt.timedelta(seconds=60)]
            assert processed == max(known)[1]
            assert carried == (not any(ts >= tick for ts, _ in known))


@pytest.mark.parametrize("seconds", [5, 60])
def test_size_window(records, seconds):
    """Frames that cross block borders are whole."""
    data, df = records
    found = mon.size_window(df, ["process_index"], "processed", seconds).collect()
    assert len(found) == len({(p, ts) for p, ts, _ in data})
    for row in found:
        recent = [
            (ts, n) for p, ts, n in data
            if p == row.process_index and row.ts - dt.timedelta(seconds=seconds) <= ts <= row.ts
        ]
        values = [n for _, n in recent]
        assert (row.n, row.size_min, row.size_max) == (len(values), min(values), max(values))
        oldest = min(ts for ts, _ in recent)
        assert row.growth == max(n for ts, n in recent if ts == row.ts) - min(
            n for ts, n in recent if ts == oldest
        )


def test_size_window_borders(spark):
    """A sample exactly as old as the frame still counts; peers are merged."""
    data = [("t", at(s), v) for s, v in ((0, 5), (5, 7), (5, 1), (10, 2), (10.5, 9), (16, 4))]
    df = spark.createDataFrame(data, "k string, ts timestamp_ntz, v long")
    found = mon.size_window(df, ["k"], "v").orderBy("ts").collect()
    assert [(r.n, r.size_min, r.size_max, r.growth) for r in found] == [
        (1, 5, 5, 0), (3, 1, 7, 2), (3, 1, 7, 1), (2, 2, 9, 7), (1, 4, 4, 0),
    ]


@pytest.mark.parametrize("gap", [1, 10, 300])
def test_active_spans(records, gap):
    data, df = records
    found = mon.active_spans(df, ["process_index"], gap).collect()
    expected = []
    for process in {p for p, _, _ in data}:
        times = sorted(ts for p, ts, _ in data if p == process)
        span = [times[0]]
        for ts in times[1:]:
            if (ts - span[-1]).total_seconds() > gap:
                expected.append((process, span[0], span[-1], len(span)))
                span = []
            span.append(ts)
        expected.append((process, span[0], span[-1], len(span)))
    assert sorted((r.process_index, r.started, r.ended, r.n) for r in found) == sorted(expected)


def test_counter_usage(spark):
    rows = [("h", at(0), [10, 0, 0, 90]), ("h", at(1), [30, 0, 0, 170]), ("h", at(1.05), [40, 0, 0, 175]),
            ("h", at(2), [40, 0, 0, 175]), ("h", at(3), [50, 5, 0, 190]), ("g", at(0), [1, 1, 1, 1])]
    df = spark.createDataFrame(rows, "host string, ts timestamp_ntz, counters array<long>")
    found = {(r.host, r.ts): r.usage for r in mon.counter_usage(df).collect()}
    assert [found["h", at(s)] for s in (0, 1, 1.05, 2, 3)] == [None, 20, None, None, 50]
    assert found["g", at(0)] is None


def test_replay_against_a_loop(spark):
    rng = random.Random(2)
    log = []
    for pos in range(3000):
        key = 0 if rng.random() < 0.4 else rng.randrange(1, 200)
        log.append((pos, rng.choice(["insert", "replace", "update"]), key, float(pos % 97)))
    df = spark.createDataFrame(log, "pos long, op string, id long, a double").repartition(6)

    def run(kinds):
        table = {}
        for _, op, key, a in log:
            if op not in kinds:
                continue
            if op == "replace" or (op == "insert" and key not in table) or (op == "update" and key in table):
                table[key] = a
        return table

    def state(found):
        return {r.id: r.a for r in found.collect()}

    assert state(rep.replay_inserts(df)) == run({"insert"})
    assert state(rep.replay_keyed(df)) == run({"insert", "update"})
    assert state(rep.replay(df)) == run({"insert", "replace", "update"})
    upserts = {key: a for _, op, key, a in log if op in ("insert", "replace")}
    assert state(rep.replay_upserts(df)) == upserts


@pytest.mark.parametrize("most", [2, 1 << 16])
def test_match_against_all_pairs(spark, most):
    """With two rows a part, nearly every word and query is split."""
    rng = random.Random(9)
    words = [f"w{i}" for i in range(25)]
    docs = [(i, ", ".join(["Common"] * (i % 3 > 0) + rng.choices(words, k=12))) for i in range(120)]
    queries = [(i, " ".join(rng.choices(words + ["common"], k=rng.randrange(1, 4)))) for i in range(60)]
    queries += [(100 + i, "common") for i in range(30)] + [(200, ""), (201, "absent"), (202, "COMMON; absent")]
    expected = set()
    for q, text in queries:
        need = set(text.lower().replace(";", " ").split())
        if need:
            expected |= {(q, d) for d, t in docs if need <= set(t.lower().split(", "))}
    docs_df = spark.createDataFrame(docs, "doc_id long, text string")
    queries_df = spark.createDataFrame(queries, "query_id long, text string")
    found = bulk_match(docs_df, queries_df, most=most).collect()
    assert len(found) == len(expected)
    assert {(r.query_id, r.doc_id) for r in found} == expected
    counts = {r.query_id: r.n_docs for r in match_counts(docs_df, queries_df, most=most).collect()}
    assert counts == {q: sum(1 for e in expected if e[0] == q) for q, t in queries if t}


def test_a_word_in_every_text_is_split(spark):
    """One word stands in all texts, others in few: parts of it are no larger than what others have."""
    postings = spark.range(20_000).select(F.lit("the").alias("token"), F.col("id").alias("doc_id")).unionByName(
        spark.range(20_000).select(F.concat(F.lit("w"), F.col("id") % 40).alias("token"), F.col("id").alias("doc_id"))
    )
    parts = part_counts(postings, "token", 500)
    assert [(r.token, r["_parts"]) for r in parts.collect() if r.token == "the"] == [("the", 41)]
    placed = in_parts(postings, "token", "doc_id", parts)
    held = [r["count"] for r in placed.groupBy("token", "_part").count().collect()]
    assert max(held) <= 2 * sorted(held)[len(held) // 2]
    asked = spark.createDataFrame([("the", 1), ("w3", 1), ("none", 2)], "token string, set long")
    joined = joined_in_parts(postings, asked, "token", "doc_id", 500)
    assert joined.count() == 20_500 and joined.columns == ["token", "doc_id", "set"]
    left = joined_in_parts(asked, postings.groupBy("token").count(), "token", "set", 500, "left")
    assert {(r.token, r["count"]) for r in left.collect()} == {("the", 20_000), ("w3", 500), ("none", None)}


def test_texts_are_read_once(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"the w{i % 7} x{i}") for i in range(100)], "doc_id long, text string")
    queries = spark.createDataFrame([(1, "the"), (2, "w3 the"), (3, "w3 nowhere"), (4, "")], "query_id long, text string")
    reads = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            reads.add(batch.num_rows)
            yield batch

    once = docs.repartition(3).mapInArrow(counted, docs.schema)
    found = {(r.query_id, r.doc_id) for r in bulk_match(once, queries).collect()}
    assert found == {(1, i) for i in range(100)} | {(2, i) for i in range(100) if i % 7 == 3}
    assert reads.value == 100


def test_pairs_that_share_only_the_rarest_word_are_not_kept(spark, monkeypatch):
    kept = {}
    write = match.written_table

    def written(df, label):
        kept[label] = write(df, label)
        return kept[label]

    monkeypatch.setattr(match, "written_table", written)
    docs = spark.createDataFrame([(i, f"rare b{i % 50} c{i % 50}") for i in range(400)], "doc_id long, text string")
    docs = docs.unionByName(spark.range(1000, 3000).selectExpr("id AS doc_id", "concat('b', id % 50, ' c', (id + 1) % 50) AS text"))
    queries = spark.createDataFrame([(i, f"rare b{i} c{(i + 1) % 50}") for i in range(50)], "query_id long, text string")
    assert bulk_match(docs, queries).count() == 0
    assert kept["candidates"].count() < 400


def test_pairs_are_written_only_as_matches(spark, monkeypatch):
    """With one long of bits nearly every pair passes them; what is written are the matches, and one row for each text."""
    kept = {}
    write = match.written_table

    def written(df, label):
        kept[label] = write(df, label)
        return kept[label]

    monkeypatch.setattr(match, "written_table", written)
    monkeypatch.setattr(match, "BIT_LONGS", 1)
    rng = random.Random(4)
    docs = [(i, "rare " + " ".join(rng.sample([f"b{k}" for k in range(200)], 90))) for i in range(60)]
    queries = [(i, "rare " + " ".join(rng.sample([f"b{k}" for k in range(200)], 3))) for i in range(80)]
    expected = {(q, d) for q, asked in queries for d, t in docs if set(asked.split()) <= set(t.split())}
    frames = (spark.createDataFrame(x, schema) for x, schema in ((docs, "doc_id long, text string"), (queries, "query_id long, text string")))
    found = bulk_match(*frames).collect()
    assert len(found) == len(expected) and {(r.query_id, r.doc_id) for r in found} == expected
    assert kept["candidates"].count() == len(expected)
    assert kept["held"].count() == len(docs) and "index" not in kept


def test_figures_as_text(spark):
    def shown(function, *values):
        df = spark.createDataFrame([(float(v),) for v in values], "v double")
        return [r[0] for r in df.select(function(F.col("v"))).collect()]

    assert shown(fmt.elapsed, 0.2504, 12.34, 59.9, 60, 3725) == ["250ms", "12.3s", "59.9s", "01:00", "62:05"]
    assert shown(fmt.mmss, 0, 59.9, 6000) == ["00:00", "00:59", "100:00"]
    assert shown(fmt.byte_size, 465, -2048, 5 * 2**20, 1.5 * 2**30) == ["465B", "-2KB", "5MB", "1.50GB"]
    assert shown(fmt.rate_text, 999.4, 1540) == ["999", "1.5K"]
    counts = spark.createDataFrame([(7,), (1200,), (3_400_000,), (2_000_000_000,)], "v long")
    assert [r[0] for r in counts.select(fmt.short_count(F.col("v"))).collect()] == ["7", "1.2K", "3.4M", "2.0B"]


def test_newest_status_forgets_old_values(spark):
    rows = [
        (1, "t", "optimizing", "1"), (2, "t", "optimizing", "0"),
        (1, "t", "disk_chunks", "9"), (2, "t", "disk_chunks", "3"), (2, "t", "disk_chunks", "2"),
        (1, "t", "ram_bytes", "5"), (2, "t", "ram_bytes", "n/a"),
    ]
    df = spark.createDataFrame(rows, "ts int, target string, variable string, value string")
    (row,) = mon.newest_status(df).collect()
    assert (row.disk_chunks, row.is_optimizing, row.ram_bytes, row.disk_bytes) == (3, 0, 0, 0)


def test_statements_are_read_back(spark):
    stmts = [
        "insert into t values(1, 7),(2, 4);",
        "INSERT INTO t(name, `a`, id) VALUES ('x), (9, 9', 5, 3), ('it''s \\\\ \\' (b', 6, 4)",
        "insert into t(id, v, a) values (5, (0.1, 0.2), 1), (6, [1,2], 2)",
        "insert into other values (7, 7)",
        "update t set a = 25 where id = 1",
        "UPDATE t SET name = ' where id = 2, a = 9', a = 30 WHERE ID=2;",
        "update t set a = 99 where a = 5",
        "update t set name = 'b' where id = 3",
        "update t set a = 24 where id = 50",
        "replace into t values (4, 40)",
        "select * from t where id = 1",
        "insert into t values (1, 0)",
    ]
    df = spark.createDataFrame(list(enumerate(stmts)), "pos long, stmt string").repartition(3)
    found = [tuple(r) for r in rep.replay_statements(df, "t").collect()]
    assert found == [(1, 25.0), (2, 30.0), (3, 5.0), (4, 40.0), (5, 1.0), (6, 2.0)]
    names = rep.read_changes(df, ["id", "name"]).where("op = 'insert' AND target = 't' AND pos.pos = 1").orderBy("pos")
    assert [(r.id, r.name) for r in names.collect()] == [("3", "x), (9, 9"), ("4", "it's \\ ' (b")]


def test_generated_statements_replay_to_the_rows_they_hold(spark):
    """A mix of batched inserts and updates, written as text; a third of the rows or so are inserts."""
    spec = WorkloadSpec.of(
        ["insert into t values(<increment>, <int/1/10>)", "update t set a = <int/20/30> where id = <int/1/7>"],
        100, weights="0.3,0.7", batch_size=5,
    )
    stmts = statements(spark, spec).select("pos", "stmt", "template_idx", "n_rows")
    inserted = stmts.where("template_idx = 0").agg(F.sum("n_rows")).first()[0]
    found = rep.replay_statements(stmts, "t").collect()
    assert [r.id for r in found] == list(range(1, inserted + 1))
    assert all(1 <= r.a <= 10 for r in found if r.id > 7)
    big = "insert into t values" + ",".join(f"({i}, '{'x(' * 500}')" for i in range(2000))
    rows = rep.read_changes(spark.createDataFrame([(1, big)], "pos long, stmt string"), ["id", "a"])
    assert rows.count() == 2000 and rows.agg(F.min(F.length("a"))).first()[0] == 1000
