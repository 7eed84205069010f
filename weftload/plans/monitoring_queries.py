"""Registered queries: progress records, table status, counters, change logs, matching."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftload.operators import combined as comb
from weftload.operators import monitor as mon
from weftload.operators import replay as rep
from weftload.operators.batching import joined_tuples
from weftload.operators.match import bulk_match, match_counts
from weftload.operators.throughput import tick_start
from weftload.plans.inputs import (
    CHANGES,
    CONFIG,
    LIVE_STATUS,
    PROGRESS,
    SIZES,
    STATUS,
    USER_PROGRESS,
    WRITES,
    read,
    select,
    sql,
)
from weftload.plans.registry import query
from weftload.session import shared_dir
from weftload.sources.files import read_progress, write_progress

HOUR, DAY = 3600, 86400
CONFIG_ROWS, STATUS_ROWS = sql(CONFIG), sql(STATUS)
PROGRESS_ROWS, USER_ROWS = sql(PROGRESS), sql(USER_PROGRESS)
CHANGE_ROWS, SIZE_ROWS = sql(CHANGES), sql(SIZES)
STATUS_NAMES = list(mon.STATUS_VARIABLES.values())


def _pivot(keys: str) -> str:
    columns = ", ".join(
        f"coalesce(max(try_cast(value AS BIGINT)) FILTER (WHERE variable = '{v}'), 0) AS {n}"
        for v, n in mon.STATUS_VARIABLES.items()
    )
    return f"SELECT {keys}, {columns} FROM {STATUS_ROWS} GROUP BY {keys}"


@query("status_pivot", _pivot("ts, target"))
def status_pivot(spark, folder):
    return mon.status_snapshot(select(spark, folder, STATUS))


@query("session_count", f"SELECT ts, count(*) AS sessions FROM {STATUS_ROWS} GROUP BY ts")
def session_count(spark, folder):
    return mon.session_count(select(spark, folder, STATUS))


def newest_progress(spark, folder, source=USER_PROGRESS) -> DataFrame:
    return mon.newest(select(spark, folder, source), ["process_index"], ["processed"])


def _newest(rows: str) -> str:
    return (
        "SELECT process_index, ts, processed, qps FROM (SELECT *, row_number() OVER "
        f"(PARTITION BY process_index ORDER BY processed DESC) AS rn FROM {rows}) WHERE rn = 1"
    )


@query("progress_last", _newest(PROGRESS_ROWS))
def progress_last(spark, folder):
    return newest_progress(spark, folder, PROGRESS)


@query(
    "progress_files",
    f"SELECT CAST(process_index AS INT) AS process_index, ts, processed, CAST(qps AS STRING) AS qps FROM {PROGRESS_ROWS}",
)
def progress_files(spark, folder):
    """Records written as JSON lines per process and read back with a fixed schema."""
    records = select(spark, folder, PROGRESS).select(
        F.col("ts").cast("timestamp").alias("ts"), "process_index", "processed",
        F.col("qps").cast("string").alias("qps"),
    )
    path = shared_dir(spark, "progress")
    write_progress(records, path)
    return read_progress(spark, path).select(
        F.col("ts").cast("timestamp_ntz").alias("ts"), "process_index", "processed", "qps"
    )


NEWEST_PER_HOUR = (
    "(SELECT process_index, tick, ts, processed, qps FROM (SELECT *, row_number() OVER "
    "(PARTITION BY process_index, tick ORDER BY processed DESC) AS rn FROM "
    f"(SELECT *, date_trunc('hour', ts) AS tick FROM {PROGRESS_ROWS})) WHERE rn = 1)"
)


def per_hour(spark, folder) -> DataFrame:
    return mon.newest_per_tick(
        select(spark, folder, PROGRESS), ["process_index"], HOUR, ["processed"]
    )


@query(
    "progress_delta",
    f"""SELECT process_index, tick, processed,
 date_diff('microsecond', lag(ts) OVER w, ts) / 1000000 AS dt, processed - lag(processed) OVER w AS dn
 FROM {NEWEST_PER_HOUR} WINDOW w AS (PARTITION BY process_index ORDER BY tick)""",
)
def progress_delta(spark, folder):
    found = mon.deltas(per_hour(spark, folder), ["process_index"])
    return found.select("process_index", "tick", "processed", "dt", "dn")


@query(
    "progress_locf",
    f"""WITH r AS {NEWEST_PER_HOUR},
s AS (SELECT process_index, unnest(generate_series(min(tick), (SELECT max(tick) FROM r), INTERVAL 1 HOUR)) AS tick
  FROM r GROUP BY process_index),
j AS (SELECT s.process_index, s.tick, r.processed, r.qps FROM s LEFT JOIN r
  ON s.process_index = r.process_index AND s.tick = r.tick)
SELECT process_index, tick,
  last_value(processed IGNORE NULLS) OVER w AS processed, last_value(qps IGNORE NULLS) OVER w AS qps,
  processed IS NULL AS is_carried
FROM j WINDOW w AS (PARTITION BY process_index ORDER BY tick ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
)
def progress_locf(spark, folder):
    ticks = per_hour(spark, folder)
    last = ticks.agg(F.max("tick")).scalar()
    return mon.carry_forward(ticks, ["process_index"], HOUR, last).drop("ts")


@query(
    "counter_rate",
    """WITH h AS (SELECT CAST(user_id % 2 AS STRING) AS host, date_trunc('hour', ts) AS ts,
  count(*) FILTER (WHERE event_type = 'signup') AS a, count(*) FILTER (WHERE event_type = 'purchase') AS b,
  count(*) FILTER (WHERE event_type = 'click') AS c, count(*) FILTER (WHERE event_type IN ('view', 'error')) AS d
  FROM events GROUP BY ALL),
w AS (SELECT host, ts, ts - lag(ts) OVER (PARTITION BY host ORDER BY ts) AS dt, a + b + c + d AS total, d AS idle FROM h)
SELECT host, ts, CASE WHEN dt IS NOT NULL AND total <> 0
  THEN CAST(round(round((1 - idle / total) * 100, 1)) AS BIGINT) END AS usage FROM w""",
)
def counter_rate(spark, folder):
    """Counters grow by the number of events of a kind; views and errors count as idle."""
    kinds = [["signup"], ["purchase"], ["click"], ["view", "error"]]
    hourly = (
        read(spark, folder, "events")
        .groupBy(
            (F.col("user_id") % 2).cast("string").alias("host"),
            tick_start(F.col("ts"), HOUR).alias("ts"),
        )
        .agg(*[F.count_if(F.col("event_type").isin(k)).alias(f"n{i}") for i, k in enumerate(kinds)])
    )
    # Bounded by hours, not by events.
    so_far = Window.partitionBy("host").orderBy("ts").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    counters = hourly.select(
        "host", "ts", F.array(*[F.sum(f"n{i}").over(so_far) for i in range(4)]).alias("counters")
    )
    return mon.counter_usage(counters)


@query(
    "size_window",
    f"""WITH m AS (SELECT target, ts, count(*) AS k, min(disk_bytes) AS lo, max(disk_bytes) AS hi FROM {SIZE_ROWS} GROUP BY ALL)
SELECT target, ts, CAST(sum(k) OVER w AS BIGINT) AS n, min(lo) OVER w AS size_min, max(hi) OVER w AS size_max,
  hi - first_value(lo) OVER w AS growth FROM m
WINDOW w AS (PARTITION BY target ORDER BY ts RANGE BETWEEN INTERVAL 5 DAYS PRECEDING AND CURRENT ROW)""",
)
def size_window(spark, folder):
    """Samples are days apart here, so the window is five days."""
    return mon.size_window(select(spark, folder, SIZES), ["target"], "disk_bytes", 5 * DAY)


@query(
    "proc_config_join",
    f"SELECT p.ts, p.processed, c.* FROM {USER_ROWS} p JOIN {CONFIG_ROWS} c USING (process_index)",
)
def proc_config_join(spark, folder):
    records = select(spark, folder, USER_PROGRESS).select("process_index", "ts", "processed")
    return mon.with_config(records, select(spark, folder, CONFIG))


@query("watched_tables", f"SELECT DISTINCT target FROM {CONFIG_ROWS} WHERE target <> ''")
def watched_tables(spark, folder):
    return mon.watched_tables(select(spark, folder, CONFIG))


NEWEST_STATUS = f"""SELECT target, {', '.join(f"coalesce(max(v) FILTER (WHERE variable = '{v}'), 0) AS {n}" for v, n in mon.STATUS_VARIABLES.items())}
 FROM (SELECT target, variable, try_cast(value AS BIGINT) AS v, row_number() OVER (PARTITION BY target, variable
  ORDER BY ts DESC, try_cast(value AS BIGINT) DESC NULLS LAST) AS rn FROM {STATUS_ROWS}) WHERE rn = 1 GROUP BY target"""

STATS = f"""(WITH c AS (SELECT * FROM {CONFIG_ROWS}), s AS ({NEWEST_STATUS}),
f AS (SELECT * FROM s WHERE target = (SELECT arg_min(target, process_index) FROM c WHERE target <> ''))
SELECT r.process_index, r.processed, c.target, c.load_type,
 {', '.join(f'CASE WHEN s.target IS NULL THEN f.{n} ELSE s.{n} END AS {n}' for n in STATUS_NAMES)}
FROM ({_newest(USER_ROWS)}) r JOIN c USING (process_index) LEFT JOIN s ON c.target = s.target LEFT JOIN f ON true)"""


def stats(spark, folder) -> DataFrame:
    config = select(spark, folder, CONFIG)
    records = mon.with_config(
        newest_progress(spark, folder).select("process_index", "processed"),
        config.select("process_index", "target", "load_type"),
    )
    status = mon.newest_status(select(spark, folder, STATUS))
    return mon.with_status(records, config, status)


@query("progress_status_join", f"SELECT * FROM {STATS}")
def progress_status_join(spark, folder):
    return stats(spark, folder)


@query(
    "inserted_docs",
    f"""SELECT CAST(sum(d) AS BIGINT) AS inserted FROM (SELECT target, max(indexed_documents) AS d
 FROM {STATS} WHERE load_type = 'insert' GROUP BY target)""",
)
def inserted_docs(spark, folder):
    return mon.inserted_docs(stats(spark, folder))


COMBINED = f"""SELECT CAST(sum(CASE WHEN load_type IN ('insert', 'replace') THEN disk_chunks ELSE 0 END) AS BIGINT) AS chunks,
 CAST(sum(CASE WHEN load_type IN ('insert', 'replace') THEN disk_bytes ELSE 0 END) AS BIGINT) AS size,
 bool_or(is_optimizing > 0) AS is_optimizing, count(*) AS processes FROM {STATS}"""


@query("combined_status", COMBINED)
def combined_status(spark, folder):
    return mon.combined_status(stats(spark, folder))


SPANS = """SELECT process_index, CAST(span_no AS BIGINT) AS span_no, min(ts) AS started, max(ts) AS ended, count(*) AS n FROM (
 SELECT *, sum(opens) OVER (PARTITION BY process_index ORDER BY ts, processed ROWS UNBOUNDED PRECEDING) AS span_no FROM (
  SELECT *, CASE WHEN date_diff('microsecond', lag(ts) OVER (PARTITION BY process_index ORDER BY ts, processed), ts)
   <= {gap}000000 THEN 0 ELSE 1 END AS opens FROM {rows})) GROUP BY process_index, span_no"""


@query("process_sessions", SPANS.format(gap=12 * HOUR, rows=USER_ROWS))
def process_sessions(spark, folder):
    return mon.active_spans(select(spark, folder, USER_PROGRESS), ["process_index"], 12 * HOUR)


LIVE_GAP = 12 * HOUR
LIVE_STATUS_ROWS = sql(LIVE_STATUS)
USER_SPANS = SPANS.format(gap=LIVE_GAP, rows=USER_ROWS)


def _as_of(ticks: str) -> str:
    """Status of each table as of each tick: the newest value of each variable, 0 before the first."""
    columns = ", ".join(
        f"coalesce(max(v) FILTER (WHERE variable = '{v}'), 0) AS {n}" for v, n in mon.STATUS_VARIABLES.items()
    )
    return f"""SELECT target, tick, {columns} FROM (SELECT t.target, t.tick, r.variable, r.v, row_number() OVER (
 PARTITION BY t.target, t.tick, r.variable ORDER BY r.ts DESC, r.v DESC) AS rn
 FROM {ticks} t LEFT JOIN reports r ON r.target = t.target AND r.ts < t.tick + INTERVAL 1 HOUR)
 WHERE rn = 1 GROUP BY target, tick"""


# Every running process of every tick is spelled out here, with its table's status at that tick.
COMBINED_PER_TICK = f"""WITH c AS (SELECT * FROM {CONFIG_ROWS}), r AS (SELECT * FROM {USER_ROWS}),
reports AS (SELECT target, variable, ts, coalesce(try_cast(value AS BIGINT), 0) AS v FROM {LIVE_STATUS_ROWS}),
polls AS (SELECT ts, count(*) AS sessions FROM {LIVE_STATUS_ROWS} GROUP BY ts),
spans AS ({USER_SPANS}),
ticks AS (SELECT unnest(generate_series(date_trunc('hour', min(ts)), date_trunc('hour', max(ts)), INTERVAL 1 HOUR)) AS tick FROM r),
first AS (SELECT arg_min(target, process_index) AS target FROM c WHERE target <> ''),
tables AS (SELECT DISTINCT CASE WHEN c.target = '' THEN first.target ELSE c.target END AS target FROM c, first),
status AS ({_as_of("(SELECT target, tick FROM tables, ticks)")}),
shown AS (SELECT t.tick, c.target, c.load_type, s.* EXCLUDE (target, tick)
 FROM ticks t JOIN spans p ON date_trunc('hour', p.started) <= t.tick AND t.tick <= p.ended
 JOIN c ON c.process_index = p.process_index CROSS JOIN first
 JOIN status s ON s.tick = t.tick AND s.target = CASE WHEN c.target = '' THEN first.target ELSE c.target END),
docs AS (SELECT tick, CAST(sum(d) AS BIGINT) AS inserted FROM (SELECT tick, target, max(indexed_documents) AS d
 FROM shown WHERE load_type = 'insert' GROUP BY tick, target) GROUP BY tick)
SELECT t.tick, date_diff('second', min(t.tick) OVER (), t.tick) AS elapsed_s, l.processes, l.chunks, l.is_optimizing,
 l.size, coalesce(docs.inserted, 0) AS inserted,
 (SELECT arg_max(sessions, ts) FROM polls WHERE polls.ts < t.tick + INTERVAL 1 HOUR) AS workers
FROM ticks t JOIN (SELECT t.tick, count(s.tick) AS processes,
  CAST(coalesce(sum(disk_chunks) FILTER (WHERE load_type IN ('insert', 'replace')), 0) AS BIGINT) AS chunks,
  coalesce(bool_or(is_optimizing > 0), false) AS is_optimizing,
  CAST(coalesce(sum(disk_bytes) FILTER (WHERE load_type IN ('insert', 'replace')), 0) AS BIGINT) AS size
  FROM ticks t LEFT JOIN shown s ON s.tick = t.tick GROUP BY t.tick) l ON l.tick = t.tick
LEFT JOIN docs ON docs.tick = t.tick"""


@query("combined_per_tick", COMBINED_PER_TICK)
def combined_per_tick(spark, folder):
    """A line per hour. Who runs, what the tables report and how many sessions there are, all as of the hour."""
    status = select(spark, folder, LIVE_STATUS)
    workers = mon.session_count(status).withColumnRenamed("sessions", "workers")
    return comb.combined_per_tick(
        select(spark, folder, USER_PROGRESS), select(spark, folder, CONFIG), status, HOUR, LIVE_GAP,
        {"workers": workers},
    )


@query(
    "process_per_tick",
    f"""WITH r AS (SELECT * FROM {USER_ROWS}), spans AS ({USER_SPANS}),
ticks AS (SELECT unnest(generate_series(date_trunc('hour', min(ts)), date_trunc('hour', max(ts)), INTERVAL 1 HOUR)) AS tick FROM r)
SELECT process_index, tick, arg_max(processed, processed) AS processed, arg_max(qps, processed) AS qps,
 max(own_tick) < tick AS is_carried FROM (
  SELECT p.process_index, t.tick, r.processed, r.qps, date_trunc('hour', r.ts) AS own_tick,
   rank() OVER (PARTITION BY p.process_index, t.tick ORDER BY date_trunc('hour', r.ts) DESC) AS rk
  FROM ticks t JOIN spans p ON date_trunc('hour', p.started) <= t.tick AND t.tick <= p.ended
  JOIN r ON r.process_index = p.process_index AND date_trunc('hour', r.ts) <= t.tick) WHERE rk = 1
GROUP BY process_index, tick""",
)
def process_per_tick(spark, folder):
    """The newest record of every running process as of each hour; it leaves after its last one."""
    return comb.processes_per_tick(
        select(spark, folder, USER_PROGRESS), ["processed", "qps"], ["processed"], HOUR, LIVE_GAP
    )


# ---------------------------------------------------------------- change logs

FIRST_INSERT = (
    "(SELECT id, a, pos FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pos) AS rn "
    f"FROM {CHANGE_ROWS} WHERE op = 'insert') WHERE rn = 1)"
)


def changes(spark, folder) -> DataFrame:
    return select(spark, folder, CHANGES)


@query("replay_insert", f"SELECT id, a FROM {FIRST_INSERT}")
def replay_insert(spark, folder):
    """The log is first merged into batches of ten, as statements carry it, and unpacked."""
    inserts = changes(spark, folder).where("op = 'insert'")
    batches = (
        inserts.select(
            F.col("pos").alias("rank"),
            F.concat_ws("|", "pos", "id", "a").alias("tuple"),
            F.floor(F.col("pos") / 10).alias("batch_no"),
        )
        .groupBy("batch_no")
        .agg(joined_tuples().alias("body"))
    )
    parts = F.split(F.col("row"), "\\|")
    rows = batches.select(F.explode(F.split("body", ",")).alias("row")).select(
        F.lit("insert").alias("op"), F.get(parts, 0).cast("bigint").alias("pos"),
        F.get(parts, 1).cast("bigint").alias("id"), F.get(parts, 2).cast("double").alias("a"),
    )
    return rep.replay_inserts(rows)


@query(
    "replay_keyed",
    f"""SELECT i.id, coalesce(u.a, i.a) AS a FROM {FIRST_INSERT} i LEFT JOIN (
 SELECT i.id, arg_max(u.a, u.pos) AS a FROM {FIRST_INSERT} i JOIN {CHANGE_ROWS} u
  ON u.op = 'update' AND u.id = i.id AND u.pos > i.pos GROUP BY i.id) u ON u.id = i.id""",
)
def replay_keyed(spark, folder):
    return rep.replay_keyed(changes(spark, folder))


@query(
    "replay_upsert",
    f"""SELECT id, a FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pos DESC) AS rn
 FROM {CHANGE_ROWS} WHERE op IN ('insert', 'replace')) WHERE rn = 1""",
)
def replay_upsert(spark, folder):
    return rep.replay_upserts(changes(spark, folder))


@query(
    "replay_all",
    f"""WITH l AS (SELECT * FROM {CHANGE_ROWS}),
b AS (SELECT id, coalesce(max(pos) FILTER (WHERE op = 'replace'), min(pos) FILTER (WHERE op = 'insert')) AS pos
  FROM l GROUP BY id),
u AS (SELECT l.id, max(l.pos) AS pos FROM l JOIN b ON l.id = b.id AND l.op = 'update' AND l.pos > b.pos GROUP BY l.id)
SELECT b.id, l.a FROM b LEFT JOIN u ON b.id = u.id JOIN l ON l.pos = coalesce(u.pos, b.pos)
WHERE b.pos IS NOT NULL""",
)
def replay_all(spark, folder):
    return rep.replay(changes(spark, folder))


@query(
    "replay_statements",
    f"""WITH l AS (SELECT pos * 2 AS pos, op, id, a FROM {CHANGE_ROWS} WHERE op IN ('insert', 'replace', 'update')
  UNION ALL SELECT pos * 2 + 1, op, id + 500, a FROM {CHANGE_ROWS} WHERE op = 'insert'),
b AS (SELECT id, coalesce(max(pos) FILTER (WHERE op = 'replace'), min(pos) FILTER (WHERE op = 'insert')) AS pos
  FROM l GROUP BY id),
u AS (SELECT l.id, max(l.pos) AS pos FROM l JOIN b ON l.id = b.id AND l.op = 'update' AND l.pos > b.pos GROUP BY l.id)
SELECT b.id, l.a FROM b LEFT JOIN u ON b.id = u.id JOIN l ON l.id = b.id AND l.pos = coalesce(u.pos, b.pos)
WHERE b.pos IS NOT NULL ORDER BY b.id""",
)
def replay_statements(spark, folder):
    """Statement texts to the table they leave."""
    return rep.replay_statements(select(spark, folder, WRITES), "t")


WORD_CLASS = """[\\s.,;:!?()\\[\\]{}"''\\-]+"""
TOKENS = f"list_distinct(list_filter(regexp_split_to_array(lower(text), '{WORD_CLASS}'), lambda w: w <> ''))"


@query(
    "bulk_match",
    f"""WITH q AS (SELECT query_id, unnest(terms) AS term, len(terms) AS need FROM (
   SELECT query_id, {TOKENS} AS terms FROM (
     SELECT item_id AS query_id, text FROM benchmark
     UNION ALL SELECT 1000000 + conv_id * 1000 + turn, text FROM conversations)) ),
d AS (SELECT doc_id, unnest({TOKENS}) AS term FROM documents)
SELECT query_id, doc_id FROM q JOIN d USING (term) GROUP BY query_id, doc_id, need HAVING count(*) = need""",
)
def bulk_match_query(spark, folder):
    """Whole benchmark items and whole conversation turns as queries against all documents."""
    queries = read(spark, folder, "benchmark").selectExpr("item_id AS query_id", "text").unionByName(
        read(spark, folder, "conversations").selectExpr(
            "1000000 + conv_id * 1000 + turn AS query_id", "text"
        )
    )
    return bulk_match(read(spark, folder, "documents"), queries)


@query(
    "bulk_match_pairs",
    f"""WITH q AS (SELECT vec AS query_id, unnest(list_distinct([a, b])) AS term, len(list_distinct([a, b])) AS need FROM (
   SELECT p_partkey AS vec, ['the', 'and', 'est', 'de', 'tion', 'es', 'en', 'er', 'que', 'und'][1 + p_partkey % 10] AS a,
    ['th', 'in', 'on', 'he', 'la', 'der', 'ea', 'st', 'ou', 'le'][1 + (p_partkey // 10) % 10] AS b FROM part)),
d AS (SELECT doc_id, unnest({TOKENS}) AS term FROM documents)
SELECT p_partkey AS query_id, count(doc_id) AS n_docs FROM part LEFT JOIN (
  SELECT query_id, doc_id FROM q JOIN d USING (term) GROUP BY query_id, doc_id, need HAVING count(*) = need)
 ON query_id = p_partkey GROUP BY p_partkey""",
)
def bulk_match_pairs(spark, folder):
    """Queries of two common words, one per part; how many documents match each."""
    words = "array('the', 'and', 'est', 'de', 'tion', 'es', 'en', 'er', 'que', 'und')"
    more = "array('th', 'in', 'on', 'he', 'la', 'der', 'ea', 'st', 'ou', 'le')"
    queries = read(spark, folder, "part").selectExpr(
        "p_partkey AS query_id",
        f"concat(get({words}, cast(p_partkey % 10 AS INT)), ' ', "
        f"get({more}, cast(p_partkey div 10 % 10 AS INT))) AS text",
    )
    return match_counts(read(spark, folder, "documents"), queries)
