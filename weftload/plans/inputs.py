"""How the test tables stand in for operation logs, progress records and so on.

The select lists are valid in Spark SQL and in the SQL of the checking tool alike, so a
query and its check start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

Select = tuple[str, list[str], str]

# (table, select list, filter)
OPS: Select = (
    "events",
    [
        "event_id AS op_id",
        "CAST(user_id % 3 + 1 AS INT) AS process_index",
        "CAST(CASE event_type WHEN 'signup' THEN 0 WHEN 'purchase' THEN 1 WHEN 'click' THEN 2 "
        "WHEN 'view' THEN 3 ELSE 4 END AS INT) AS template_idx",
        "CASE event_type WHEN 'signup' THEN 'insert' WHEN 'purchase' THEN 'replace' "
        "WHEN 'click' THEN 'update' WHEN 'view' THEN 'select' ELSE 'other' END AS load_type",
        "CAST(1 + user_id % 2 AS INT) AS threads",
        "CAST(10 AS INT) AS batch_size",
        "CAST(1 + event_id % 10 AS INT) AS n_rows",
        "ts AS start_ts",
        "value AS latency_ms",
    ],
    "true",
)
SLOW_OPS: Select = (
    "lineitem", ["l_returnflag AS run_key", "l_extendedprice AS latency_ms"], "true",
)
CHANGES: Select = (
    "events",
    [
        "event_id AS pos",
        "CASE event_type WHEN 'signup' THEN 'insert' WHEN 'purchase' THEN 'replace' "
        "WHEN 'click' THEN 'update' WHEN 'view' THEN 'select' ELSE 'other' END AS op",
        "user_id AS id",
        "value AS a",
    ],
    "true",
)
PROGRESS: Select = (
    "events",
    [
        "ts",
        "CAST(user_id % 3 + 1 AS INT) AS process_index",
        "event_id AS processed",
        "value AS qps",
    ],
    "true",
)
USER_PROGRESS: Select = (
    "events",
    ["ts", "user_id AS process_index", "event_id AS processed", "value AS qps"],
    "true",
)
CONFIG: Select = (
    "customer",
    [
        "c_custkey AS process_index",
        "CAST(1 + c_nationkey % 4 AS INT) AS threads",
        "CAST(10 * (1 + c_nationkey % 3) AS INT) AS batch_size",
        "CASE c_nationkey % 4 WHEN 0 THEN 'insert' WHEN 1 THEN 'replace' WHEN 2 THEN 'select' "
        "ELSE 'insert' END AS load_type",
        "CASE WHEN c_nationkey % 6 = 5 THEN '' ELSE concat('t', CAST(c_nationkey % 6 AS STRING)) "
        "END AS target",
    ],
    "true",
)
STATUS: Select = (
    "orders",
    [
        "o_orderdate AS ts",
        "concat('t', CAST(o_custkey % 4 AS STRING)) AS target",
        "CASE o_orderkey % 6 WHEN 0 THEN 'disk_bytes' WHEN 1 THEN 'indexed_documents' "
        "WHEN 2 THEN 'disk_chunks' WHEN 3 THEN 'optimizing' WHEN 4 THEN 'ram_bytes' "
        "ELSE 'killed_rate' END AS variable",
        "CASE o_orderkey % 6 WHEN 0 THEN CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING) "
        "WHEN 1 THEN CAST(o_custkey AS STRING) WHEN 2 THEN CAST(o_custkey % 9 AS STRING) "
        "WHEN 3 THEN CAST(o_custkey % 2 AS STRING) WHEN 4 THEN 'n/a' "
        "ELSE o_orderpriority END AS value",
    ],
    "true",
)
# Status reports at the times of the event log, so that they change while records come in.
LIVE_STATUS: Select = (
    "events",
    [
        "ts",
        "concat('t', CAST(user_id % 4 AS STRING)) AS target",
        "CASE event_id % 6 WHEN 0 THEN 'disk_bytes' WHEN 1 THEN 'indexed_documents' "
        "WHEN 2 THEN 'disk_chunks' WHEN 3 THEN 'optimizing' WHEN 4 THEN 'ram_bytes' "
        "ELSE 'killed_rate' END AS variable",
        "CASE WHEN event_id % 50 = 7 THEN 'n/a' WHEN event_id % 6 = 3 THEN CAST(event_id % 2 AS STRING) "
        "ELSE CAST(event_id % 1000 AS STRING) END AS value",
    ],
    "true",
)
SIZES: Select = (
    "orders",
    [
        "o_orderdate AS ts", "o_orderstatus AS target",
        "CAST(floor(o_totalprice) AS BIGINT) AS disk_bytes",
    ],
    "true",
)
# Statement texts of every kind, built from order and customer numbers.
STATEMENTS: Select = (
    "orders",
    [
        "o_orderkey AS stmt_id",
        "o_custkey AS group_id",
        "CASE o_orderkey % 9 "
        "WHEN 0 THEN concat('INSERT INTO T', CAST(o_custkey % 50 AS STRING), '(id,a) VALUES (', "
        "CAST(o_orderkey AS STRING), ', 7)') "
        "WHEN 1 THEN concat('  insert into pad', CAST(o_custkey % 9 AS STRING), ' values (1)') "
        "WHEN 2 THEN concat('Replace  Into db:r', CAST(o_custkey % 5 AS STRING), ' VALUES (2, ''x(y)'')') "
        "WHEN 3 THEN concat('SELECT * FROM Src', CAST(o_custkey % 7 AS STRING), ', other WHERE MATCH(''a'')') "
        "WHEN 4 THEN concat('update t set a = ', CAST(o_custkey AS STRING), ' where id = 1') "
        "WHEN 5 THEN concat('DELETE FROM d-', CAST(o_custkey % 3 AS STRING), ' where id = 2') "
        "WHEN 6 THEN concat('create table n', CAST(o_custkey % 4 AS STRING), '(a int)') "
        "WHEN 7 THEN concat('show status like ''', o_orderpriority, '''') "
        "ELSE o_orderpriority END AS sql",
    ],
    "true",
)
# Statements that write a table: several tuples, replaces, keyed updates, texts with brackets and
# key words in them, and statements that write nothing. A quote is written as chr(39).
_Q = "chr(39)"
WRITES: Select = (
    "events",
    [
        "event_id AS pos",
        f"CASE event_type WHEN 'signup' THEN concat('INSERT INTO t(note, id, a) VALUES (', {_Q}, 'it', {_Q}, {_Q}, "
        f"'s (x), y', {_Q}, ', ', CAST(user_id AS STRING), ', ', CAST(value AS STRING), '),(', {_Q}, '); values (1', {_Q}, "
        "', ', CAST(user_id + 500 AS STRING), ', ', CAST(value AS STRING), ');') "
        "WHEN 'purchase' THEN concat('replace into t (id, a) values(', CAST(user_id AS STRING), ',', "
        "CAST(value AS STRING), ')') "
        f"WHEN 'click' THEN concat('update t set note = ', {_Q}, ' where id = 7', {_Q}, ', a = ', "
        "CAST(value AS STRING), ' where id = ', CAST(user_id AS STRING), ';') "
        "WHEN 'view' THEN concat('INSERT INTO other(id, a) VALUES (', CAST(user_id AS STRING), ', 1)') "
        "ELSE 'select * from t where id = 1' END AS stmt",
    ],
    "true",
)
# Templates with known, unknown and malformed placeholders.
TEMPLATES: Select = (
    "part",
    [
        "p_partkey AS template_id",
        "concat('INSERT INTO t', CAST(p_partkey % 7 AS STRING), '(id,name,v) VALUES (<increment/', "
        "CAST(p_partkey AS STRING), '>, ''<text/1/', CAST(p_size AS STRING), '>'', ', "
        "CASE p_partkey % 6 WHEN 0 THEN '<integer/1/2>' "
        "WHEN 1 THEN concat('<text/{/data/', p_name, '.txt}/2/9>') "
        "WHEN 2 THEN '<int/5>' WHEN 3 THEN '<array_float/1/3/-1.5/2.5>' "
        "WHEN 4 THEN '<intern''s>, <unknown/3>' "
        "ELSE '<boolean>, <increment/1>, <increment/1>' END, ', <bigint/-5/', "
        "CAST(p_size AS STRING), '>, <increment>)') AS sql",
    ],
    "true",
)


def select(spark: SparkSession, folder: str, source: Select) -> DataFrame:
    table, columns, condition = source
    return read(spark, folder, table).where(condition).selectExpr(*columns)


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def sql(source: Select) -> str:
    table, columns, condition = source
    return f"(SELECT {', '.join(columns)} FROM {table} WHERE {condition})"
