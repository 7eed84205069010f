"""Registered queries: placeholders, statement types, tables, scripts, settings, formats."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftload.functions import formats as fmt
from weftload.functions import statements as st
from weftload.plans.inputs import STATEMENTS, TEMPLATES, read, select, sql
from weftload.functions.text import exploded
from weftload.plans.registry import query
from weftload.spec import fingerprint_column, inherited

TEMPLATE_ROWS = sql(TEMPLATES)
STATEMENT_ROWS = sql(STATEMENTS)
KINDS = "increment|string|text|int|bigint|float|boolean|array|array_float"
KIND_LIST = "(" + ", ".join(f"'{k}'" for k in KINDS.split("|")) + ")"
FOUND = (
    "(SELECT template_id, CAST(generate_subscripts(f, 1) - 1 AS INT) AS slot, "
    "unnest(f) AS placeholder, len(f) AS n FROM (SELECT template_id, "
    f"regexp_extract_all(sql, '<((?:{KINDS})[^>]*)>', 1) AS f FROM {TEMPLATE_ROWS}))"
)


def found(spark, folder):
    return st.placeholders(select(spark, folder, TEMPLATES)).drop("sql")


@query("tmpl_extract", f"SELECT template_id, slot, placeholder FROM {FOUND}")
def tmpl_extract(spark, folder):
    return found(spark, folder)


@query(
    "tmpl_slot_order",
    f"SELECT template_id, slot, placeholder, CAST(n - 1 - slot AS INT) AS from_right FROM {FOUND}",
)
def tmpl_slot_order(spark, folder):
    return st.slot_order(select(spark, folder, TEMPLATES)).drop("sql")


@query(
    "tmpl_slot_counts",
    f"SELECT template_id, placeholder, count(*) AS n FROM {FOUND} GROUP BY ALL",
)
def tmpl_slot_counts(spark, folder):
    return found(spark, folder).groupBy("template_id", "placeholder").agg(
        F.count(F.lit(1)).alias("n")
    )


FILE_FORM = "'^text/\\{([^}]+)\\}/(\\d+)/(\\d+)$'"


@query(
    "tmpl_decode",
    f"""WITH p AS (
  SELECT template_id, slot, placeholder, nullif(regexp_extract(placeholder, {FILE_FORM}, 1), '') AS path,
    CASE WHEN regexp_matches(placeholder, {FILE_FORM}) THEN 'text/' || regexp_extract(placeholder, {FILE_FORM}, 2)
      || '/' || regexp_extract(placeholder, {FILE_FORM}, 3) ELSE placeholder END AS plain FROM {FOUND}),
s AS (SELECT *, string_split(plain, '/') AS parts FROM p),
k AS (SELECT *, parts[1] IN {KIND_LIST} AS known FROM s)
SELECT template_id, slot, placeholder, path,
  CASE WHEN NOT known THEN 'exact' WHEN parts[1] = 'bigint' THEN 'int' ELSE parts[1] END AS kind,
  CASE WHEN known THEN try_cast(parts[2] AS DOUBLE) END AS arg1,
  CASE WHEN known THEN try_cast(parts[3] AS DOUBLE) END AS arg2,
  CASE WHEN known THEN try_cast(parts[4] AS DOUBLE) END AS arg3,
  CASE WHEN known THEN try_cast(parts[5] AS DOUBLE) END AS arg4,
  known AND len(parts) <> CASE WHEN parts[1] IN ('array', 'array_float') THEN 5
    WHEN parts[1] IN ('increment', 'boolean') THEN len(parts) ELSE 3 END AS bad_arity
FROM k""",
)
def tmpl_decode(spark, folder):
    return st.decoded(found(spark, folder))


@query(
    "tmpl_exact",
    f"""SELECT template_id, slot, '''' || regexp_replace(placeholder, '([''"\\\\])', '\\\\\\1', 'g') || ''''
 AS literal FROM {FOUND} WHERE string_split(placeholder, '/')[1] NOT IN {KIND_LIST}""",
)
def tmpl_exact(spark, folder):
    decoded = st.decoded(found(spark, folder))
    return decoded.where("kind = 'exact'").select(
        "template_id", "slot", st.quoted_literal(F.col("placeholder")).alias("literal")
    )


TYPE = (
    "CASE WHEN lower(trim(sql)) LIKE 'select%' THEN 'select' "
    "WHEN lower(trim(sql)) LIKE 'insert%' THEN 'insert' "
    "WHEN lower(trim(sql)) LIKE 'replace%' THEN 'replace' "
    "WHEN lower(trim(sql)) LIKE 'delete%' THEN 'delete' "
    "WHEN lower(trim(sql)) LIKE 'update%' THEN 'update' ELSE 'other' END"
)
TABLE = (
    "coalesce(nullif(regexp_extract(lower(sql), '^(?:insert\\s+into|replace\\s+into)\\s+([^\\s(]+)', 1), ''), "
    "nullif(regexp_extract(lower(sql), '^create\\s+table\\s+([^\\s(]+)', 1), ''), "
    "nullif(regexp_extract(lower(sql), '\\bfrom\\s+([^\\s,()]+)', 1), ''), '')"
)


@query(
    "stmt_is_insert",
    f"SELECT stmt_id, regexp_matches(lower(sql), '^(insert|replace)') AS batchable FROM {STATEMENT_ROWS}",
)
def stmt_is_insert(spark, folder):
    return select(spark, folder, STATEMENTS).select(
        "stmt_id", st.is_batchable(F.col("sql")).alias("batchable")
    )


@query("stmt_type", f"SELECT stmt_id, {TYPE} AS load_type FROM {STATEMENT_ROWS}")
def stmt_type(spark, folder):
    return select(spark, folder, STATEMENTS).select(
        "stmt_id", st.statement_type(F.col("sql")).alias("load_type")
    )


@query("stmt_table", f"SELECT stmt_id, {TABLE} AS target FROM {STATEMENT_ROWS}")
def stmt_table(spark, folder):
    return select(spark, folder, STATEMENTS).select(
        "stmt_id", st.target_table(F.col("sql")).alias("target")
    )


@query(
    "stmt_table_valid",
    f"""SELECT stmt_id, target, regexp_matches(target, '^[a-zA-Z0-9_:]+$') AS valid,
 regexp_matches(target, '^[a-zA-Z0-9_]+$') AS valid_new FROM (
 SELECT stmt_id, regexp_extract(sql, '(?i)(?:from|into)\\s+([^\\s(,]+)', 1) AS target FROM {STATEMENT_ROWS})""",
)
def stmt_table_valid(spark, folder):
    named = select(spark, folder, STATEMENTS).select(
        "stmt_id", st.loose_table(F.col("sql")).alias("target")
    )
    return named.select(
        "stmt_id", "target",
        F.col("target").rlike(st.VALID_TABLE_REGEX).alias("valid"),
        F.col("target").rlike(st.VALID_NEW_TABLE_REGEX).alias("valid_new"),
    )


# A statement set is what one order asks for: its own statement and up to two kinds more.
SET_COLUMNS = [
    "stmt_id",
    "CASE stmt_id % 4 WHEN 0 THEN array_of(sql) "
    "WHEN 1 THEN array_of('show tables', sql) "
    "WHEN 2 THEN array_of(sql, 'delete from gone', 'select 1') "
    "ELSE array_of('set x = 1', 'update u set a = 1', sql) END AS sqls",
]


@query(
    "stmt_set_type",
    f"""WITH e AS (SELECT stmt_id, generate_subscripts(sqls, 1) AS i, unnest(sqls) AS sql FROM (
 SELECT {', '.join(SET_COLUMNS).replace('array_of', 'list_value')} FROM {STATEMENT_ROWS})),
t AS (SELECT stmt_id, i, {TYPE} AS t, {TABLE} AS target FROM e)
SELECT stmt_id, CASE WHEN bool_or(t IN ('insert', 'replace')) THEN 'insert'
 ELSE coalesce(arg_min(t, i) FILTER (WHERE t <> 'other'), 'other') END AS load_type,
 coalesce(arg_min(target, i) FILTER (WHERE target <> ''), '') AS target FROM t GROUP BY stmt_id""",
)
def stmt_set_type(spark, folder):
    """Type and first table of every set of statements."""
    columns = [c.replace("array_of", "array") for c in SET_COLUMNS]
    sets = select(spark, folder, STATEMENTS).selectExpr(*columns)
    types = F.transform("sqls", st.statement_type)
    return sets.select(
        "stmt_id", st.statement_set_type(types).alias("load_type"),
        st.first_target_table(F.col("sqls")).alias("target"),
    )


@query(
    "script_split",
    """WITH p AS (SELECT doc_id, regexp_extract_all(concat('create table x(a int); insert into x values (''p;q''); ',
  text, ' ; select "a;b"'), '((?:[^;"'']|"[^"]*"|''[^'']*'')+)', 1) AS parts FROM documents),
t AS (SELECT doc_id, list_filter(list_transform(parts, lambda p: regexp_replace(p, '^\\s+|\\s+$', '', 'g')),
  lambda p: p <> '') AS parts FROM p)
SELECT doc_id, CAST(generate_subscripts(parts, 1) - 1 AS INT) AS part, unnest(parts) AS stmt FROM t""",
)
def script_split(spark, folder):
    """Whole document texts inside a script."""
    script = F.concat(
        F.lit("create table x(a int); insert into x values ('p;q'); "), F.col("text"),
        F.lit(' ; select "a;b"'),
    )
    documents = read(spark, folder, "documents").select("doc_id", "text")
    return exploded(documents, st.script_parts(script), "stmt", "part").drop("text")


WEIGHT_COLUMNS = [
    "o_orderkey AS job",
    "CASE o_orderkey % 8 WHEN 0 THEN '0.3,0.7' WHEN 1 THEN '1,3' WHEN 2 THEN '0.2,0.9' "
    "WHEN 3 THEN '0.2,0.7,0.1' WHEN 4 THEN '0.2,-0.7' WHEN 5 THEN '0.2, x' WHEN 6 THEN '0.5,0.2' "
    "ELSE concat('0.', CAST(1 + o_custkey % 9 AS STRING), ', 0.5') END AS weights",
]


@query(
    "weights_check",
    f"""WITH w AS (SELECT {', '.join(WEIGHT_COLUMNS)} FROM orders),
p AS (SELECT job, weights, list_transform(string_split(weights, ','),
  lambda x: try_cast(trim(x) AS DECIMAL(20,9))) AS vals FROM w)
SELECT job, weights, CASE WHEN len(list_filter(vals, lambda v: v IS NULL)) > 0 THEN 'invalid value'
 WHEN len(vals) <> 2 THEN 'wrong number of values'
 WHEN len(list_filter(vals, lambda v: v < 0)) > 0 THEN 'negative value'
 WHEN list_sum(vals) > 1.000001 THEN 'total above 1'
 WHEN list_sum(vals) < 0.999999 THEN 'total is not 1' END AS error FROM p""",
)
def weights_check(spark, folder):
    jobs = read(spark, folder, "orders").selectExpr(*WEIGHT_COLUMNS)
    return jobs.withColumn("error", st.weights_error(F.col("weights"), F.lit(2)))


@query(
    "config_inherit",
    """SELECT c_custkey AS process_index,
 CAST(coalesce(CASE WHEN c_custkey % 3 = 0 THEN 1 + c_custkey % 8 END,
   CASE WHEN n_nationkey % 2 = 0 THEN 2 + n_nationkey END, 1) AS BIGINT) AS threads,
 CAST(coalesce(CASE WHEN c_custkey % 4 = 0 THEN 100 END, CASE WHEN n_nationkey % 3 = 0 THEN 10 END, 1)
   AS BIGINT) AS batch_size
FROM customer JOIN nation ON c_nationkey = n_nationkey""",
)
def config_inherit(spark, folder):
    """Own setting, else the setting of the group (nation), else the default; other names are dropped."""
    own = read(spark, folder, "customer").selectExpr(
        "c_custkey AS process_index", "c_nationkey",
        "map('threads', CASE WHEN c_custkey % 3 = 0 THEN CAST(1 + c_custkey % 8 AS STRING) END, "
        "'batch_size', CASE WHEN c_custkey % 4 = 0 THEN '100' END, 'host', c_name) AS own",
    )
    common = read(spark, folder, "nation").selectExpr(
        "n_nationkey AS c_nationkey",
        "CASE WHEN n_nationkey % 2 = 0 THEN map('threads', CAST(2 + n_nationkey AS STRING), 'batch_size', "
        "CASE WHEN n_nationkey % 3 = 0 THEN '10' END) ELSE map('batch_size', "
        "CASE WHEN n_nationkey % 3 = 0 THEN '10' END, 'other', n_name) END AS common",
    )
    found = inherited(F.col("own"), F.col("common"), {"threads": 1, "batch_size": 1})
    return own.join(common, "c_nationkey").select(
        "process_index", *[value.cast("bigint").alias(name) for name, value in found.items()]
    )


@query(
    "param_check",
    """SELECT job, CASE WHEN load = '' THEN 'load is required' WHEN total <= 0 THEN 'total must be positive'
 WHEN iterations IS NULL OR iterations <= 0 THEN 'iterations must be positive'
 WHEN job % 7 = 3 OR job % 11 = 5 THEN 'threads must be positive'
 WHEN job % 13 = 4 THEN 'batch_sizes must be positive' END AS error FROM (
 SELECT o_orderkey AS job, CASE WHEN o_orderkey % 5 = 1 THEN '' ELSE 'select 1' END AS load, o_custkey % 4 - 1 AS total,
  CASE WHEN o_orderkey % 6 = 2 THEN NULL ELSE o_custkey % 3 END AS iterations FROM orders)""",
)
def param_check(spark, folder):
    """A parameter set per order, some of them faulty."""
    sets = read(spark, folder, "orders").selectExpr(
        "o_orderkey AS job", "CASE WHEN o_orderkey % 5 = 1 THEN '' ELSE 'select 1' END AS load",
        "CAST(o_custkey % 4 - 1 AS STRING) AS total",
        "CASE WHEN o_orderkey % 6 = 2 THEN 'x' ELSE CAST(o_custkey % 3 AS STRING) END AS iterations",
        "CASE WHEN o_orderkey % 7 = 3 THEN '1,0' WHEN o_orderkey % 11 = 5 THEN '2,' ELSE '1, 4' END AS threads",
        "CASE WHEN o_orderkey % 13 = 4 THEN '10,-1' ELSE '10' END AS batch_sizes",
    )
    names = ("load", "total", "iterations", "threads", "batch_sizes")
    return sets.select("job", st.parameters_error(*map(F.col, names)).alias("error"))


@query(
    "spec_fingerprint",
    """SELECT o_orderkey AS job, md5('{"batch_sizes":[' || (1 + o_orderkey % 5) || '],"content":{},"init":"' || o_orderpriority
 || '","iterations":1,"load":["insert into t values(<increment>)"],"process_index":1,"seed":42,"total":' || (1 + o_custkey)
 || ',"weights":null}') AS fingerprint FROM orders""",
)
def spec_fingerprint(spark, folder):
    """Identity of a spec per order: batch size, init text and total come from columns."""
    found = fingerprint_column({
        "load": F.array(F.lit("insert into t values(<increment>)")),
        "total": 1 + F.col("o_custkey"),
        "batch_sizes": F.array(1 + F.col("o_orderkey") % 5),
        "init": F.col("o_orderpriority"),
    })
    return read(spark, folder, "orders").select(F.col("o_orderkey").alias("job"), found.alias("fingerprint"))


# ---------------------------------------------------------------- figures as text

# Eighths of a second; the check rounds halves up, as the formatter does.
SECONDS = "CAST(o_orderkey % 6000 AS DOUBLE) / 8"


@query(
    "fmt_elapsed",
    f"""WITH s AS (SELECT o_orderkey, {SECONDS} AS s FROM orders)
SELECT o_orderkey, CASE WHEN s < 1 THEN CAST(CAST(round(s * 1000) AS BIGINT) AS STRING) || 'ms'
 WHEN s < 60 THEN CAST(CAST(floor(s * 10 + 0.5) AS BIGINT) // 10 AS STRING) || '.' ||
   CAST(CAST(floor(s * 10 + 0.5) AS BIGINT) % 10 AS STRING) || 's'
 ELSE printf('%02d:%02d', CAST(floor(s / 60) AS BIGINT), CAST(floor(s) AS BIGINT) % 60) END AS shown FROM s""",
)
def fmt_elapsed(spark, folder):
    seconds = read(spark, folder, "orders").selectExpr("o_orderkey", f"{SECONDS} AS s")
    return seconds.select("o_orderkey", fmt.elapsed(F.col("s")).alias("shown"))


@query(
    "fmt_mmss",
    """SELECT event_id, printf('%02d:%02d', CAST(floor(floor(value * 60) / 60) AS BIGINT),
 CAST(floor(value * 60) AS BIGINT) % 60) AS shown FROM events""",
)
def fmt_mmss(spark, folder):
    return read(spark, folder, "events").select(
        "event_id", fmt.mmss(F.col("value") * 60).alias("shown")
    )


BYTES = "(o_orderkey - 500) * (1 + o_custkey) * (1 + o_orderkey % 997)"


@query(
    "fmt_bytes",
    f"""WITH b AS (SELECT o_orderkey, {BYTES} AS b, abs({BYTES}) AS s FROM orders)
SELECT o_orderkey, CASE WHEN b < 0 THEN '-' ELSE '' END || CASE
 WHEN s >= 1073741824 THEN CAST(CAST(round(s / 1073741824 * 100) AS BIGINT) // 100 AS STRING) || '.' ||
   lpad(CAST(CAST(round(s / 1073741824 * 100) AS BIGINT) % 100 AS STRING), 2, '0') || 'GB'
 WHEN s >= 1048576 THEN CAST(CAST(round(s / 1048576) AS BIGINT) AS STRING) || 'MB'
 WHEN s >= 1024 THEN CAST(CAST(round(s / 1024) AS BIGINT) AS STRING) || 'KB'
 ELSE CAST(s AS STRING) || 'B' END AS shown FROM b""",
)
def fmt_bytes(spark, folder):
    sizes = read(spark, folder, "orders").selectExpr("o_orderkey", f"{BYTES} AS b")
    return sizes.select("o_orderkey", fmt.byte_size(F.col("b")).alias("shown"))


# One unit is added so that no count lies halfway between two tenths.
COUNTS = "CASE o_orderkey % 4 WHEN 0 THEN o_custkey WHEN 1 THEN o_custkey * 100 + 1 " \
    "WHEN 2 THEN o_custkey * 1000 + 1 ELSE (o_custkey + 7) * 123457 END * (1 + o_orderkey % 3)"


@query(
    "fmt_count",
    f"""WITH c AS (SELECT o_orderkey, {COUNTS} AS n FROM orders),
u AS (SELECT *, CASE WHEN n >= 1000000000 THEN 1000000000 WHEN n >= 1000000 THEN 1000000
  WHEN n >= 1000 THEN 1000 END AS unit FROM c)
SELECT o_orderkey, CASE WHEN unit IS NULL THEN CAST(n AS STRING) ELSE
 CAST((n * 10 + unit // 2) // unit // 10 AS STRING) || '.' || CAST((n * 10 + unit // 2) // unit % 10 AS STRING)
 || CASE unit WHEN 1000 THEN 'K' WHEN 1000000 THEN 'M' ELSE 'B' END END AS shown FROM u""",
)
def fmt_count(spark, folder):
    counts = read(spark, folder, "orders").selectExpr("o_orderkey", f"{COUNTS} AS n")
    return counts.select("o_orderkey", fmt.short_count(F.col("n")).alias("shown"))


@query("fmt_clock", "SELECT event_id, strftime(ts, '%H:%M:%S') AS shown FROM events")
def fmt_clock(spark, folder):
    return read(spark, folder, "events").select("event_id", fmt.clock(F.col("ts")).alias("shown"))


@query(
    "progress_parse",
    """SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
 '{"event_id":' || event_id || ',"k":' || json_extract_string(props, '$.k') || '}' AS written FROM events""",
)
def progress_parse(spark, folder):
    """JSON read with a fixed schema and written again."""
    parsed = read(spark, folder, "events").select(
        "event_id", F.from_json("props", "k BIGINT")["k"].alias("k")
    )
    return parsed.withColumn("written", F.to_json(F.struct("event_id", "k")))
