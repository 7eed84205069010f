"""Registered queries: row generation, mixes, batching. Rows are orders or customers,
whose keys serve as row numbers."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftload.functions.draws import key60
from weftload.functions.patterns import Slot, String, Text
from weftload.functions.text import Vocabulary
from weftload.operators.batching import (
    allocate,
    batch_number,
    first_rows,
    values_prefix,
    values_tuple,
)
from weftload.operators.blocks import dealt_out, running_sum
from weftload.operators.mix import (
    MIX_TEMPLATE,
    choose_from_table,
    choose_template,
    cumulative_weights,
    mix_share,
    template_rank,
    thresholds,
)
from weftload.plans import check_sql as c
from weftload.plans.inputs import read
from weftload.plans.registry import query
from weftload.plans.workload import (
    batched_statements,
    repeated,
    single_statements,
    statements,
    together,
    typed_rows,
)
from weftload.session import shared_dir
from weftload.sources.files import (
    bulk_write,
    cached_statements,
    preview,
    read_statements,
    write_statements,
)
from weftload.sources.vocabulary import (
    count_words,
    load_vocabulary,
    text_from_pages,
    vocabulary_pages,
    vocabulary_rows,
)
from weftload.spec import WorkloadSpec, swept

ORDER_ROWS = "(SELECT o_orderkey AS row_id FROM orders)"
CUSTOMER_ROWS = "(SELECT c_custkey AS row_id FROM customer)"
TOTAL = "(SELECT count(*) FROM orders)"


def order_rows(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "orders").select(F.col("o_orderkey").alias("row_id"))


def customer_rows(spark: SparkSession, folder: str) -> DataFrame:
    return dealt_out(read(spark, folder, "customer").select(F.col("c_custkey").alias("row_id")))


def _typed(load: str, rows: DataFrame, *names: str) -> DataFrame:
    """Values of one template, without the rank. The total only places short batches."""
    df = typed_rows(WorkloadSpec.of(load, 1), rows).drop("rank")
    return df.toDF("row_id", *names) if names else df


def _int(slot: int, low: int, high: int) -> str:
    return f"{c.key60(0, slot)} % {high - low + 1} + ({low})"


def _float(slot: int, low: int, high: int) -> str:
    """Bounds on the grid of 1e-8."""
    return f"CAST({_int(slot, low, high)} AS DOUBLE) / 100000000"


def _string(slot: int, low: int, high: int) -> str:
    state = c.key60(0, slot)
    letters = c.element_list("s", "n")
    return (
        f"(SELECT coalesce(array_to_string(list_transform({letters}, "
        f"lambda d: substr('abcdefghijklmnopqrstuvwxyz', d % 26 + 1, 1)), ''), '') "
        f"FROM (SELECT s, {c.element_in('s', '0', low, high)} AS n FROM (SELECT {state} AS s)))"
    )


ROWS_LOAD = (
    "INSERT INTO t(id, code, age, price, flag) VALUES "
    "(<increment/100>, '<string/3/10>', <int/5/90>, <float/0.5/99.25>, <boolean>)"
)


@query(
    "gen_rows",
    f"SELECT row_id, row_id + 100 AS id, {_string(1, 3, 10)} AS code, {_int(2, 5, 90)} AS age, "
    f"{_float(3, 50000000, 9925000000)} AS price, CAST({c.key60(0, 4)} % 2 AS INT) AS flag "
    f"FROM {ORDER_ROWS}",
)
def gen_rows(spark, folder):
    return _typed(ROWS_LOAD, order_rows(spark, folder))


@query(
    "gen_increment",
    f"SELECT row_id, row_id * 2 + 6 AS a, row_id * 2 + 5 AS b, row_id + 1 AS d FROM {ORDER_ROWS}",
)
def gen_increment(spark, folder):
    load = "INSERT INTO t VALUES (<increment/5>, <increment/5>, <increment>)"
    return _typed(load, order_rows(spark, folder), "a", "b", "d")


@query(
    "gen_int",
    f"SELECT row_id, {_int(0, -50, 50)} AS a, {_int(1, 0, 10**15)} AS b FROM {ORDER_ROWS}",
)
def gen_int(spark, folder):
    return _typed(
        "INSERT INTO t VALUES (<int/-50/50>, <bigint/0/1000000000000000>)",
        order_rows(spark, folder), "a", "b",
    )


@query(
    "gen_float",
    f"SELECT row_id, {_float(0, -150000000, 250000000)} AS a, "
    f"CAST({_int(0, -150000000, 250000000)} AS BIGINT) AS grid FROM {ORDER_ROWS}",
)
def gen_float(spark, folder):
    values = _typed("INSERT INTO t VALUES (<float/-1.5/2.5>)", order_rows(spark, folder), "a")
    return values.withColumn("grid", F.round(F.col("a") * 100_000_000).cast("bigint"))


@query("gen_boolean", f"SELECT row_id, CAST({c.key60(0, 0)} % 2 AS INT) AS a FROM {ORDER_ROWS}")
def gen_boolean(spark, folder):
    return _typed("INSERT INTO t VALUES (<boolean>)", order_rows(spark, folder), "a")


@query("gen_string", f"SELECT row_id, {_string(0, 0, 12)} AS a FROM {ORDER_ROWS}")
def gen_string(spark, folder):
    return _typed("INSERT INTO t VALUES ('<string/0/12>')", order_rows(spark, folder), "a")


def _array(values: str, slot: int, low: int, high: int) -> str:
    return (
        f"(SELECT {values} FROM (SELECT s, {c.element_in('s', '0', low, high)} AS n "
        f"FROM (SELECT {c.key60(0, slot)} AS s)))"
    )


def _wide_elements(low: int, high: int) -> str:
    return (
        f"list_transform(range(1, n + 1), lambda k: {c.element_in('s', 'k', low, high)})"
    )


# Arrays are compared as text, which every engine prints the same way for whole numbers.
@query(
    "gen_array",
    "SELECT row_id, array_to_string(v, ',') AS a, len(v) AS n FROM (SELECT row_id, "
    + _array(f"list_transform({c.element_list('s', 'n')}, lambda d: d % 90 + 10)", 0, 0, 6)
    + f" AS v FROM {ORDER_ROWS})",
)
def gen_array(spark, folder):
    values = _typed("INSERT INTO t VALUES ([<array/0/6/10/99>])", order_rows(spark, folder), "v")
    return values.select(
        "row_id", F.array_join(F.col("v").cast("array<string>"), ",").alias("a"),
        F.size("v").cast("bigint").alias("n"),
    )


@query(
    "gen_array_float",
    "SELECT row_id, CAST(len(v) AS BIGINT) AS n, CAST(list_sum(v) AS BIGINT) AS grid_total, "
    "v[1] / 100000000 AS first, v[len(v)] / 100000000 AS last FROM (SELECT row_id, "
    + _array(_wide_elements(-150000000, 250000000), 0, 1, 5)
    + f" AS v FROM {ORDER_ROWS})",
)
def gen_array_float(spark, folder):
    values = _typed(
        "INSERT INTO t VALUES ([<array_float/1/5/-1.5/2.5>])", order_rows(spark, folder), "v"
    )
    # Summed on the grid: whole numbers add up the same in any order.
    grid = F.transform("v", lambda x: F.round(x * 100_000_000).cast("bigint"))
    total = F.aggregate(grid, F.lit(0).cast("bigint"), lambda a, x: a + x)
    return values.select(
        "row_id", F.size("v").cast("bigint").alias("n"), total.alias("grid_total"),
        F.element_at("v", 1).alias("first"), F.element_at("v", -1).alias("last"),
    )


MARK_LIST = "['.', '!', '?', ',', ';']"


def _code(draw: str, size: str) -> str:
    return f"(CASE WHEN {draw} < 5 * {size} THEN {draw} ELSE {draw} % {size} + 5 * {size} END)"


def _text_check(rows: str, slot: int, low: int, high: int) -> str:
    words = list(Vocabulary.default().words)
    n = len(words)
    codes = f"list_transform({c.element_list('s', 'n')}, lambda d: {_code(f'(d % {n * 25})', str(n))})"
    word = f"w[codes[i] % {n} + 1]"
    capital = f"(i = 1 OR codes[i - 1] < {n})"
    shown = f"CASE WHEN {capital} THEN upper({word}[1]) || substr({word}, 2) ELSE {word} END"
    mark = (
        f"CASE WHEN i = n THEN '.' WHEN codes[i] // {n} < 5 THEN {MARK_LIST}[codes[i] // {n} + 1] "
        "ELSE '' END"
    )
    return (
        f"SELECT row_id, CASE WHEN n = 0 THEN '' ELSE array_to_string(list_transform("
        f"range(1, n + 1), lambda i: {shown} || {mark}), ' ') END AS a FROM ("
        f"SELECT *, {codes} AS codes, {c.strings(words)} AS w FROM ("
        f"SELECT row_id, s, {c.element_in('s', '0', low, high)} AS n FROM ("
        f"SELECT row_id, {c.key60(0, slot)} AS s FROM {rows})))"
    )


@query("gen_text", _text_check(CUSTOMER_ROWS, 0, 0, 40))
def gen_text(spark, folder):
    return _typed("INSERT INTO t VALUES ('<text/0/40>')", customer_rows(spark, folder), "a")


WORD_CLASS = """[\\s.,;:!?()\\[\\]{}"''\\-]+"""
WORDS = f"list_filter(regexp_split_to_array(text, '{WORD_CLASS}'), lambda w: w <> '')"


@query(
    "vocab_scan",
    "SELECT doc_id, CAST(generate_subscripts(ws, 1) - 1 AS INT) AS word_pos, unnest(ws) AS word "
    f"FROM (SELECT doc_id, {WORDS} AS ws FROM documents)",
)
def vocab_scan(spark, folder):
    documents = read(spark, folder, "documents").select("doc_id", "text")
    return vocabulary_rows(documents, "text").drop("text")


VOCAB_CHECK = f"""
WITH words AS (
  SELECT word, row_number() OVER (ORDER BY doc_id, p) - 1 AS pos FROM (
    SELECT doc_id, generate_subscripts(ws, 1) AS p, unnest(ws) AS word
    FROM (SELECT doc_id, {WORDS} AS ws FROM documents))),
size AS (SELECT count(*) AS n FROM words),
counted AS (
  SELECT row_id, s, n, {c.element_in('s', '0', 3, 12)} AS cnt
  FROM (SELECT row_id, {c.key60(0, 0)} AS s FROM {CUSTOMER_ROWS}) CROSS JOIN size),
drawn AS (
  SELECT row_id, n, cnt, k, ({c.element31('s', 'k * 2')} * {c.PRIME} + {c.element31('s', 'k * 2 + 1')})
    % (n * 25) AS d
  FROM (SELECT *, unnest(range(1, cnt + 1)) AS k FROM counted)),
coded AS (SELECT row_id, n, cnt, k, {_code('d', 'n')} AS code FROM drawn),
keyed AS (SELECT row_id, cnt, k, code % n AS pos, code // n AS mark FROM coded),
placed AS (SELECT row_id, cnt, k, word, mark FROM keyed JOIN words USING (pos)),
marked AS (
  SELECT *, lag(mark) OVER (PARTITION BY row_id ORDER BY k) AS before FROM placed)
SELECT row_id, string_agg(
  CASE WHEN k = 1 OR before = 0
    THEN translate(word[1], 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') || substr(word, 2)
    ELSE word END
  || CASE WHEN k = cnt THEN '.' WHEN mark < 5 THEN {MARK_LIST}[mark + 1] ELSE '' END,
  ' ' ORDER BY k) AS text
FROM marked GROUP BY row_id
"""


@query("gen_text_vocab", VOCAB_CHECK)
def gen_text_vocab(spark, folder):
    """Vocabulary: every word of every document."""
    documents = read(spark, folder, "documents").select("doc_id", "text")
    pages = vocabulary_pages(documents, "doc_id", "text")
    return text_from_pages(customer_rows(spark, folder), pages, count_words(pages), 3, 12)


@query("gen_text_file", VOCAB_CHECK)
def gen_text_file(spark, folder):
    """The same words as a file of lines that a placeholder names; a long list stays in pages."""
    path = shared_dir(spark, "words")
    read(spark, folder, "documents").orderBy("doc_id").select("text").write.text(path)
    spec = WorkloadSpec.of(f"INSERT INTO t(text) VALUES ('<text/{{{path}}}/3/12>')", 1)
    rows = typed_rows(spec, customer_rows(spark, folder), load_words=lambda p: load_vocabulary(spark, p))
    return rows.select("row_id", "text")


@query(
    "gen_defaults",
    f"SELECT row_id, {_string(0, 3, 10)} AS code, t.a AS body FROM {CUSTOMER_ROWS} JOIN ({_text_check(CUSTOMER_ROWS, 1, 20, 300)}) t USING (row_id)",
)
def gen_defaults(spark, folder):
    """Strings and texts of the lengths they have when none is given."""
    row_id = F.col("row_id")
    slots = [Slot(42, 0, number, row_id, row_id) for number in (0, 1)]
    return customer_rows(spark, folder).select(
        "row_id", String().column(slots[0]).alias("code"), Text().column(slots[1]).alias("body")
    )


@query(
    "gen_any_partitions",
    f"SELECT row_id, row_id + 1 AS id, {_string(1, 3, 10)} AS code, {_int(2, 5, 90)} AS age FROM {ORDER_ROWS}",
)
def gen_any_partitions(spark, folder):
    """The same values whatever task makes them: rows dealt out by a hash, and the other half by ranges."""
    load = "INSERT INTO t(id, code, age) VALUES (<increment>, '<string/3/10>', <int/5/90>)"
    rows = _typed(load, order_rows(spark, folder).repartition(7, F.xxhash64("row_id")))
    other = _typed(load, order_rows(spark, folder).repartitionByRange(3, F.desc("row_id")))
    return rows.where("row_id % 2 = 0").unionByName(other.where("row_id % 2 = 1"))


RENDER_LOAD = (
    "INSERT INTO t(id, f, v) VALUES(<increment>, '<string/3/6>', [<array/1/4/1/9>], <float/0/1>)"
)


@query(
    "stmt_render",
    "SELECT row_id AS pos, 'INSERT INTO t(id, f, v) VALUES(' || (row_id + 1) || ', ''' || "
    f"{_string(1, 3, 6)} || ''', [' || array_to_string("
    + _array(f"list_transform({c.element_list('s', 'n')}, lambda d: d % 9 + 1)", 2, 1, 4)
    + f", ',') || '], ' || CAST(CAST({_int(3, 0, 10**8)} AS DECIMAL(28,8)) / 100000000 AS DECIMAL(28,8)) || ');' AS stmt "
    f"FROM {ORDER_ROWS}",
)
def stmt_render(spark, folder):
    spec = WorkloadSpec.of(RENDER_LOAD, 1)
    return single_statements(spec, order_rows(spark, folder)).select("pos", "stmt")


@query(
    "gen_json",
    f"SELECT row_id, '{{\"a\":' || a || ',\"b\":' || b || '}}' AS j, a, b FROM (SELECT row_id, "
    f"{_int(0, 1, 100)} AS a, {_int(1, 1, 9)} AS b FROM {ORDER_ROWS})",
)
def gen_json(spark, folder):
    """The typed form of a JSON field, written and read back."""
    load = """INSERT INTO t(j) VALUES('{"a": <int/1/100>, "b": <int/1/9>}')"""
    values = _typed(load, order_rows(spark, folder), "x", "y")
    text = values.select(
        "row_id", F.to_json(F.struct(F.col("x").alias("a"), F.col("y").alias("b"))).alias("j")
    )
    return text.select(
        "row_id", "j",
        F.get_json_object("j", "$.a").cast("bigint").alias("a"),
        F.get_json_object("j", "$.b").cast("bigint").alias("b"),
    )


# ---------------------------------------------------------------- mixes

WEIGHTS = [Fraction(1, 5), Fraction(3, 10), Fraction(1, 2)]
B0, B1, _ = thresholds(WEIGHTS)
CHOICE = (
    f"CASE WHEN u <= {B0} THEN 0 WHEN u <= {B1} THEN 1 ELSE 2 END"
)
CHOSEN = (
    f"(SELECT row_id, CAST({CHOICE} AS INT) AS template_idx FROM "
    f"(SELECT row_id, {c.key60(MIX_TEMPLATE, 0)} AS u FROM {ORDER_ROWS}))"
)
RANKED = (
    "(SELECT *, row_number() OVER (PARTITION BY template_idx ORDER BY row_id) - 1 AS rank "
    f"FROM {CHOSEN})"
)


def chosen(spark, folder):
    rows = order_rows(spark, folder)
    return rows.withColumn("template_idx", choose_template(42, F.col("row_id"), WEIGHTS))


@query("mix_choose", f"SELECT * FROM {CHOSEN}")
def mix_choose(spark, folder):
    return chosen(spark, folder)


@query("mix_rank", f"SELECT * FROM {RANKED}")
def mix_rank(spark, folder):
    return template_rank(chosen(spark, folder), 4096)


@query("batch_number", f"SELECT *, rank // 10 AS batch_no FROM {RANKED}")
def batch_no(spark, folder):
    return template_rank(chosen(spark, folder)).withColumn(
        "batch_no", batch_number(F.col("rank"), 10)
    )


@query(
    "mix_share",
    f"SELECT template_idx, count(*) AS n, count(*) / {TOTAL} AS share FROM {CHOSEN} "
    "GROUP BY template_idx",
)
def share(spark, folder):
    return mix_share(chosen(spark, folder))


PART_RANGES = (
    "(SELECT p_partkey AS template_idx, CAST(p_size AS BIGINT) AS weight, "
    "CAST(sum(p_size) OVER (ORDER BY p_partkey) AS BIGINT) AS hi FROM part)"
)


def part_ranges(spark, folder):
    """Each part is a template, its size the weight."""
    parts = read(spark, folder, "part").select(
        F.col("p_partkey").alias("template_idx"), F.col("p_size").cast("bigint").alias("weight")
    )
    return cumulative_weights(parts)


@query("mix_cumulative", f"SELECT *, hi - weight AS lo FROM {PART_RANGES}")
def mix_cumulative(spark, folder):
    return part_ranges(spark, folder)


@query(
    "mix_join",
    f"""WITH r AS (SELECT *, hi - weight AS lo FROM {PART_RANGES}),
d AS (SELECT row_id, {c.key60(MIX_TEMPLATE, 0)} % (SELECT CAST(sum(weight) AS BIGINT) FROM r) AS draw
      FROM {ORDER_ROWS})
SELECT row_id, draw, template_idx FROM d JOIN r ON draw >= lo AND draw < hi""",
)
def mix_join(spark, folder):
    ranges = part_ranges(spark, folder)
    total, count = read(spark, folder, "part").agg(
        F.sum(F.col("p_size").cast("bigint")), F.count(F.lit(1))
    ).first()
    draws = order_rows(spark, folder).withColumn(
        "draw", key60(42, MIX_TEMPLATE, F.col("row_id"), 0) % total
    )
    return choose_from_table(draws, ranges, total, count).select("row_id", "draw", "template_idx")


# ---------------------------------------------------------------- batching

INSERT_LOAD = "insert into t values(<increment>, <int/1/10>)"
UPDATE_LOAD = "update t set a = <int/100/200> where a = <int/1/10>"


def _mixed_check(batch: int) -> str:
    """Weights 0.3 / 0.7 of the insert and the update template."""
    bound = thresholds([Fraction(3, 10), Fraction(7, 10)])[0]

    def draw(template: int, slot: int, low: int, high: int) -> str:
        return f"({c.key60(template, slot)} % {high - low + 1} + {low})"

    return f"""
WITH r AS (
  SELECT row_id, CAST(CASE WHEN {c.key60(MIX_TEMPLATE, 0)} <= {bound} THEN 0 ELSE 1 END AS INT)
    AS template_idx FROM {ORDER_ROWS}),
k AS (SELECT *, row_number() OVER (PARTITION BY template_idx ORDER BY row_id) - 1 AS rank FROM r),
inserts AS (
  SELECT 0 AS template_idx, rank // {batch} AS batch_no, CAST(count(*) AS INT) AS n_rows,
    max(row_id) AS last_row,
    'insert into t values' || string_agg('(' || (rank + 1) || ', ' || {draw(0, 1, 1, 10)} || ')',
      ',' ORDER BY rank) || ';' AS stmt
  FROM k WHERE template_idx = 0 GROUP BY rank // {batch}),
updates AS (
  SELECT row_id AS pos, 1 AS template_idx, rank AS batch_no, 1 AS n_rows,
    'update t set a = ' || {draw(1, 0, 100, 200)} || ' where a = ' || {draw(1, 1, 1, 10)} || ';'
    AS stmt FROM k WHERE template_idx = 1)
SELECT CAST(CASE WHEN n_rows = {batch} THEN last_row ELSE {TOTAL} END AS BIGINT) AS pos,
  template_idx, batch_no, n_rows, stmt FROM inserts
UNION ALL SELECT pos, template_idx, batch_no, n_rows, stmt FROM updates"""


def mixed_statements(spark, folder, batch: int = 5) -> DataFrame:
    rows = order_rows(spark, folder)
    spec = WorkloadSpec.of(
        [INSERT_LOAD, UPDATE_LOAD], rows.count(), weights="0.3,0.7", batch_size=batch
    )
    return batched_statements(spec, rows)


@query("batch_mixed", _mixed_check(5))
def batch_mixed(spark, folder):
    return mixed_statements(spark, folder)


@query(
    "batch_order",
    f"SELECT pos, n_rows, row_number() OVER (ORDER BY pos) AS place FROM ({_mixed_check(5)})",
)
def batch_order(spark, folder):
    """Place of every statement in the emitted list. Positions are unique, so the place is
    a running count over blocks of positions."""
    places = mixed_statements(spark, folder).select("pos", "n_rows", F.lit(1).alias("_one"))
    return running_sum(places, [], "pos", "_one", "place", 4096).drop("_one")


def _single_check(batch: int) -> str:
    return f"""
SELECT CAST(CASE WHEN count(*) = {batch} THEN max(row_id) ELSE {TOTAL} END AS BIGINT) AS pos,
  row_id // {batch} AS batch_no, CAST(count(*) AS INT) AS n_rows,
  'insert into t values' || string_agg('(' || (row_id + 1) || ', ' || ({_int(1, 1, 10)}) || ')', ','
    ORDER BY row_id) || ';' AS stmt
FROM {ORDER_ROWS} GROUP BY row_id // {batch}"""


@query("batch_assemble", _single_check(7))
def batch_assemble(spark, folder):
    rows = order_rows(spark, folder)
    spec = WorkloadSpec.of(INSERT_LOAD, rows.count(), batch_size=7)
    return statements(spark, spec, rows).drop("template_idx")


@query("batch_dense", _single_check(64))
def batch_dense(spark, folder):
    """As many rows as there are orders, batches built without a shuffle."""
    spec = WorkloadSpec.of(INSERT_LOAD, order_rows(spark, folder).count(), batch_size=64)
    return statements(spark, spec).drop("template_idx")


@query(
    "batch_prefix",
    f"""WITH r AS (SELECT row_id, template_idx, 'insert into t' || ({c.key60(0, 0)} % 5 + 1) ||
 ' values' AS prefix FROM {CHOSEN})
SELECT row_id, template_idx, first_value(prefix) OVER (PARTITION BY template_idx ORDER BY row_id
 ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS prefix FROM r""",
)
def batch_prefix(spark, folder):
    """All batches of a template carry the prefix of its first row."""
    rows = chosen(spark, folder)
    drawn = key60(42, 0, F.col("row_id"), 0) % 5 + 1
    prefix = F.concat(F.lit("insert into t"), drawn.cast("string"), F.lit(" values"))
    # One row per weight in the list: a proven bound for the broadcast.
    first = first_rows(rows).select("template_idx", prefix.alias("prefix"))
    return rows.join(F.broadcast(first), "template_idx")


@query(
    "batch_alloc",
    """WITH p AS (SELECT o_orderkey AS job, o_custkey + 1 AS total, o_orderkey % 7 AS workers,
   o_orderkey % 40 AS batch FROM orders),
q AS (SELECT *, greatest(batch, 1) AS unit, total // greatest(batch, 1) AS units,
   total % greatest(batch, 1) AS rest FROM p),
u AS (SELECT *, CASE WHEN unit > 1 THEN greatest(least(workers, units), 1)
   ELSE greatest(workers, 1) END AS used FROM q),
x AS (SELECT *, unnest(range(0, used)) AS worker FROM u),
y AS (SELECT job, worker, (units // used + CASE WHEN worker < units % used THEN 1 ELSE 0 END) * unit
   + CASE WHEN worker = used - 1 THEN rest ELSE 0 END AS n_rows FROM x)
SELECT job, worker, CAST(sum(n_rows) OVER (PARTITION BY job ORDER BY worker) - n_rows AS BIGINT)
   AS start_row, n_rows FROM y""",
)
def batch_alloc(spark, folder):
    jobs = read(spark, folder, "orders").selectExpr(
        "o_orderkey AS job", "o_custkey + 1 AS total", "o_orderkey % 7 AS workers",
        "o_orderkey % 40 AS batch",
    )
    return jobs.select(
        "job", F.inline(allocate(F.col("total"), F.col("workers"), F.col("batch")))
    )


VALUE_STATEMENTS = (
    "(SELECT p_partkey, concat(CASE p_partkey % 3 WHEN 0 THEN 'INSERT INTO t(id,name) VALUES (' "
    "WHEN 1 THEN 'insert into p values(' ELSE 'insert into q select (' END, "
    "CAST(p_partkey AS STRING), ', ''', p_name, ' (', p_brand, ')'')') AS stmt FROM part)"
)


@query(
    "values_split",
    "SELECT p_partkey, regexp_extract(stmt, '(?is)(.*VALUES\\s*)\\((.*)\\)', 1) AS prefix, "
    f"regexp_extract(stmt, '(?is)(.*VALUES\\s*)\\((.*)\\)', 2) AS body FROM {VALUE_STATEMENTS}",
)
def values_split(spark, folder):
    stmts = read(spark, folder, "part").selectExpr(
        "p_partkey",
        VALUE_STATEMENTS.split("p_partkey, ", 1)[1].split(" AS stmt FROM part")[0] + " AS stmt",
    )
    return stmts.select(
        "p_partkey", values_prefix(F.col("stmt")).alias("prefix"),
        values_tuple(F.col("stmt")).alias("body"),
    )


# ---------------------------------------------------------------- lists of statements


@query("stmt_sink", f"SELECT stmt FROM ({_mixed_check(5)})")
def stmt_sink(spark, folder):
    """Written as text lines, in emission order, and read back as they are."""
    path = shared_dir(spark, "statements")
    total = order_rows(spark, folder).count()
    write_statements(mixed_statements(spark, folder), path, total=total)
    return spark.read.text(path).withColumnRenamed("value", "stmt")


@query("stmt_source", f"SELECT rtrim(stmt, ';') AS stmt FROM ({_single_check(7)})")
def stmt_source(spark, folder):
    """Read back as statements, without the closing mark."""
    path = shared_dir(spark, "statements")
    write_statements(batch_assemble(spark, folder), path)
    return read_statements(spark, path)


@query("cache_reuse", _single_check(64))
def cache_reuse(spark, folder):
    """The second request finds the table the first one has written."""
    spec = WorkloadSpec.of(INSERT_LOAD, order_rows(spark, folder).count(), batch_size=64)
    path = shared_dir(spark, "cache")
    cached_statements(spark, spec, path)
    return cached_statements(spark, spec, path).drop("template_idx")


@query(
    "bulk_write",
    f"SELECT row_id, row_id + 100 AS id, {_int(1, 5, 90)} AS age FROM {ORDER_ROWS}",
)
def bulk_write_rows(spark, folder):
    """Appended by several writers and read back."""
    rows = _typed("INSERT INTO t(id, age) VALUES (<increment/100>, <int/5/90>)",
                  order_rows(spark, folder))
    path = shared_dir(spark, "rows")
    bulk_write(rows, path, threads=4)
    return spark.read.schema(rows.schema).parquet(path)



@query("stmt_count", f"SELECT count(*) AS n, CAST(sum(n_rows) AS BIGINT) AS n_rows FROM ({_mixed_check(5)})")
def stmt_count(spark, folder):
    return mixed_statements(spark, folder).agg(
        F.count(F.lit(1)).alias("n"), F.sum("n_rows").alias("n_rows")
    )


@query("stmt_preview", f"SELECT * FROM ({_mixed_check(5)}) ORDER BY pos LIMIT 3")
def stmt_preview(spark, folder):
    return preview(mixed_statements(spark, folder))


@query(
    "iterate",
    f"SELECT CAST(i AS INT) AS iteration, pos, batch_no, n_rows, stmt FROM ({_single_check(7)}), range(3) r(i)",
)
def iterate(spark, folder):
    return repeated(batch_assemble(spark, folder), 3)


@query(
    "together_union",
    f"SELECT 1 AS process_index, pos, batch_no, n_rows, stmt FROM ({_single_check(7)}) UNION ALL "
    f"SELECT 2, row_id, row_id, 1, 'update t set a = ' || ({c.key60(0, 0)} % 101 + 100) || "
    f"' where a = ' || ({c.key60(0, 1)} % 10 + 1) || ';' FROM {CUSTOMER_ROWS}",
)
def together_union(spark, folder):
    updates = single_statements(
        WorkloadSpec.of(UPDATE_LOAD, 1, process_index=2), customer_rows(spark, folder)
    ).drop("template_idx")
    return together({1: batch_assemble(spark, folder), 2: updates})


@query(
    "sweep_grid",
    """SELECT o_orderkey AS job, CAST(t AS INT) AS threads, CAST(b AS INT) AS batch_size FROM (
 SELECT o_orderkey, t, unnest(string_split(batches, ',')) AS b FROM (
  SELECT o_orderkey, unnest(string_split(threads, ',')) AS t, batches FROM (
   SELECT o_orderkey, concat('1,2,', CAST(4 + o_custkey % 5 AS STRING)) AS threads,
    CASE WHEN o_orderkey % 2 = 0 THEN '100,1000' ELSE '10' END AS batches FROM orders)))""",
)
def sweep_grid(spark, folder):
    """Every order asks for runs with several thread counts and batch sizes."""
    asked = read(spark, folder, "orders").selectExpr(
        "o_orderkey AS job",
        "concat('1,2,', CAST(4 + o_custkey % 5 AS STRING)) AS threads",
        "CASE WHEN o_orderkey % 2 = 0 THEN '100,1000' ELSE '10' END AS batches",
    )
    return swept(asked, "threads", "batches")
