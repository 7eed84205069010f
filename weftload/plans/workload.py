"""From a spec to rows and statements."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftload.functions.text import PagedVocabulary, Vocabulary, lookup_name
from weftload.operators.batching import assemble, first_rows
from weftload.operators.blocks import BLOCK_ROWS
from weftload.operators.mix import choose_template, template_rank
from weftload.sources.vocabulary import text_from_pages
from weftload.spec import Template, WorkloadSpec

Loader = Callable[[str], Vocabulary | PagedVocabulary] | None


ROWS_PER_TASK = 1_000_000


def _tasks(spark: SparkSession, total: int) -> int:
    """Enough tasks to use every core, and to keep the output of one task moderate."""
    return max(spark.sparkContext.defaultParallelism, -(-total // ROWS_PER_TASK))


def row_ids(spark: SparkSession, total: int) -> DataFrame:
    """The row source: ids 0..total-1."""
    ids = spark.range(0, total, 1, _tasks(spark, total))
    return ids.withColumnRenamed("id", "row_id")


def numbered(
    spec: WorkloadSpec,
    rows: DataFrame,
    templates: list[Template],
    block_rows: int = BLOCK_ROWS,
    always: bool = False,
) -> DataFrame:
    """``row_id`` to ``(row_id, template_idx, rank)``.

    Only these three numbers are shuffled; values are computed after it. One template
    needs no shuffle if the ids are 0, 1, 2 and so on: the rank is the id.
    """
    chosen = rows.select(
        "row_id", choose_template(spec.seed, F.col("row_id"), spec.exact_weights())
        .alias("template_idx"),
    )
    batching = spec.batch_size > 1 and any(t.batchable for t in templates)
    if not (always or batching or any(t.needs_rank for t in templates)):
        return chosen.withColumn("rank", F.col("row_id"))
    if len(templates) == 1:
        low, high, n = rows.agg(F.min("row_id"), F.max("row_id"), F.count("row_id")).first()
        if not n or (low, high) == (0, n - 1):
            return chosen.withColumn("rank", F.col("row_id"))
    return template_rank(chosen, block_rows)


def looked_up(spec: WorkloadSpec, rows: DataFrame, templates: list[Template]) -> DataFrame:
    """The first phase of texts over long word lists: a column for each, joined by row id."""
    for index, template in enumerate(templates):
        for slot, text in template.lookups.items():
            own = rows.where(F.col("template_idx") == index).select("row_id")
            words = text.vocabulary
            texts = text_from_pages(own, words.pages, words.size, text.low, text.high, spec.seed, index, slot)
            rows = rows.join(texts.withColumnRenamed("text", lookup_name(index, slot)), "row_id", "left")
    return rows


def typed_rows(
    spec: WorkloadSpec, rows: DataFrame, index: int = 0, load_words: Loader = None
) -> DataFrame:
    """Rows of one template as typed columns, named after its INSERT column list."""
    templates = spec.templates(load_words)
    base = numbered(spec, rows, templates, always=True)
    if len(templates) > 1:
        base = base.where(F.col("template_idx") == index)
    base = looked_up(spec, base, templates)
    return base.select(
        "row_id", "rank",
        *templates[index].values(spec.seed, index, F.col("row_id"), F.col("rank")),
    )


def _per_template(templates: list[Template], build: Callable[[int, Template], Column | None]):
    """One lazily evaluated branch per template."""
    if len(templates) == 1:
        return build(0, templates[0])
    choice = None
    for index, template in enumerate(templates):
        column = build(index, template)
        if column is None:
            continue
        test = F.col("template_idx") == index
        choice = F.when(test, column) if choice is None else choice.when(test, column)
    return choice


def single_statements(
    spec: WorkloadSpec, rows: DataFrame, load_words: Loader = None
) -> DataFrame:
    """One statement per row."""
    templates = spec.templates(load_words)
    base = looked_up(spec, numbered(spec, rows, templates), templates)
    row_id, rank = F.col("row_id"), F.col("rank")
    stmt = _per_template(templates, lambda i, t: t.statement(spec.seed, i, row_id, rank))
    return base.select(
        row_id.alias("pos"),
        "template_idx",
        rank.alias("batch_no"),
        F.lit(1).alias("n_rows"),
        F.concat(F.regexp_replace(stmt, r"[;\s]+$", ""), F.lit(";")).alias("stmt"),
    )


def batched_statements(
    spec: WorkloadSpec, rows: DataFrame, load_words: Loader = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Rows of INSERT/REPLACE templates merged per template, others passed through."""
    templates = spec.templates(load_words)
    for template in templates:
        if template.batchable:
            template.require_tuple()
    base = looked_up(spec, numbered(spec, rows, templates, block_rows), templates)
    row_id, rank = F.col("row_id"), F.col("rank")
    merged = [i for i, t in enumerate(templates) if t.batchable]
    parts = []
    if merged:
        inserts = base if len(merged) == len(templates) else base.where(
            F.col("template_idx").isin(merged)
        )
        prefix = _per_template(
            templates,
            lambda i, t: t.prefix_text(spec.seed, i, row_id, rank) if t.batchable else None,
        )
        tuples = _per_template(
            templates,
            lambda i, t: t.tuple_text(spec.seed, i, row_id, rank) if t.batchable else None,
        )
        texts = inserts.select(
            "row_id", "template_idx", "rank", prefix.alias("prefix"), tuples.alias("tuple")
        )
        if not all(templates[i].constant_prefix for i in merged):
            first = first_rows(inserts).withColumn("rank", F.lit(0).cast("bigint"))
            first = looked_up(spec, first, templates)
            # One row per template of the spec: the broadcast is bounded by its length.
            prefixes = F.broadcast(first.select("template_idx", prefix.alias("prefix")))
            texts = texts.drop("prefix").join(prefixes, "template_idx")
        beyond = (rows.agg(F.max("row_id")).first()[0] or 0) + 1
        parts.append(assemble(texts, spec.batch_size, max(spec.total, beyond)))
    if len(merged) < len(templates):
        others = base if not merged else base.where(~F.col("template_idx").isin(merged))
        stmt = _per_template(
            templates,
            lambda i, t: None if t.batchable else t.statement(spec.seed, i, row_id, rank),
        )
        parts.append(
            others.select(
                row_id.alias("pos"),
                "template_idx",
                rank.alias("batch_no"),
                F.lit(1).alias("n_rows"),
                F.concat(F.regexp_replace(stmt, r"[;\s]+$", ""), F.lit(";")).alias("stmt"),
            )
        )
    return reduce(DataFrame.unionByName, parts)


def dense_batches(
    spark: SparkSession, spec: WorkloadSpec, load_words: Loader = None
) -> DataFrame:
    """Batches of one template without a shuffle: a task writes its batches whole.

    Values are functions of the row number, so a batch can be built from its number
    alone: the rows of a batch are an array expression inside one output row.
    """
    (template,) = spec.templates(load_words)
    if not template.constant_prefix:
        raise ValueError("the prefix depends on the row; use batched_statements")
    size, total = spec.batch_size, spec.total
    first = F.col("batch_no") * size
    last = F.least(first + size, F.lit(total)) - 1
    tuples = F.transform(
        F.sequence(first, last), lambda r: template.tuple_text(spec.seed, 0, r, r)
    )
    prefix = template.prefix_text(spec.seed, 0, F.lit(0), F.lit(0))
    count = (last - first + 1).cast("int")
    batches = spark.range(0, -(-total // size), 1, _tasks(spark, total))
    return batches.withColumnRenamed("id", "batch_no").select(
        F.when(count == size, last).otherwise(F.lit(total)).alias("pos"),
        F.lit(0).alias("template_idx"),
        "batch_no",
        count.alias("n_rows"),
        F.concat(prefix, F.array_join(tuples, ","), F.lit(";")).alias("stmt"),
    )


def statements(
    spark: SparkSession,
    spec: WorkloadSpec,
    rows: DataFrame | None = None,
    load_words: Loader = None,
) -> DataFrame:
    """All statements of a spec: ``(pos, template_idx, batch_no, n_rows, stmt)``.

    ``rows`` may bring its own ``row_id`` column; ids are unique and not negative, gaps do not matter.
    """
    templates = spec.templates(load_words)
    batching = spec.batch_size > 1 and any(t.batchable for t in templates)
    plain = rows is None and len(templates) == 1 and not templates[0].lookups
    if batching and plain and templates[0].constant_prefix:
        return dense_batches(spark, spec, load_words)
    source = row_ids(spark, spec.total) if rows is None else rows.select("row_id")
    if batching:
        return batched_statements(spec, source, load_words)
    return single_statements(spec, source, load_words)


def repeated(stmts: DataFrame, iterations: int) -> DataFrame:
    """The whole list again and again, verbatim; order by ``(iteration, pos)``."""
    return stmts.withColumn("iteration", F.explode(F.sequence(F.lit(0), F.lit(iterations - 1))))


def together(parts: dict[int, DataFrame]) -> DataFrame:
    """Workloads side by side, tagged by process."""
    tagged = [df.withColumn("process_index", F.lit(i)) for i, df in sorted(parts.items())]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
