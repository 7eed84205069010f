"""Merging rows into multi-row statements, and sharing rows out in whole batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftload.functions.text import whole_div

# Fixed value: how a statement is told apart into everything up to the tuple, and the tuple's inside.
VALUES_SPLIT = r"(?is)(.*VALUES\s*)\((.*)\)"


def values_prefix(statement: Column) -> Column:
    return F.regexp_extract(statement, VALUES_SPLIT, 1)


def values_tuple(statement: Column) -> Column:
    return F.regexp_extract(statement, VALUES_SPLIT, 2)


def batch_number(rank: Column, batch_size: int) -> Column:
    return whole_div(rank, batch_size)


def joined_tuples(rank: str = "rank", text: str = "tuple") -> Column:
    """Aggregate: the tuples of one batch in rank order, comma separated.

    A group holds at most ``batch_size`` rows, whatever the data.
    """
    ordered = F.array_sort(F.collect_list(F.struct(rank, text)))
    return F.array_join(F.transform(ordered, lambda x: x[text]), ",")


def assemble(rows: DataFrame, batch_size: int, total: int) -> DataFrame:
    """``(template_idx, rank, row_id, prefix, tuple)`` rows to batched statements.

    A full batch is emitted where its last row stands, leftovers after everything else
    in template order.
    """
    grouped = (
        rows.withColumn("batch_no", batch_number(F.col("rank"), batch_size))
        .groupBy("template_idx", "batch_no")
        .agg(
            F.count(F.lit(1)).cast("int").alias("n_rows"),
            F.max("row_id").alias("_last"),
            F.min("prefix").alias("_prefix"),
            joined_tuples().alias("_tuples"),
        )
    )
    full = F.col("n_rows") == batch_size
    return grouped.select(
        F.when(full, F.col("_last")).otherwise(F.col("template_idx") + total).alias("pos"),
        "template_idx",
        "batch_no",
        "n_rows",
        F.concat("_prefix", "_tuples", F.lit(";")).alias("stmt"),
    )


def first_rows(rows: DataFrame) -> DataFrame:
    """``(template_idx, row_id)`` of each template's first row.

    All batches of a template carry the prefix of that row. Only numbers are aggregated;
    the prefix is computed for the rows that are left.
    """
    return rows.groupBy("template_idx").agg(F.min("row_id").alias("row_id"))


def allocate(total: Column, workers: Column, batch: Column) -> Column:
    """Share ``total`` rows out: an array of ``(worker, start_row, n_rows)``.

    Whole batches are dealt evenly (earlier workers get the odd ones) and the short
    rest goes to the last worker. Without batching single rows are dealt.
    """
    one = F.lit(1).cast("bigint")
    unit = F.greatest(batch.cast("bigint"), one)
    units = F.call_function("div", total, unit)
    rest = total - units * unit
    used = F.greatest(F.least(workers.cast("bigint"), units), one)
    used = F.when(unit > 1, used).otherwise(F.greatest(workers.cast("bigint"), one))
    share = F.call_function("div", units, used)
    odd = units % used

    def part(worker: Column) -> Column:
        start = (worker * share + F.least(worker, odd)) * unit
        own = (share + F.when(worker < odd, one).otherwise(0)) * unit
        own = own + F.when(worker == used - 1, rest).otherwise(0)
        return F.struct(worker.alias("worker"), start.alias("start_row"), own.alias("n_rows"))

    return F.transform(F.sequence(F.lit(0).cast("bigint"), used - 1), part)
