"""Ordered computations over keys that may hold most of the rows.

A window over a hot key sorts that key in one task. Here the order is cut into
blocks: work inside a block is a window over ``(key, block)``, and what a block
needs from the earlier ones comes from one small row per block. The big side is
shuffled once, on ``(key, block)``, which serves both the window and the join.

Blocks follow from counting, whatever the ids are like: cells as wide as the ids are apart
on average, then a finer cut of those cells that turn out to hold too many rows. The
rows per block are summed up the same way, in blocks of blocks, until few are left.
Keys and order columns must not be null; ids span less than 2^63.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftload.functions.text import whole_div
from weftload.session import written_table

BLOCK_ROWS = 1 << 17
#: Blocks that one task sums up; above that, blocks of blocks.
TREE_ROWS = 1 << 12
#: Parts of a cell in one finer cut.
MOST_PARTS = 1 << 10
#: Ids from which a task's worth of long values is made, and tasks for each core at most.
TASK_ROWS, TASKS_PER_CORE = 1 << 12, 16


def dealt_out(rows: DataFrame) -> DataFrame:
    """Narrow rows from which much is made, spread over all cores: a file may hold them all in one row group."""
    most = TASKS_PER_CORE * rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(max(1, min(-(-rows.count() // TASK_ROWS), most)))


def with_blocks(df: DataFrame, order: str, rows: int = BLOCK_ROWS) -> tuple[DataFrame, int]:
    """Adds ``_block``, rising with ``order``; gives the number of rows as well.

    A block holds at most ``2 * rows`` different ids. There are about as many blocks as
    rows / ``rows``, be the ids dense, far apart or in clusters.
    """
    at = F.col(order).cast("bigint")
    low, high, n = df.agg(F.min(at), F.max(at), F.count(at)).first()
    if not n:
        return df.withColumn("_block", F.lit(0).cast("bigint")), 0
    width = min(max(1, -(-(high - low + 1) * rows // n)), 1 << 62)
    offset = at - F.lit(low).cast("bigint")
    blocked = df.withColumn("_block", whole_div(offset, width) * F.lit(width).cast("bigint"))
    if width <= 2 * rows:  # unique ids: no cell can hold more
        return blocked, n
    blocked = blocked.withColumn("_width", F.lit(width).cast("bigint"))
    while True:
        held = blocked.groupBy("_block").agg(F.count(F.lit(1)).alias("_n"), F.max("_width").alias("_w"))
        wanted = F.least(whole_div(F.col("_n"), rows) + 1, F.lit(MOST_PARTS).cast("bigint"))
        finer = F.call_function("div", F.col("_w"), wanted)
        full = held.where(f"_n > {2 * rows} AND _w > 1").select(
            F.col("_block").alias("_cell"), F.greatest(finer, F.lit(1)).alias("_part")
        )
        full = written_table(full, "splits")
        if full.isEmpty():
            return blocked.drop("_width"), n
        part = F.coalesce("_part", "_width")
        inner = F.call_function("div", offset - F.col("_block"), part) * part
        blocked = (
            blocked.join(full, F.col("_block") == F.col("_cell"), "left")
            .withColumn("_block", F.col("_block") + inner)
            .withColumn("_width", part)
            .drop("_cell", "_part")
        )


def _before(totals: DataFrame, keys: list[str], names: list[str], blocks: int) -> DataFrame:
    """What lies before each block of a key, for each of ``names``."""
    if blocks <= TREE_ROWS:
        before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
        return totals.select(
            *keys, "_block", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_before{c}") for c in names]
        )
    upto = running_sums(
        written_table(totals.withColumnRenamed("_block", "_order"), "totals"),
        keys, "_order", {f"_upto{c}": c for c in names}, TREE_ROWS,
    )
    return upto.select(
        *keys, F.col("_order").alias("_block"),
        *[(F.col(f"_upto{c}") - F.col(c)).alias(f"_before{c}") for c in names],
    )


def running_sums(
    df: DataFrame, keys: Sequence[str], order: str, sums: Mapping[str, str], rows: int = BLOCK_ROWS,
    keep_block: bool = False,
) -> DataFrame:
    """Inclusive running sums by an integer column ``order``, unique within ``keys``: new column to summed one.

    With ``keep_block`` the column ``_block`` stays, by which (and ``keys``) the rows are dealt out.
    """
    keys = list(keys)
    blocked, n = with_blocks(df, order, rows)
    names = [f"_s{i}" for i in range(len(sums))]
    totals = blocked.groupBy(*keys, "_block").agg(*[F.sum(v).alias(s) for s, v in zip(names, sums.values())])
    before = _before(totals, keys, names, 2 * n // rows)
    local = (
        Window.partitionBy(*keys, "_block")
        .orderBy(order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    local_sums = {f"_local{s}": F.sum(v).over(local) for s, v in zip(names, sums.values())}
    joined = blocked.withColumns(local_sums).join(before, [*keys, "_block"])
    found = {out: F.col(f"_before{s}") + F.coalesce(F.col(f"_local{s}"), F.lit(0)) for s, out in zip(names, sums)}
    made = [*local_sums, *[f"_before{s}" for s in names]]
    return joined.withColumns(found).drop(*made if keep_block else ["_block", *made])


def running_sum(
    df: DataFrame, keys: Sequence[str], order: str, value: str, out: str, rows: int = BLOCK_ROWS
) -> DataFrame:
    """Inclusive running sum of ``value`` by a unique integer column ``order``."""
    return running_sums(df, keys, order, {out: value}, rows)


def rank_within(
    df: DataFrame, keys: Sequence[str], order: str, out: str = "rank", rows: int = BLOCK_ROWS
) -> DataFrame:
    """0-based rank by an integer column ``order``, unique within ``keys``."""
    counted = running_sums(df.withColumn("_one", F.lit(1).cast("bigint")), keys, order, {out: "_one"}, rows)
    return counted.withColumn(out, F.col(out) - 1).drop("_one")
