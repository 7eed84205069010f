"""Weighted choice of a template per row."""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftload.functions.draws import SPAN_LIMIT, key60
from weftload.functions.text import whole_div
from weftload.operators.blocks import BLOCK_ROWS, rank_within, running_sum
from weftload.session import written_table

MIX_TEMPLATE = -1
#: Cells of the draw space, at least, and ranges that one cell lists, at most.
LEAST_CELLS, CROWD = 1 << 14, 8
#: Cells in one array while cells are listed.
RUN_CELLS = 1 << 10


def thresholds(weights: Sequence[Fraction]) -> list[int]:
    """Upper bounds on the 60-bit draw; the last template takes what is left."""
    bounds, total = [], Fraction(0)
    for weight in weights:
        total += weight
        bounds.append(int(total * SPAN_LIMIT))
    bounds[-1] = SPAN_LIMIT
    return bounds


def mix_draw(seed: int, row_id: Column) -> Column:
    return key60(seed, MIX_TEMPLATE, row_id, 0)


def choose_template(seed: int, row_id: Column, weights: Sequence[Fraction]) -> Column:
    """Index of the first template whose cumulative weight reaches the draw."""
    bounds = thresholds(weights)
    if len(bounds) == 1:
        return F.lit(0)
    draw = mix_draw(seed, row_id)
    choice = F.when(draw <= bounds[0], F.lit(0))
    for index, bound in enumerate(bounds[1:-1], start=1):
        choice = choice.when(draw <= bound, F.lit(index))
    return choice.otherwise(F.lit(len(bounds) - 1))


def template_rank(df: DataFrame, rows: int = BLOCK_ROWS) -> DataFrame:
    """Each template has its own counter: the rank of a row within its template."""
    return rank_within(df, ["template_idx"], "row_id", "rank", rows)


def cumulative_weights(
    templates: DataFrame, index: str = "template_idx", weight: str = "weight"
) -> DataFrame:
    """Adds the half-open range [lo, hi) that an integer weight covers."""
    ranged = running_sum(templates, [], index, weight, "hi")
    return ranged.withColumn("lo", F.col("hi") - F.col(weight))


def _touched(first: Column, last: Column) -> tuple[Column, Column]:
    """Cells from ``first`` to ``last`` in two steps, so that no array is long: runs, then a run's cells."""
    runs = F.explode(F.sequence(whole_div(first, RUN_CELLS), whole_div(last, RUN_CELLS)))
    own = F.col("_run") * RUN_CELLS
    return runs, F.explode(F.sequence(F.greatest(first, own), F.least(last, own + RUN_CELLS - 1)))


def _listed(ranges: DataFrame, first: Column, last: Column) -> DataFrame:
    runs, cells = _touched(first, last)
    return ranges.withColumn("_run", runs).withColumn("_no", cells).drop("_run")


def range_cells(ranges: DataFrame, total: int, count: int) -> tuple[DataFrame, int, list[DataFrame]]:
    """Lists half-open ranges under the cells of [0, total) that they touch.

    Returns the listed ranges (with ``_cell``, its lower bound), the width of a cell, and the
    tables that cut crowded cells finer. Cells are counted, not assumed: one with more than
    CROWD ranges is cut again, until none is. A wide range lies in many cells, so the draws that
    hit it are spread; many narrow ranges share a cell only up to the bound.
    """
    width = max(1, -(-total // max(LEAST_CELLS, count // CROWD)))
    size = F.lit(width).cast("bigint")
    listed = _listed(ranges.where("hi > lo"), whole_div(F.col("lo"), width), whole_div(F.col("hi") - 1, width))
    listed = listed.withColumn("_cell", F.col("_no") * size).withColumn("_width", size).drop("_no")
    splits: list[DataFrame] = []
    while True:
        held = listed.groupBy(F.col("_cell").alias("_old"), F.col("_width").alias("_w")).agg(F.count(F.lit(1)).alias("_n"))
        parts = F.least(whole_div(F.col("_n"), CROWD) * 2, F.lit(RUN_CELLS).cast("bigint"))
        finer = F.greatest(F.call_function("div", F.col("_w"), parts), F.lit(1).cast("bigint"))
        crowded = written_table(held.where(f"_n > {CROWD} AND _w > 1").select("_old", finer.alias("_part")), "crowded")
        if crowded.isEmpty():
            return listed.drop("_width"), width, splits
        splits.append(crowded)
        joined = listed.join(crowded, F.col("_cell") == F.col("_old"), "left").drop("_old")
        first = F.greatest(F.col("lo"), F.col("_cell")) - F.col("_cell")
        last = F.least(F.col("hi") - 1, F.col("_cell") + F.col("_width") - 1) - F.col("_cell")
        cut = joined.where("_part IS NOT NULL")
        cut = _listed(cut, F.call_function("div", first, F.col("_part")), F.call_function("div", last, F.col("_part")))
        cut = cut.withColumn("_cell", F.col("_cell") + F.col("_no") * F.col("_part")).withColumn("_width", F.col("_part"))
        listed = joined.where("_part IS NULL").drop("_part").unionByName(cut.drop("_part", "_no"))
        listed = written_table(listed, "listed")


def cell_of(draws: DataFrame, draw: str, width: int, splits: Sequence[DataFrame]) -> DataFrame:
    """Adds the ``_cell`` of each draw: by division, then by equality with the cells that were cut."""
    keyed = draws.withColumn("_cell", whole_div(F.col(draw), width) * F.lit(width).cast("bigint"))
    for crowded in splits:
        inner = F.col(draw) - F.col("_cell")
        inner = F.call_function("div", inner, F.col("_part")) * F.col("_part")
        keyed = (
            keyed.join(crowded, F.col("_cell") == F.col("_old"), "left")
            .withColumn("_cell", F.col("_cell") + F.coalesce(inner, F.lit(0)))
            .drop("_old", "_part")
        )
    return keyed


def choose_from_table(
    draws: DataFrame, ranges: DataFrame, total: int, count: int, draw: str = "draw"
) -> DataFrame:
    """Range lookup of ``draw`` in [0, total) against ``lo``/``hi`` of a template table.

    A range join on an equality of cells (see ``range_cells``). Draws are uniform and no cell is
    wide, so no cell is hot, whatever share a single template has; a draw meets at most CROWD
    ranges. The sizes of the tables that are joined are known, so small ones are broadcast.
    """
    listed, width, splits = range_cells(ranges, total, count)
    inside = (F.col(draw) >= F.col("lo")) & (F.col(draw) < F.col("hi"))
    keyed = cell_of(draws, draw, width, splits)
    return keyed.join(listed, "_cell").where(inside).drop("_cell")


def mix_share(chosen: DataFrame) -> DataFrame:
    """Observed share of each template."""
    counted = chosen.groupBy("template_idx").agg(F.count(F.lit(1)).alias("n"))
    # One row per template is left: the window over all of them is bounded.
    total = F.sum("n").over(Window.partitionBy())
    return counted.withColumn("share", F.col("n") / total)
