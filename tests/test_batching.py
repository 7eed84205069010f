"""Batch structure, emission order, work split, ranks over blocks."""

import random
import re

import pytest
from pyspark.sql import functions as F

from weftload.operators.batching import allocate, assemble
from weftload.operators.blocks import rank_within, running_sum
from weftload.operators.mix import (
    CROWD,
    cell_of,
    choose_from_table,
    choose_template,
    cumulative_weights,
    range_cells,
    thresholds,
)
from weftload.plans.workload import repeated, row_ids, statements, together
from weftload.spec import WorkloadSpec, check_weights

# A mixed run of 100 operations in batches of 5 emits this many updates
# before each of its eight inserts (the last insert holds one row and comes last).
UPDATES_BEFORE_INSERT = [3, 5, 11, 14, 11, 10, 6, 4]


def test_emission_order_of_a_known_run(spark):
    ops = []
    for number, updates in enumerate(UPDATES_BEFORE_INSERT):
        rows = 5 if number < 7 else 1
        # A batch is due with its fifth row; earlier rows may lie among the updates.
        early = ["i"] * (rows - 1) if number < 7 else ["i"]
        ops += early + ["u"] * updates + (["i"] if number < 7 else [])
    assert len(ops) == 100
    rank, table = 0, []
    for row_id, kind in enumerate(ops):
        if kind == "i":
            table.append((row_id, 0, rank, "insert into t values", f"({rank + 1})"))
            rank += 1
    rows = spark.createDataFrame(
        table, "row_id long, template_idx int, rank long, prefix string, tuple string"
    )
    emitted = {r.pos: r for r in assemble(rows, 5, 100).collect()}
    emitted.update({i: None for i, kind in enumerate(ops) if kind == "u"})
    order = [emitted[p] for p in sorted(emitted)]
    assert len(order) == 72
    runs, current = [], 0
    for item in order:
        if item is None:
            current += 1
        else:
            runs.append((current, item.n_rows))
            current = 0
    assert [u for u, _ in runs] == UPDATES_BEFORE_INSERT
    assert [n for _, n in runs] == [5] * 7 + [1]
    assert sum(n for _, n in runs) == 36
    assert order[-1].stmt == "insert into t values(36);"


def test_mixed_batches(spark):
    spec = WorkloadSpec.of(
        ["insert into t values(<increment>, <int/1/10>)", "update t set a = <int/20/30>",
         "REPLACE INTO r VALUES(<increment/50>)"],
        400, weights=(0.3, 0.3, 0.4), batch_size=5,
    )
    rows = statements(spark, spec).orderBy("pos").collect()
    assert len({r.pos for r in rows}) == len(rows)
    for index, start in ((0, 1), (2, 50)):
        mine = [r for r in rows if r.template_idx == index]
        assert all(r.n_rows == 5 for r in mine[:-1])
        ids = [int(m) for r in mine for m in re.findall(r"\((\d+)", r.stmt)]
        assert ids == list(range(start, start + len(ids)))
    assert sum(r.n_rows for r in rows) == 400


def test_prefix_of_the_first_row(spark):
    spec = WorkloadSpec.of("insert into t<int/1/9> values(<increment>)", 50, batch_size=4)
    rows = statements(spark, spec).collect()
    assert len({r.stmt.split(" values")[0] for r in rows}) == 1
    assert sum(r.n_rows for r in rows) == 50


def test_even_and_weighted_shares(spark):
    total = 20_000
    for weights in ([0.5, 0.5], [0.1, 0.2, 0.7], [0.0, 1.0]):
        exact = check_weights(weights, len(weights))
        df = row_ids(spark, total).select(choose_template(42, F.col("row_id"), exact).alias("t"))
        counts = {r.t: r["count"] for r in df.groupBy("t").count().collect()}
        for index, weight in enumerate(weights):
            spread = 4 * (weight * (1 - weight) / total) ** 0.5
            assert abs(counts.get(index, 0) / total - weight) <= spread + 1e-9
    assert thresholds(check_weights([0.1] * 10, 10))[-1] == 1 << 60


@pytest.mark.parametrize("block", [1, 7, 1000])
def test_rank_over_blocks(spark, block):
    """One key has a third of all rows."""
    rng = random.Random(5)
    data = [(i, 0 if rng.random() < 0.34 else rng.randrange(1, 30)) for i in range(900)]
    df = spark.createDataFrame(data, "row_id long, k long")
    found = {r.row_id: r.rank for r in rank_within(df, ["k"], "row_id", rows=block).collect()}
    seen = {}
    for row_id, key in data:
        assert found[row_id] == seen.get(key, 0)
        seen[key] = seen.get(key, 0) + 1
    sums = running_sum(df.withColumn("v", F.col("row_id") % 5), ["k"], "row_id", "v", "s", block)
    got = {r.row_id: r.s for r in sums.collect()}
    acc = {}
    for row_id, key in data:
        acc[key] = acc.get(key, 0) + row_id % 5
        assert got[row_id] == acc[key]


def test_choice_from_a_table_with_a_heavy_template(spark):
    weights = [3, 0, 50, 1, 1, 1, 0, 44]
    templates = spark.createDataFrame(list(enumerate(weights)), "template_idx long, weight long")
    ranges = cumulative_weights(templates)
    draws = spark.range(sum(weights)).withColumnRenamed("id", "draw")
    found = choose_from_table(draws, ranges, sum(weights), len(weights))
    counts = {r.template_idx: r["count"] for r in found.groupBy("template_idx").count().collect()}
    assert counts == {i: w for i, w in enumerate(weights) if w}


def test_choice_among_one_heavy_and_many_light_templates(spark):
    """The heavy one has nearly all the weight, the light ones share one cell until it is cut."""
    light, heavy = 100_000, 10**12
    templates = spark.range(light + 1).select(
        F.col("id").alias("template_idx"), F.when(F.col("id") == 70_000, heavy).otherwise(1).cast("long").alias("weight")
    )
    ranges, total = cumulative_weights(templates), light + heavy
    listed, width, splits = range_cells(ranges, total, light + 1)
    assert listed.groupBy("_cell").count().agg(F.max("count")).first()[0] <= CROWD
    few = spark.range(0, total, total // 40_000).unionByName(spark.range(69_990, 70_010)).withColumnRenamed("id", "draw")
    found = {r.draw: r.template_idx for r in choose_from_table(few, ranges, total, light + 1).collect()}
    assert len(found) == few.distinct().count()
    for draw, index in found.items():
        assert index == (draw if draw < 70_000 else 70_000 if draw < 70_000 + heavy else draw - heavy + 1)
    tasks = cell_of(few, "draw", width, splits).repartition(16, "_cell").groupBy(F.spark_partition_id()).count()
    held = sorted(r["count"] for r in tasks.collect())
    assert held[-1] <= 2 * held[len(held) // 2]


@pytest.mark.parametrize(
    ("total", "workers", "batch", "expected"),
    [
        (10, 3, 1, [4, 3, 3]),
        (10, 1, 4, [10]),
        (23, 3, 5, [10, 5, 8]),
        (4, 3, 5, [4]),
        (20, 8, 5, [5, 5, 5, 5]),
        (2, 4, 1, [1, 1, 0, 0]),
        (7, 0, 0, [7]),
    ],
)
def test_allocation(spark, total, workers, batch, expected):
    row = spark.range(1).select(
        allocate(F.lit(total).cast("long"), F.lit(workers), F.lit(batch)).alias("a")
    ).first()
    assert [p.n_rows for p in row.a] == expected
    starts = [p.start_row for p in row.a]
    assert starts == [sum(expected[:i]) for i in range(len(expected))]


def test_repeat_and_together(spark):
    spec = WorkloadSpec.of("insert into t values(<increment>)", 4, batch_size=2)
    once = statements(spark, spec)
    again = repeated(once, 3).orderBy("iteration", "pos").collect()
    assert [r.stmt for r in again] == [r.stmt for r in once.orderBy("pos").collect()] * 3
    both = together({2: once, 1: once.limit(1).drop("batch_no")})
    assert {r.process_index: r["count"] for r in both.groupBy("process_index").count().collect()} == {1: 1, 2: 2}
