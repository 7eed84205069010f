"""What the optimizer makes of the queries: no all-pairs joins, no Python, small scans."""

import io
from contextlib import redirect_stdout
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from weftload.operators import percentiles
from weftload.operators.match import bulk_match
from weftload.operators.percentiles import exact_percentiles
from weftload.operators.replay import replay

FOLDER = Path("/root/testdata/sf0.001")
BATCH = sorted(n for n in entry.queries() if not n.startswith("stream_"))


def plan(df) -> str:
    text = io.StringIO()
    with redirect_stdout(text):
        df.explain("formatted")
    return text.getvalue()


@pytest.mark.skipif(not FOLDER.exists(), reason="no test tables")
@pytest.mark.parametrize("name", BATCH)
def test_no_all_pairs_and_no_python(spark, name):
    text = plan(entry.queries()[name](spark, str(FOLDER)))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "InPandas", "BatchEvalPython"):
        assert bad not in text, bad


def test_samples_are_joined_by_broadcast_and_pruned(spark, tmp_path, monkeypatch):
    """Each pass over the samples: few columns, null samples left out by the scan, picks broadcast by their size."""
    path = str(tmp_path / "ops")
    spark.range(5000).select(
        (F.col("id") % 3).alias("k"), (F.col("id") % 977 * 1.1).alias("v"), F.lit("wide").alias("pad")
    ).write.parquet(path)
    passes = []
    finer = percentiles._finer
    monkeypatch.setattr(percentiles, "_finer", lambda *a: passes.append(finer(*a)) or passes[-1])
    exact_percentiles(spark.read.parquet(path), ["k"], "v", [50, 99])
    assert passes
    for text in map(plan, passes):
        assert "SortMergeJoin" not in text and "BroadcastHashJoin" in text
        assert "pad" not in text
        assert "IsNotNull(v)" in text


def test_replay_combines_before_the_shuffle(spark):
    log = spark.range(100).select(
        F.col("id").alias("pos"), F.lit("update").alias("op"), F.lit(1).alias("id"), F.lit(1.0).alias("a")
    )
    text = plan(replay(log))
    assert "partial_max_by" in text and "Window" not in text and "Join" not in text


def test_match_has_no_all_pairs_join(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    queries = spark.createDataFrame([(1, "a")], "query_id long, text string")
    text = plan(bulk_match(docs, queries))
    assert "CartesianProduct" not in text and "NestedLoop" not in text
