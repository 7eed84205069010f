"""Checks of weights and run parameters, sweeps, fingerprints."""

import pytest
from pyspark.sql import functions as F

from weftload.functions.statements import script_parts, weights_error
from weftload.spec import Template, WorkloadSpec, fingerprint_column, with_defaults

TWO = ["insert into t values(<increment>)", "update t set a = <int/1/2>"]


@pytest.mark.parametrize(
    ("weights", "message"),
    [
        ("1,3", "cannot total more than 1"),
        ("0.2,0.9", "cannot total more than 1"),
        ("0.2,0.7,0.1", "must have 2 values"),
        ("0.2,-0.7", "cannot be negative"),
        ("0.2,0.7", "without a template"),
        ("0.2,x", "a weight that is no number"),
    ],
)
def test_weight_errors(weights, message):
    with pytest.raises(ValueError, match=message):
        WorkloadSpec.of(TWO, 10, weights=weights)


def test_weights_are_ignored_for_one_template():
    WorkloadSpec.of(TWO[:1], 10, weights="3,4")


def test_weight_errors_as_a_column(spark):
    texts = ["0.3,0.7", "1,3", "0.2,0.7,0.1", "0.2,-0.7", "0.2,0.7", "0.2,x", ",", "0.3333333,0.6666667"]
    df = spark.createDataFrame([(t,) for t in texts], "w string")
    found = [r[0] for r in df.select(weights_error(F.col("w"), F.lit(2))).collect()]
    assert found == [
        None, "total above 1", "wrong number of values", "negative value", "total is not 1",
        "invalid value", "invalid value", None,
    ]


@pytest.mark.parametrize(
    "options",
    [{"total": 0}, {"iterations": 0}, {"threads": "0"}, {"threads": "2,-1"}, {"batch_size": 0}],
)
def test_run_parameters(options):
    options = {"total": 5, **options}
    with pytest.raises(ValueError, match="process 3"):
        WorkloadSpec.of(TWO[0], process_index=3, **options)
    with pytest.raises(ValueError):
        WorkloadSpec.of("", 5)


def test_sweep_order():
    spec = WorkloadSpec.of(TWO[0], 5, threads="1,2", batch_size="10,20")
    assert [(s.threads[0], s.batch_size) for s in spec.sweep()] == [(1, 10), (1, 20), (2, 10), (2, 20)]


def test_fingerprint():
    base = WorkloadSpec.of(TWO[0], 5, batch_size=2)
    assert base.fingerprint() == WorkloadSpec.of(TWO[0], 5, batch_size=2, threads=9).fingerprint()
    assert base.fingerprint() != WorkloadSpec.of(TWO[0], 5, batch_size=2, seed=1).fingerprint()
    assert base.fingerprint() != base.fingerprint({"/w.txt": "digest"})


def test_fingerprint_in_columns(spark):
    """Parameters in columns have the identity of the spec they make."""
    specs = [WorkloadSpec.of(TWO[0], 5, batch_size=2), WorkloadSpec.of(TWO[0], 7, batch_size="1,30", init='say "é"')]
    df = spark.createDataFrame(
        [(list(s.load), s.total, list(s.batch_sizes), s.init) for s in specs],
        "load array<string>, total long, batch_sizes array<int>, init string",
    )
    columns = {c: F.col(c) for c in df.columns}
    assert [r.f for r in df.select(fingerprint_column(columns).alias("f")).collect()] == [s.fingerprint() for s in specs]


def test_defaults():
    got = with_defaults({"threads": 3, "total": None}, {"total": 9, "host": "x"}, {"total": 1, "threads": 1, "delay": 0})
    assert got == {"total": 9, "threads": 3, "delay": 0}


def test_batching_needs_a_tuple(spark):
    from weftload.plans.workload import statements

    spec = WorkloadSpec.of("insert into t select <int/1/2>", 5, batch_size=2)
    with pytest.raises(ValueError, match="VALUES"):
        statements(spark, spec)
    with pytest.raises(ValueError, match="after the VALUES"):
        Template.compile("insert into t values(<int/1/2>) on duplicate key update a = 1")


def test_script_with_many_quotes(spark):
    """Neither length nor the number of quotes may overflow the regex engine's stack."""
    text = "select " + "'a;b' " * 30_000 + "; select \"c;d\" ;; update x"
    parts = spark.createDataFrame([(text,)], "s string").select(script_parts(F.col("s"))).first()[0]
    assert len(parts) == 3
    assert parts[1:] == ['select "c;d"', "update x"]
