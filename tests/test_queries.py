"""Every registered query against its checking SQL on the smallest tables."""

import decimal
import math
from pathlib import Path

import pytest

import __spark_entry__ as entry

duckdb = pytest.importorskip("duckdb")
FOLDER = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def tool():
    con = duckdb.connect()
    for file in FOLDER.glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return value


def table(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, tool, name):
    df = entry.queries()[name](spark, str(FOLDER))
    rows = df.collect()
    assert rows
    check = entry.oracle_sql().get(name)
    if check is None:
        return
    result = tool.execute(check)
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    assert table(df.columns, rows) == table(names, result.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
