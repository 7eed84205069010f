"""Statement files, previews, the generated-data cache, bulk writes."""

from pathlib import Path
from types import SimpleNamespace

import pytest

from weftload.functions import patterns
from weftload.functions.patterns import Pattern
from weftload.plans.workload import row_ids, statements, typed_rows
from weftload.session import shared_dir
from weftload.sources.files import (
    bulk_write,
    cached_statements,
    content_of,
    more_than_preview,
    preview,
    read_statements,
    write_statements,
)
from weftload.sources.vocabulary import load_vocabulary
from weftload.spec import WorkloadSpec

SPEC = WorkloadSpec.of("insert into t values(<increment>, '<string/1/3>')", 103, batch_size=5)


@pytest.mark.parametrize("how", [{"in_order": True}, {"total": 103}, {}])
def test_statement_files_in_order(spark, tmp_path, how):
    stmts = statements(spark, SPEC)
    path = tmp_path / "out"
    write_statements(stmts if "in_order" in how else stmts.repartition(3), str(path), 4, **how)
    lines = [
        line for f in sorted(path.glob("part-*.txt")) for line in f.read_text().splitlines()
    ]
    assert lines == [r.stmt for r in stmts.orderBy("pos").collect()]
    assert all(line.endswith(");") for line in lines)
    back = read_statements(spark, str(path)).collect()
    assert sorted(r.stmt for r in back) == sorted(line[:-1] for line in lines)


def test_empty_lines_are_skipped(spark, tmp_path):
    (tmp_path / "a.txt").write_text("select 1;\r\n\n   \nselect 2\n")
    found = read_statements(spark, str(tmp_path)).collect()
    assert sorted(r.stmt for r in found) == ["select 1", "select 2"]


def test_preview(spark):
    stmts = statements(spark, SPEC)
    assert [r.batch_no for r in preview(stmts).collect()] == [0, 1, 2]
    assert more_than_preview(stmts) == 18


def test_cache_is_built_once_and_repaired(spark, tmp_path):
    first = cached_statements(spark, SPEC, str(tmp_path)).collect()
    (folder,) = tmp_path.iterdir()
    written = (folder / "_SUCCESS").stat().st_mtime_ns
    again = cached_statements(spark, SPEC, str(tmp_path)).collect()
    assert (folder / "_SUCCESS").stat().st_mtime_ns == written
    assert sorted(map(tuple, first)) == sorted(map(tuple, again))
    Path(folder / "_SUCCESS").unlink()
    cached_statements(spark, SPEC, str(tmp_path))
    assert (folder / "_SUCCESS").exists()


def test_cache_follows_the_words_of_a_file(spark, tmp_path):
    """A changed word builds a new table, in the literal and in the paged form; a changed thread count does not."""
    words, folder = tmp_path / "words.txt", tmp_path / "cache"
    for literal in (10, 0):
        seen = set()
        for text in ("one two three", "one two four", "one two three"):
            words.write_text(text)
            load = f"insert into t(x) values('<text/{{{words}}}/1/2>')"
            for threads in (1, 4):
                spec = WorkloadSpec.of(load, 20, batch_size=5, threads=threads)
                rows = cached_statements(spark, spec, str(folder / str(literal)), lambda p: load_vocabulary(spark, p, literal))
                seen.add(("four" in " ".join(r.stmt.lower() for r in rows.collect()), len(list((folder / str(literal)).iterdir()))))
        assert seen == {(False, 1), (True, 2), (False, 2)}


def test_cache_follows_custom_patterns():
    class Fixed(Pattern):
        def __init__(self, value):
            self.value = value

    specs = []
    for value in (1, 2):
        patterns._CUSTOM["fixed"] = lambda args, value=value: Fixed(value)
        try:
            specs.append(SPEC.fingerprint(content_of(WorkloadSpec.of("insert into t values(<fixed>)", 5))))
        finally:
            patterns._CUSTOM.clear()
    assert len(set(specs)) == 2


def test_bulk_write(spark, tmp_path):
    rows = typed_rows(SPEC, row_ids(spark, 103))
    path = str(tmp_path / "rows")
    bulk_write(rows, path, 3)
    bulk_write(rows, path, 3)
    assert spark.read.parquet(path).count() == 206
    assert len(list((tmp_path / "rows").glob("part-*"))) == 6


class StubSession:
    """Just the two settings that ``shared_dir`` looks at."""

    def __init__(self, folder, master):
        self.conf = {"spark.checkpoint.dir": folder} if folder else {}
        self.sparkContext = SimpleNamespace(master=master)


def test_shared_folder_follows_the_setting():
    found = shared_dir(StubSession("hdfs://shared/x/", "spark://host"), "a")
    assert found.startswith("hdfs://shared/x/weftload-a-")
    assert Path(shared_dir(StubSession(None, "local[2]"), "a")).parent.exists()
    with pytest.raises(RuntimeError):
        shared_dir(StubSession(None, "spark://host"), "a")
