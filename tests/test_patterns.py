"""Placeholders: parsing, ranges, and independence from partitioning."""

import re

import pytest
from pyspark.sql import functions as F

from weftload.functions.patterns import (
    Exact,
    Increment,
    Int,
    Pattern,
    String,
    Text,
    parse_pattern,
    register_pattern,
)
from weftload.functions.text import MARKS, Vocabulary, default_words
from weftload.plans.workload import row_ids, statements, typed_rows
from weftload.plans.workload import statements
from weftload.sources.vocabulary import (
    count_words,
    load_vocabulary,
    numbered_lines,
    text_from_pages,
    vocabulary_pages,
)
from weftload.spec import Template, WorkloadSpec

LOAD = (
    "INSERT INTO t(id, s, n, f, b) VALUES "
    "(<increment/7>, '<string/0/5>', <int/-3/3>, <float/-0.5/0.5>, <boolean>)"
)


def test_parse_known_and_unknown():
    assert parse_pattern("increment") == Increment(1)
    assert parse_pattern("increment/9") == Increment(9)
    assert parse_pattern("bigint/1/2") == Int(1, 2)
    assert parse_pattern("integer/1/2") == Exact("integer/1/2")
    assert String() == String(3, 10)
    assert (Text().low, Text().high) == (20, 300)


@pytest.mark.parametrize(
    "text", ["int/1", "string/5", "text/1/2/3", "array/1/2", "float/1", "int/9/1", "string/-1/3"]
)
def test_parse_errors(text):
    with pytest.raises(ValueError):
        parse_pattern(text)


def test_exact_is_quoted(spark):
    row = spark.range(1).select(Exact("in'te\\x").column(None)).first()
    assert row[0] == "'in\\'te\\\\x'"


def test_only_known_prefixes_are_placeholders():
    template = Template.compile("insert into t values(<increment>, <b>, <integer/1>, '<text/1/2>')")
    assert [p.text for p in template.placeholders] == ["increment", "integer/1", "text/1/2"]


def test_names_follow_the_column_list():
    template = Template.compile(LOAD)
    assert [p.name for p in template.placeholders] == ["id", "s", "n", "f", "b"]
    other = Template.compile("insert into t(a,b) values('<int/1/2> <int/1/3>', <int/1/4>)")
    assert [p.name for p in other.placeholders] == ["c1", "c2", "b"]


def test_ranges(spark):
    rows = typed_rows(WorkloadSpec.of(LOAD, 2000), row_ids(spark, 2000)).collect()
    assert sorted(r.id for r in rows) == list(range(7, 2007))
    assert all(re.fullmatch("[a-z]{0,5}", r.s) for r in rows)
    assert {len(r.s) for r in rows} == set(range(6))
    assert {r.n for r in rows} == set(range(-3, 4))
    assert all(-0.5 <= r.f <= 0.5 and round(r.f, 8) == r.f for r in rows)
    assert {r.b for r in rows} == {0, 1}


def test_arrays(spark):
    load = "insert into t(a, f) values([<array/0/4/10/12>], [<array_float/1/2/0.25/0.5>])"
    rows = typed_rows(WorkloadSpec.of(load, 1000), row_ids(spark, 1000)).collect()
    assert {len(r.a) for r in rows} == set(range(5))
    assert {v for r in rows for v in r.a} == {10, 11, 12}
    assert {len(r.f) for r in rows} == {1, 2}
    assert all(0.25 <= v <= 0.5 for r in rows for v in r.f)


def test_text_rules(spark):
    load = "insert into t(x) values('<text/0/12>')"
    rows = typed_rows(WorkloadSpec.of(load, 1500), row_ids(spark, 1500)).collect()
    known = set(default_words())
    marked = total = 0
    for row in rows:
        words = row.x.split(" ") if row.x else []
        assert len(words) <= 12
        for i, word in enumerate(words):
            bare = word.rstrip("".join(MARKS))
            starts = i == 0 or words[i - 1].endswith(".")
            assert bare[0].isupper() == starts
            assert bare.lower() in known
            if i < len(words) - 1:
                total += 1
                marked += bare != word
        if words:
            assert words[-1].endswith(".")
    assert abs(marked / total - 0.2) < 0.02
    assert any(r.x == "" for r in rows)


def test_draws_look_uniform(spark):
    """Chi-square over word numbers, and over pairs of neighbours."""
    words = Vocabulary(tuple("abcdefghij"))
    text = Text(50, 50, words)
    from weftload.functions.patterns import Slot

    slot = Slot(42, 0, 0, F.col("id"), F.col("id"))
    texts = spark.range(2000).select(text.column(slot).alias("t")).collect()
    drawn = [[w.strip(".!?,;").lower() for w in r.t.split(" ")] for r in texts]
    for pairs, cells in ((False, 10), (True, 100)):
        counts = {}
        for line in drawn:
            for i in range(len(line) - pairs):
                key = (line[i], line[i + 1]) if pairs else line[i]
                counts[key] = counts.get(key, 0) + 1
        total = sum(counts.values())
        expected = total / cells
        chi = sum((n - expected) ** 2 / expected for n in counts.values())
        assert len(counts) == cells
        assert chi < cells - 1 + 5 * (2 * (cells - 1)) ** 0.5


def test_increment_occurrences_count_from_the_right(spark):
    load = "insert into t values(<increment>, <increment>, <increment/1>)"
    rows = typed_rows(WorkloadSpec.of(load, 4), row_ids(spark, 4)).orderBy("row_id").collect()
    assert [(r.c1, r.c2, r.c3) for r in rows] == [(3, 2, 1), (6, 5, 4), (9, 8, 7), (12, 11, 10)]


@pytest.mark.parametrize("batch", [1, 7])
def test_same_result_for_any_partitioning(spark, batch):
    spec = WorkloadSpec.of(
        [LOAD, "select '<text/1/4>'", "replace into r(a) values([<array/0/3/1/9>], <increment>)"],
        300, weights=(0.5, 0.25, 0.25), batch_size=batch,
    )
    results = []
    for parts in (1, 3, 8):
        rows = spark.range(300).withColumnRenamed("id", "row_id").repartition(parts)
        found = statements(spark, spec, rows).orderBy("pos").collect()
        results.append([tuple(r) for r in found])
    assert results[0] == results[1] == results[2]


def test_dense_batches_equal_grouped_batches(spark):
    spec = WorkloadSpec.of(LOAD, 100, batch_size=8)
    dense = statements(spark, spec).orderBy("pos").collect()
    grouped = statements(spark, spec, row_ids(spark, 100)).orderBy("pos").collect()
    assert [tuple(r) for r in dense] == [tuple(r) for r in grouped]


def test_registered_pattern(spark):
    class Even(Pattern):
        def column(self, at):
            return at.row_id * 2

    register_pattern("even", lambda args: Even())
    try:
        rows = typed_rows(WorkloadSpec.of("insert into t(a) values(<even>)", 3), row_ids(spark, 3))
        assert sorted(r.a for r in rows.collect()) == [0, 2, 4]
    finally:
        from weftload.functions import patterns

        patterns._CUSTOM.clear()
    with pytest.raises(ValueError):
        register_pattern("int", lambda args: Even())


def test_vocabulary_file(spark, tmp_path):
    path = tmp_path / "words.txt"
    path.write_text("alpha, beta; beta\n(gamma) - \"delta\"\n\n")
    words = load_vocabulary(spark, str(path))
    assert words.words == ("alpha", "beta", "beta", "gamma", "delta")
    load = f"insert into t(x) values('<text/{{{path}}}/2/4>')"
    spec = WorkloadSpec.of(load, 200)
    rows = typed_rows(spec, row_ids(spark, 200), load_words=lambda p: load_vocabulary(spark, p))
    seen = {w.strip(".!?,;").lower() for r in rows.collect() for w in r.x.split(" ")}
    assert seen == {"alpha", "beta", "gamma", "delta"}
    empty = tmp_path / "empty.txt"
    empty.write_text(" .,; \n")
    with pytest.raises(ValueError):
        load_vocabulary(spark, str(empty))


def test_paged_vocabulary_with_one_huge_text(spark):
    """One text holds nearly all words and spans several pages."""
    big = " ".join(f"w{i}" for i in range(3000))
    texts = spark.createDataFrame([(0, "one two"), (1, big), (2, ""), (5, "last")], "id long, t string")
    pages = vocabulary_pages(texts, "id", "t")
    flat = [w for r in pages.orderBy("page").collect() for w in r.words]
    assert flat == ["one", "two", *big.split(), "last"]
    assert max(len(r.words) for r in pages.collect()) <= 1024
    assert count_words(pages) == 3003
    rows = spark.range(300).withColumnRenamed("id", "row_id")
    found = text_from_pages(rows, pages, 3003, 0, 5).collect()
    assert len(found) == 300
    assert {w.strip(".!?,;").lower() for r in found for w in r.text.split()} <= set(flat)
    assert all(r.text == "" or (r.text[0].isupper() and r.text.endswith(".")) for r in found)


@pytest.mark.parametrize("n", [1_999, 2_001, 2_700, 60_000])
def test_literal_and_paged_texts_are_the_same(spark, tmp_path, n):
    """One file of words, once as constants in the plan and once looked up in pages."""
    path = tmp_path / "words.txt"
    path.write_text("\n".join(" ".join(f"w{i}" for i in range(k, min(k + 7, n))) for k in range(0, n, 7)))
    load = f"insert into t(x, y) values('<text/{{{path}}}/0/9>', '<text/{{{path}}}/2/4>')"
    spec = WorkloadSpec.of(load, 300)

    def rows(literal):
        found = typed_rows(spec, row_ids(spark, 300), load_words=lambda p: load_vocabulary(spark, p, literal))
        return sorted(tuple(r) for r in found.collect())

    assert rows(n) == rows(0)


def test_statements_over_a_long_word_list(spark, tmp_path):
    """Mixed templates, batches, and a prefix that holds a looked-up text."""
    path = tmp_path / "words.txt"
    path.write_text(" ".join(f"w{i}" for i in range(5000)))
    loads = [f"insert into t(x) values('<text/{{{path}}}/1/3>')", f"insert into <text/{{{path}}}/1/1> values(<increment>)", f"select '<text/{{{path}}}/1/2>'"]
    spec = WorkloadSpec.of(loads, 200, weights="0.4,0.3,0.3", batch_size=3)

    def found(literal):
        stmts = statements(spark, spec, load_words=lambda p: load_vocabulary(spark, p, literal))
        return [tuple(r) for r in stmts.orderBy("pos").collect()]

    assert found(5000) == found(0)


def test_lines_are_numbered_across_files_and_pieces(spark, tmp_path):
    for part in range(3):
        (tmp_path / f"part-{part}").write_text("".join(f"{part} {i}\n" for i in range(500 - 200 * part)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        found = sorted((r.line_no, r.value) for r in numbered_lines(spark, str(tmp_path)).collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [v for _, v in found] == [f"{p} {i}" for p in range(3) for i in range(500 - 200 * p)]
    assert [n for n, _ in found] == list(range(len(found)))


def test_lines_stay_where_they_lie(spark, tmp_path):
    (tmp_path / "words").write_text("a b\nc\n")
    text = numbered_lines(spark, str(tmp_path))._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text


def test_pages_over_many_blocks(spark):
    """Long and short texts in several blocks; a page may lie in two of them."""
    rows = [(3 * i, " ".join(f"w{i}.{k}" for k in range(i % 23)) + (" and" * 3000 if i == 700 else "")) for i in range(1500)]
    pages = vocabulary_pages(spark.createDataFrame(rows, "id long, t string"), "id", "t").orderBy("page").collect()
    flat = [w for _, t in rows for w in t.replace(".", " ").split()]
    assert [w for r in pages for w in r.words] == flat
    twice = vocabulary_pages(spark.createDataFrame([(0, "a b"), (0, "a b"), (1, "")], "id long, t string"), "id", "t")
    assert [r.words for r in twice.collect()] == [["a", "b"] * 4]
    assert [r.page for r in pages] == list(range(len(pages))) and all(len(r.words) == 1024 for r in pages[:-1])


def test_rows_of_one_row_group_are_dealt_out(spark, tmp_path):
    from weftload.plans.generation_queries import customer_rows

    spark.range(20_000).withColumnRenamed("id", "c_custkey").coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    rows = customer_rows(spark, str(tmp_path))
    assert rows.rdd.getNumPartitions() > 1 and sorted(r.row_id for r in rows.collect()) == list(range(20_000))
