"""The stages of the pipeline: what goes, what stays, row by row."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as p
from weftload.llm import packing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
QUESTION = "which river of the northern plain carries the most water in the spring of a wet year. The long blue river"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Labels in which one word makes a text toxic, and a benchmark of one item."""
    root = tmp_path_factory.mktemp("tables")
    labels = [(i, 1, int(i % 4 == 0)) for i in range(200)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([(1, QUESTION)], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return str(root)


def table(spark, pairs, clash=False):
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in pairs], SCHEMA).repartition(3)
    return df.withColumns({n: F.lit(1) for n in ("component_id", "score", "_first", "_id", "key")}) if clash else df


def ids(df):
    return sorted((str(r.doc_id), str(r.text)) for r in df.collect())


def kept(pairs):
    return sorted((str(i), str(t)) for i, t in pairs)


def words(k, n=40):
    rng = random.Random(k)
    return " ".join(f"w{rng.randrange(997)}" for _ in range(n))


@pytest.mark.parametrize("clash", [False, True])
def test_copies_by_row(spark, folder, clash):
    """Of a group the smallest id stays, rows without one only if none has one; others are left alone."""
    near = words(9) + " tail"
    pairs = [(None, words(1)), (None, words(1)), (3, words(1)), (4, words(1)), (None, words(2)), (None, words(2)), (5, words(9)), (2, near), (7, words(11)), (7, words(12)), (8, ""), (9, ""), (None, None)]
    docs = table(spark, pairs, clash)
    found = p.keep_one_of_group(spark, docs, folder)
    assert found.columns == docs.columns
    assert ids(found) == kept([(3, words(1)), (None, words(2)), (2, near), (7, words(11)), (7, words(12)), (8, ""), (9, ""), (None, None)])


def test_leaks_by_row(spark, folder):
    leak = f"{words(3)} {QUESTION} {words(4)}"
    pairs = [(None, leak), (1, leak), (1, words(5)), (2, words(6)), (None, words(7)), (3, None), (4, "")]
    assert ids(p.drop_leaks(spark, table(spark, pairs), folder)) == kept(pairs[2:])


def test_toxic_by_row(spark, folder):
    """Labelled texts teach the word; rows without id, and rows that share one, are judged by their own text."""
    taught = [(i, f"{words(i, 12)} {'vilewordx vilewordy' if i % 4 == 0 else 'fine'}") for i in range(200)]
    more = [(None, f"{words(301, 12)} vilewordx vilewordy"), (500, f"{words(302, 12)} vilewordx vilewordy"), (500, f"{words(303, 12)} fine"), (None, f"{words(304, 12)} fine")]
    found = ids(p.drop_toxic(spark, table(spark, taught + more), folder))
    assert found == kept([(i, t) for i, t in taught + more if "vileword" not in t])


def test_whole_run(spark, folder, tmp_path):
    """All stages in their order; each id of what is left lies in one piece."""
    secret = "password = Zk9fQ2mP7sLx01vB"
    pairs = [(i, f"{words(i, 60)} fine") for i in range(200)] + [(300, f"{words(7, 60)} fine"), (301, f"{words(400)} {QUESTION}"), (302, f"{words(401)} {secret}")]
    table(spark, pairs).write.parquet(str(tmp_path / "documents.parquet"))
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    assert [name for name, _ in p.STAGES] == ["toxicity", "near_duplicates", "decontamination", "secrets", "packing"]
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in p.STAGES[1:-1]:
        docs = p.written_table(stage(spark, docs, str(tmp_path)), name)
    left = {r.doc_id: r.text for r in docs.collect()}
    assert 300 not in left and 301 not in left and set(range(200)) <= set(left)
    assert "Zk9fQ2mP7sLx01vB" not in left[302] and left[302].startswith(words(401))
    rows = p.pack_windows(spark, docs, str(tmp_path)).collect()
    assert {r.doc_id for r in rows} == set(left)
    assert all(sum(r.length for r in rows if r.doc_id == d) == next(r.doc_tokens for r in rows if r.doc_id == d) for d in list(left)[:20])
    assert max(r.offset + r.length for r in rows) <= packing.WINDOW


def test_files_are_not_written_again(spark, folder, tmp_path, monkeypatch):
    """Rows of whole files are known by their places; what leaves out or repeats rows of files is written with keys."""
    labels = []
    monkeypatch.setattr(p, "written_table", lambda df, label, f=p.written_table: labels.append(label) or f(df, label))
    pairs = [(None, words(1)), (None, words(1)), (3, words(1)), (6, f"{words(2)} {QUESTION}"), (7, words(3)), (7, words(4)), (None, "")]
    table(spark, pairs).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    assert len(docs.inputFiles()) > 1
    rows = p.keyed(docs)
    assert rows.columns == [*docs.columns, p.ROW] and rows.select(p.ROW).distinct().count() == len(pairs) == rows.count()
    assert ids(p.keep_one_of_group(spark, docs, folder)) == kept(pairs[2:])
    assert ids(p.drop_leaks(spark, docs, folder)) == kept(pairs[:3] + pairs[4:])
    assert "files" in labels and "keyed" not in labels
    twice = docs.crossJoin(spark.range(2).select(F.col("id").alias("n")))
    for some in (twice, docs.where("doc_id IS NULL OR doc_id > 3"), docs.union(docs)):
        rows = p.keyed(some)
        assert labels[-1] == "keyed" and rows.select(p.ROW).distinct().count() == some.count()


def test_empty(spark, folder):
    docs = table(spark, []).limit(0)
    for _, stage in p.STAGES[1:]:
        assert stage(spark, docs, folder).collect() == []
