"""The manifest against a plain tree, for all sizes around the runs and superblocks."""

import zlib
from hashlib import sha256

import duckdb
import pytest
from pyspark.sql import functions as F

from weftload.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def digest(text):
    return sha256(text.encode()).hexdigest()


def leaf_of(doc, text):
    parts = [doc[0], doc[3], doc[2], doc[4], text]
    return digest("".join("-" if p is None else f"{len(str(p).encode())}:{p}" for p in parts))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([digest("".join(out[-1][i : i + 8])) for i in range(0, len(out[-1]), 8)])
    return out


def path(tree, i):
    steps = []
    for nodes in tree[:-1]:
        run = i // 8 * 8
        steps.append(("".join(nodes[run:i]), "".join(nodes[i + 1 : run + 8])))
        i //= 8
    return steps


def brute(docs):
    """Sorted rows of (doc_id, leaf, subroot, root, proof, folded, verified)."""
    groups = {}
    for d in docs:
        groups.setdefault(d[2], []).append((d[0], leaf_of(d, d[1]), d))
    order = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in order:
        groups[lang].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        trees[lang] = levels([r[1] for r in groups[lang]])
    top = levels([trees[lang][-1][0] for lang in order])
    rows = []
    for k, lang in enumerate(order):
        for i, (doc_id, own, d) in enumerate(groups[lang]):
            steps = path(trees[lang], i) + path(top, k)
            text = d[1]
            if doc_id is not None and text is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            folded = leaf_of(d, text)
            for left, right in steps:
                folded = digest(left + folded + right)
            rows.append((doc_id, own, trees[lang][-1][0], top[-1][0], digest("".join(a + b for a, b in steps)), folded, folded == top[-1][0]))
    return sorted(rows, key=str)


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def verify(spark, docs, clash=False, levels=merkle.LEVELS):
    df = spark.createDataFrame(docs, SCHEMA).repartition(3)
    if clash:
        df = df.withColumns({n: F.lit(1) for n in ("tree", "idx", "n", "part", "block", "leaf", "claim", "row", "root")})
    found = merkle.tampered_manifest(df, levels)
    wanted = brute(docs)
    assert sorted((tuple(r) for r in found.select(COLUMNS).collect()), key=str) == wanted
    return wanted


def made(n, lang=lambda i: "en"):
    return [(i, f"Text {i} A" if i % 2 else f"text {i}", lang(i), f"s{i % 3}", i) for i in range(n)]


@pytest.mark.parametrize("levels", [1, merkle.LEVELS])
def test_several_languages(spark, levels):
    """With superblocks of eight nodes, trees take several sweeps."""
    sizes = {"a": 1, "b": 7, "c": 8, "d": 9, "é": 64, "e": 65, "": 73, None: 130, "B": 600, **{f"l{i}": 2 for i in range(12)}}
    docs, at = [], 0
    for lang, n in sizes.items():
        docs += made(at + n, lambda i, lang=lang: lang)[at:]
        at += n
    rows = verify(spark, docs, levels=levels)
    assert {r[6] for r in rows} == {True, False}


@pytest.mark.parametrize("clash", [False, True])
def test_odd_rows(spark, clash):
    docs = [
        (1, None, "en", None, None), (2, "", "en", "", 0), (3, "X" * 200_000, "en", "s", 3), (None, "A b", "en", "s", 1), (None, "A b", "en", "s", 1),
        (7, "Same", "fr", "s", 4), (7, "Same", "fr", "s", 4), (7, "Other", "fr", "s", 5), (-5, "Ä É ß", None, "漢", 5), (2**62, "Z", None, "s", 1),
    ]
    verify(spark, docs, clash)


def test_one_and_none(spark):
    verify(spark, made(1))
    assert merkle.tampered_manifest(spark.createDataFrame([], SCHEMA)).collect() == []


def test_levels_of_a_superblock():
    assert [merkle.levels_of(n) for n in (1, 2, 8, 9, 64, 65, 4096, 4097, 10**9)] == [0, 1, 1, 2, 2, 3, 4, 4, 4]


def test_whole_table_against_sql(spark):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    wanted = con.sql(f"SELECT {', '.join(COLUMNS)} FROM ({merkle.CHECK_SQL})").fetchall()
    found = merkle.tampered_manifest(spark.read.parquet(f"{folder}/documents.parquet")).select(COLUMNS)
    assert sorted((tuple(r) for r in found.collect()), key=str) == sorted(wanted, key=str)
