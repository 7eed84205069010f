"""The mixture against plain loops."""

import hashlib
import re
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from weftload.llm import mixture

SCHEMA = "doc_id long, source string, text string"


def targets(sizes, weights=(5, 2, 1)):
    """Shares by rounds: whatever is above its limit is cut and the excess shared again by weight."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    whole, full = sum(sizes.values()), set()
    while True:
        left = whole - sum(3 * sizes[s] for s in full)
        share = sum(weight[s] for s in order if s not in full)
        found = {s: Fraction(3 * sizes[s]) if s in full else Fraction(left * weight[s], share) for s in order}
        above = {s for s in order if s not in full and found[s] > 3 * sizes[s]}
        if not above:
            return found
        full |= above


def brute(docs):
    rows = [(d, s, len(re.findall(r"[^\x20\x09-\x0D]+", t or "")), hashlib.md5(f"{'-' if d is None else d}:{t or ''}".encode()).hexdigest()) for d, s, t in docs]
    sizes = {}
    for _, s, n, _ in rows:
        sizes[s] = sizes.get(s, 0) + n
    found, out = targets(sizes), []
    for source, target in found.items():
        budget, before = int(target), 0
        epochs = budget // sizes[source] if sizes[source] else 0
        rest = budget - epochs * sizes[source]
        for d, _, n, _ in sorted((r for r in rows if r[1] == source), key=lambda r: (r[3], r[0] is not None, r[0])):
            out.append((d, source, n, sizes[source], float(target), epochs * n + max(min(rest - before, n), 0)))
            before += n
    return sorted(out, key=str)


def verify(spark, docs, clash=False, parts=3):
    df = spark.createDataFrame(docs, SCHEMA).repartition(parts)
    if clash:
        df = df.withColumns({n: F.lit(1) for n in ("size", "key", "range", "part", "place", "weight", "target", "budget", "n_rows")})
    found = mixture.mix_documents(df).select("doc_id", "source", "size", "source_size", "target", "taken").collect()
    wanted = brute(docs)
    got = sorted((tuple(r) for r in found), key=str)
    assert [r[:4] + r[5:] for r in got] == [r[:4] + r[5:] for r in wanted]
    assert [r[4] for r in got] == pytest.approx([r[4] for r in wanted])
    for source in {r[1] for r in got}:
        own = [r for r in got if r[1] == source]
        assert abs(sum(r[5] for r in own) - own[0][4]) < 1 and all(r[5] <= 3 * r[2] for r in own)
    return got


@pytest.mark.parametrize("range_rows", [8, 1 << 12])
def test_sources(spark, monkeypatch, range_rows):
    """One source holds most rows; small ones reach their limit and the others share what they leave."""
    monkeypatch.setattr(mixture, "RANGE_ROWS", range_rows)
    docs = [(i, "big" if i % 10 < 7 else f"s{i % 23}", " ".join(["w"] * (i * 7919 % 40))) for i in range(1200)]
    rows = verify(spark, docs, parts=5)
    assert {r[4] == 3 * r[3] for r in rows} == {True, False}


def test_all_sources_at_their_limit_but_one(spark):
    verify(spark, [(i, s, "a " * n) for i, (s, n) in enumerate([("a", 1), ("b", 1), ("c", 10_000), ("d", 2)])])


@pytest.mark.parametrize("clash", [False, True])
def test_odd_rows(spark, clash):
    docs = [
        (1, "a", None), (2, "a", ""), (3, "a", " \t\n\x0b\x0c\r "), (4, None, "x y"), (4, None, "x y"), (None, "b", "p q r"), (None, "b", "p"),
        (5, "é", "a\xa0b　c d"), (6, "z", "w " * 50_000), (7, "", "one"), (8, "no words", ""), (9, "𝄞", "u v"), (10, "ﬀ", "u v"),
    ]
    verify(spark, docs, clash)


def test_reruns_and_partitions_agree(spark):
    docs = [(i, f"s{i % 4}", f"w{i} x y"[: 3 + i % 9]) for i in range(300)]
    one = mixture.mix_documents(spark.createDataFrame(docs, SCHEMA).repartition(7)).collect()
    two = mixture.mix_documents(spark.createDataFrame(docs[::-1], SCHEMA).coalesce(1)).collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, two))


def test_none_and_no_words(spark):
    assert mixture.mix_documents(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = mixture.mix_documents(spark.createDataFrame([(1, "a", ""), (2, None, None)], SCHEMA)).collect()
    assert {(r.doc_id, r.size, r.target, r.taken) for r in rows} == {(1, 0, 0.0, 0), (2, 0, 0.0, 0)}


def test_main_path_is_native(spark):
    df = mixture.mix_documents(spark.createDataFrame([(1, "a", "b")], SCHEMA))
    plan = df._jdf.queryExecution().toString()
    assert not any(bad in plan for bad in ("Python", "Arrow", "Pandas", "CartesianProduct", "NestedLoop"))
