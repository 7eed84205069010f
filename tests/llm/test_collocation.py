"""Collocations against plain counting."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weftload.llm import collocation as col

SCHEMA = "doc_id long, text string, lang string"


def brute(docs, threshold, longest, kept):
    counts, sizes = Counter(), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            sizes[lang] += len(words)
            for m in range(1, longest + 1):
                for i in range(len(words) - m + 1):
                    counts[lang, tuple(words[i : i + m])] += 1
    often = {k: n for k, n in counts.items() if n >= threshold}
    out = []
    for (lang, words), a in often.items():
        if len(words) < 2:
            continue
        longer = [(o, n) for (g, o), n in often.items() if g == lang and len(o) > len(words)]
        if any(n >= a and any(o[i : i + len(words)] == words for i in range(len(o))) for o, n in longer):
            continue
        cuts = [(1000 * a * sizes[lang] // (counts[lang, words[:k]] * counts[lang, words[k:]]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        out.append((lang, " ".join(words), a, counts[lang, words[:k]], counts[lang, words[k:]], sizes[lang], score))
    rows = []
    for lang in {r[0] for r in out}:
        best = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))[:kept]
        rows += [(lang, i, *r[1:]) for i, r in enumerate(best, 1)]
    return sorted(rows)


def verify(spark, docs, threshold=5, longest=5, kept=2000, clash=False, flush=col.FLUSH):
    df = spark.createDataFrame([(i, t, g) for i, (t, g) in enumerate(docs)], SCHEMA).repartition(4)
    if clash:
        df = df.withColumns({n: F.lit(1) for n in ("n", "phrase", "count", "score", "part", "rank", "a", "l", "r", "key", "salt")})
    found = col.collocations(df, threshold, longest, kept, flush)
    rows = sorted(tuple(r) for r in found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())
    assert rows == brute(docs, threshold, longest, kept)
    return rows


def sample(n, seed=1):
    rng = random.Random(seed)
    words = ["the", "of", "New", "york", "a", "b", "É", "x-y", "Zum", "word", "漢字", "q'r"]
    docs = []
    for i in range(n):
        parts = [rng.choice(words) if rng.random() < 0.7 else "New York is a city" for _ in range(rng.randrange(0, 30))]
        docs.append((rng.choice([" ", "  ", "\t"]).join(p + rng.choice(["", "", "", ".", ", ", "\n", "!x"]) for p in parts), rng.choice(["en", "en", "fr", None, "und", ""])))
    return docs


@pytest.mark.parametrize("tight", [False, True])
def test_phrases(spark, monkeypatch, tight):
    """In the tight form tasks give out their counts at once, over several hash partitions."""
    if tight:
        monkeypatch.setattr(col, "PART_BYTES", 2000)
    rows = verify(spark, sample(300), flush=100 if tight else col.FLUSH)
    assert len(rows) > 50 and {r[0] for r in rows} == {"en", "fr", "und", ""}


def test_limits(spark):
    verify(spark, sample(200, 2), threshold=3, longest=3, kept=7)
    verify(spark, sample(200, 3), threshold=4, longest=2, kept=1)


@pytest.mark.parametrize("clash", [False, True])
def test_odd_rows(spark, clash):
    docs = [(None, "en"), ("", "en"), (" \t ", None), ("...", "fr"), ("a b " * 20_000, "en"), ("w" * 100_000, "en"), ("a b", "en"), ("a b", "en")]
    docs += [("A B\x0bc d\xa0e", "en")] * 6 + [("a a a a a a", "de")] * 3
    verify(spark, docs, clash=clash)


def test_none(spark):
    assert col.collocations(spark.createDataFrame([], SCHEMA)).collect() == []
    assert col.collocations(spark.createDataFrame([(1, "a b c", "en")], SCHEMA)).collect() == []


def test_summaries_keep_every_frequent_key():
    """Whatever the order, a key with the threshold survives, and a summary holds no more than mass / threshold + 1 counters."""
    rng = np.random.default_rng(3)
    truth = Counter()
    rows = {"part": [], "mass": [], "keys": [], "counts": []}
    for _ in range(60):
        keys = np.concatenate([rng.integers(0, 2**63, 400, dtype=np.uint64), rng.integers(0, 200, 300, dtype=np.uint64) ** np.uint64(3)])
        held, counts = col.tallied(keys)
        for k, n in zip(held.tolist(), counts.tolist()):
            truth[k] += n
        rows["part"].append(0)
        rows["mass"].append(int(counts.sum()))
        rows["keys"].append(col.pressed(held))
        rows["counts"].append(col.interpolation.pressed(counts, "<u8"))
    found = col.survivors(pa.table(rows), 50)
    assert {k for k, n in truth.items() if n >= 50} <= set(found.tolist())
    assert len(found) <= sum(rows["mass"]) // 50 + 1 < len(truth)


def test_filter_holds_what_it_was_given(spark):
    keys = [(i * 0x9E3779B97F4A7C15) % 2**64 - 2**63 for i in range(1, 5000)]
    held = col.BitFilter.of(spark.createDataFrame([(k,) for k in keys], "key long").repartition(3))
    assert held.holds(np.array(keys, np.int64).view(np.uint64)).all()
    others = col.mix(np.arange(100_000, dtype=np.uint64), np.uint64(77))
    assert held.holds(others).mean() < 0.05


def test_scores_beyond_64_bits(spark):
    counts = [("en", 0, "", 4 * 10**18), ("en", 1, "a", 3 * 10**9), ("en", 1, "b", 2 * 10**9), ("en", 2, "a b", 10**9 + 7)]
    df = spark.createDataFrame(counts, "lang string, n_words int, phrase string, count long")
    (row,) = col.scored(df).collect()
    assert row.score == 1000 * (10**9 + 7) * 4 * 10**18 // (3 * 10**9 * 2 * 10**9)
