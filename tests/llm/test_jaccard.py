import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftload.llm import jaccard_tree as jt


def shingles(text, n):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1)))


def brute(pairs, n, percent):
    """Components over all pairs of sets that share a shingle."""
    sets = [shingles(t, n) for _, t in pairs]
    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            holders[g].append(i)
    up = list(range(len(sets)))

    def root(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for i, s in enumerate(sets):
        counts = defaultdict(int)
        for g in s:
            for j in holders[g]:
                if j < i:
                    counts[j] += 1
        for j, c in counts.items():
            if 100 * c >= percent * (len(s) + len(sets[j]) - c):
                up[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(pairs):
        if doc is not None:
            least[root(i)] = min(least.get(root(i), doc), doc)
    return sorted(((doc, len(s), least.get(root(i))) for i, ((doc, _), s) in enumerate(zip(pairs, sets))), key=str)


def verify(df, pairs, n=4, percent=85, **more):
    assert sorted((tuple(r) for r in jt.jaccard_components(df, n, percent, **more).collect()), key=str) == brute(pairs, n, percent)


def test_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    verify(docs, [(d.doc_id, d.text) for d in docs.collect()])


def made(rnd, groups, copies, size, edits):
    texts = []
    for _ in range(groups):
        base = [f"w{rnd.randrange(5000)}" for _ in range(rnd.randint(*size))]
        for _ in range(copies):
            new = list(base)
            for _ in range(rnd.randint(0, edits)):
                at = rnd.randrange(len(new))
                new[at : at + rnd.randint(0, 2)] = [f"w{rnd.randrange(5000)}"]
            texts.append(" ".join(new))
    rnd.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("case", [(40, 6, (20, 60), 3), (60, 5, (2, 12), 2), (3, 120, (60, 90), 4)])
def test_near_copies(documents, case):
    pairs = made(random.Random(sum(case[:2])), *case)
    verify(documents(pairs), pairs)


def test_parts_lose_no_pair():
    """Sets of few elements, where every element counts."""
    rng = np.random.default_rng(6)
    for percent in (80, 85):
        parts = jt.Parts(percent)
        for _ in range(6000):
            a = np.unique(rng.integers(0, 2**63, rng.integers(1, 24)).astype(np.uint64))
            b = np.unique(np.concatenate([a[rng.random(len(a)) > 0.08], rng.integers(0, 2**63, rng.integers(0, 3)).astype(np.uint64)]))
            if len(b) and 100 * len(np.intersect1d(a, b)) >= percent * len(np.union1d(a, b)):
                assert len(np.intersect1d(parts.keys(a), parts.keys(b)))


def test_large_cluster_in_blocks(documents):
    pairs = made(random.Random(8), 2, 90, (50, 60), 4)
    verify(documents(pairs), pairs, task_elements=900)
    verify(documents(pairs), pairs, n=5, percent=80, task_elements=900)


def test_odd_texts(documents):
    pairs = [(9, None), (8, ""), (7, " \n "), (6, "a"), (5, "A"), (4, "a b c"), (3, "a b c d"), (2, "a b c d"), (1, "À b c d"), (0, "x y " * 9000), (11, "x y " * 9001), (12, "a b c"), (12, "a b c"), (None, "a b c"), (None, "only null")]
    verify(documents(pairs, clash=True), pairs)
    assert jt.jaccard_components(documents([])).collect() == []


def test_tree_finds_all_links():
    rng = np.random.default_rng(0)
    sets = []
    for _ in range(30):
        base = rng.integers(0, 2**63, rng.integers(5, 80)).astype(np.uint64)
        for _ in range(5):
            sets.append(np.unique(np.where(rng.random(len(base)) < 0.06, rng.integers(0, 2**63, len(base)).astype(np.uint64), base)))
    got = jt.tree_links(sets, None, 85)
    linked = lambda a, b: 100 * len(np.intersect1d(a, b)) >= 85 * len(np.union1d(a, b))
    assert all(linked(sets[i], sets[j]) for i, j in got)
    roots = jt.Union(len(sets))
    for i, j in got:
        roots.up[roots.root(i)] = roots.root(j)
    assert all(roots.root(i) == roots.root(j) for i in range(len(sets)) for j in range(i) if linked(sets[i], sets[j]))


def test_left_out_keys_lose_no_pair():
    """Whatever the order of all keys, sets that link still share one that neither leaves out."""
    rng = np.random.default_rng(7)
    linked = 0

    def left(parts, s, order):
        keys, spared = parts.keyed(s)
        kept = []
        for c in np.unique(keys & jt.CLASS):
            mine, most = keys[keys & jt.CLASS == c], spared[keys & jt.CLASS == c]
            assert (most == most[0]).all() and most[0] < len(mine)
            kept += sorted(mine.tolist(), key=order)[: len(mine) - most[0]]
        return kept

    for percent in (80, 85):
        parts = jt.Parts(percent)
        for _ in range(700):
            a = np.unique(rng.integers(0, 2**63, rng.integers(1, 300)).astype(np.uint64))
            b = np.unique(np.concatenate([a[rng.random(len(a)) > 0.1], rng.integers(0, 2**63, rng.integers(0, 1 + len(a) // 9)).astype(np.uint64)]))
            if len(b) and 100 * len(np.intersect1d(a, b)) >= percent * len(np.union1d(a, b)):
                linked += 1
                shared = set(np.intersect1d(parts.keys(a), parts.keys(b)).tolist())
                for order in (lambda k: k, lambda k: (k in shared, k), lambda k: (k not in shared, -k)):
                    assert len(np.intersect1d(left(parts, a, order), left(parts, b, order)))
    assert linked > 400


def test_passages_bring_no_texts_together(documents):
    """Texts that share a passage, but not enough to link, meet by no key, so they are neither moved nor compared."""
    rnd = random.Random(5)
    passages = [[f"p{k}w{i}" for i in range(60)] for k in range(4)]
    texts = [[f"w{rnd.randrange(10**9)}" for _ in range(120)] + passages[i % 4] + [f"w{rnd.randrange(10**9)}" for _ in range(40)] for i in range(60)]
    pairs = list(enumerate(" ".join(t) for t in texts)) + [(100, " ".join(texts[3][:-2])), (101, " ".join(texts[3]))]
    df = documents(pairs)
    verify(df, pairs, n=5, percent=80)
    held = jt.members(df.select("doc_id", "text"), 5, 80, jt.shared_keys(df, 5, 80)).localCheckpoint()
    meet = jt.meetings(held).groupBy("key").agg(F.collect_set("node").alias("nodes")).where("size(nodes) > 1")
    found = {n for r in meet.collect() for n in r.nodes}
    assert found == {r.node for r in held.where("doc_id IN (3, 100, 101)").collect()}
