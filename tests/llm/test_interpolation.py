import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from weftload.llm import interpolation


def tokens_of(text):
    lower = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lower), None]


def brute(pairs):
    """Counts over the training documents, and the base score of each document."""
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in pairs]
    lists = [tokens_of(t) for _, t in pairs]
    single = Counter(t for ts, h in zip(lists, held) if not h for t in ts)
    n, v = sum(single.values()), len(single)
    out = []
    for (i, _), ts, h in zip(pairs, lists, held):
        base = sum(math.log10((single[t] + 1) / (n + v + 1)) for t in ts)
        out.append((i, h, len(ts), sum(single[t] > 0 for t in ts), n, base))
    return out, single, lists, held


def same(rows, wanted):
    key = lambda r: (str(r[0]), r[2], r[5])
    rows, wanted = sorted(rows, key=key), sorted(wanted, key=key)
    assert len(rows) == len(wanted)
    for r, w in zip(rows, wanted):
        assert tuple(r)[:5] == w[:5]
        assert r.base_score == pytest.approx(w[5], rel=1e-9)
        assert r.score <= 0


def test_documents(sample):
    pairs = [(d.doc_id, d.text) for d in sample.collect()]
    wanted, single, lists, held = brute(pairs)
    rows = interpolation.lm_scores(sample, chunk_bytes=60_000, part_bytes=50_000).collect()
    same(rows, wanted)
    out = [r for r in rows if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)  # better on texts it hasn't seen
    again = {r.doc_id: r.score for r in interpolation.lm_scores(sample.repartition(5)).collect()}
    assert all(again[r.doc_id] == pytest.approx(r.score, rel=1e-6) for r in rows)  # whatever the chunks


def test_scores_by_brute_force(spark, sample, monkeypatch):
    kept = {}
    learn = interpolation.learn
    monkeypatch.setattr(interpolation, "learn", lambda *a: kept.setdefault("m", learn(*a)))
    pairs = [(d.doc_id, d.text) for d in sample.limit(60).collect()]
    rows = {r.doc_id: r for r in interpolation.lm_scores(sample.limit(60), 30_000, 20_000).collect()}
    wanted, single, lists, held = brute(pairs)
    double = Counter(p for ts, h in zip(lists, held) if not h for p in zip([None, *ts], ts))
    n, v = sum(single.values()), len(single)
    for (i, _), ts in zip(pairs, lists):
        score = 0.0
        for before, t in zip([None, *ts], ts):
            c = single[before]
            m = kept["m"][int(interpolation.bucket_of(np.array([c]))[0])].copy()
            if not c:
                m[0] = 0
                m /= m.sum()
            score += math.log10(m[0] * double[before, t] / max(c, 1) + m[1] * single[t] / n + m[2] / (v + 1))
        assert rows[i].score == pytest.approx(score, rel=1e-9)


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(1)
    mixture = rng.dirichlet(np.ones(3), interpolation.BUCKETS)
    double, single = np.array([3, 1, 0, 0, 0]), np.array([5, 4, 6, 1, 0])  # the last stands for any unknown token
    for context in (4, 0):
        logs = interpolation.log_probability(single, double * (context > 0), np.full(5, context), mixture, 16, 4)
        assert (10**logs).sum() == pytest.approx(1)


def test_odd_texts(documents):
    pairs = [(1, None), (2, ""), (3, " \t"), (4, "A a\x0bÀ b"), (5, "x y " * 3000), (5, "x y"), (5, "x y"), (None, "x")]
    same(interpolation.lm_scores(documents(pairs, clash=True)).collect(), brute(pairs)[0])
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    rows = interpolation.lm_scores(documents([(held, "only held out")])).collect()
    assert [(r.n_known, r.train_tokens) for r in rows] == [(0, 0)]
    assert interpolation.lm_scores(documents([])).collect() == []


def test_counts_beyond_32_bits():
    """What a part answers, and what a document is told, holds counts of any size."""
    keys = np.array([3, 8, 2**40 + 1], np.uint64)
    packed = interpolation.pressed(np.diff(keys, prepend=np.uint64(0)), "<u8")
    most = interpolation.pressed(np.array([2**32 - 1] * 3))
    asked = pa.table([[0, 1, 2], [0] * 3, [packed] * 3, [most] * 3], schema=pa.schema([("chunk", pa.int32()), ("part", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())]))
    told = interpolation.answer((pa.scalar(0),), asked)
    assert interpolation.unpressed(told.column("counts")[0].as_py(), "<u8").tolist() == [3 * (2**32 - 1)] * 3
