import hashlib
import random

import numpy as np
import pyarrow as pa
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st

from weftload.llm import repeats as rp


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 3), max_size=60))
def test_suffix_order(symbols):
    text = [*symbols, 0]
    assert rp.suffix_order(text) == sorted(range(len(text)), key=lambda i: text[i:])


def brute(pairs):
    rows = [(rp.LAST if i is None else i, (t or "").encode()) for i, t in pairs]
    first = {}
    for i, t in rows:
        for k in range(len(t) - 49):
            first[t[k : k + 50]] = min(first.get(t[k : k + 50], rp.LAST + 1), i)
    out = []
    for (doc, _), (i, t) in zip(pairs, rows):
        gone = [False] * len(t)
        for k in range(len(t) - 49):
            if first[t[k : k + 50]] < i:
                gone[k : k + 50] = [True] * 50
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((doc, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def verify(df, pairs, **more):
    assert sorted((tuple(r) for r in rp.remove_repeats(df, **more).collect()), key=str) == brute(pairs)


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id < 500")
    verify(docs, [(d.doc_id, d.text) for d in docs.collect()], part_bytes=200_000)


def test_made_repeats(documents):
    rnd = random.Random(3)
    text = lambda n: "".join(rnd.choice("abcde é") for _ in range(n))
    shared = [text(rnd.randint(45, 130)) for _ in range(6)]
    pairs = [(i * 3 % 41, text(rnd.randint(0, 60)) + rnd.choice(shared) + text(rnd.randint(0, 40)) + rnd.choice(shared)[: rnd.randint(30, 130)]) for i in range(41)]
    verify(documents(pairs), pairs)


def test_odd_texts(documents):
    long = "The quick brown fox jumps over the lazy dog, and again. 😀"
    pairs = [(1, None), (2, ""), (3, long), (4, long), (4, long), (3, "x" + long), (5, "a" * 5000), (6, "a" * 60), (7, "a" * 49), (None, long + "tail"), (None, long), (8, "ab" * 400), (9, "zz" + "ab" * 30)]
    verify(documents(pairs, clash=True), pairs)
    assert rp.remove_repeats(documents([])).collect() == []


def test_keys_spread():
    """Parts of the key space get like shares, though keys stand for least hashes."""
    rnd = np.random.default_rng(5)
    keys = np.unique(rp.keys_of(rnd.integers(97, 123, 200_000).astype(np.uint8)))
    share = np.bincount((keys >> np.uint64(60)).astype(np.int64), minlength=16) / len(keys)
    assert share.max() < 2 / 16
    assert len(np.unique(rp.Filter.place(keys))) > 0.99 * len(keys)


def test_suffixes_of_shared_ranges_only():
    """A passage between texts of their own: what is sorted doesn't hold those."""
    rnd = random.Random(8)
    text = lambda n: "".join(rnd.choice("abcdefghij\0é") for _ in range(n))
    shared = text(60).encode()
    texts = [text(26).encode() + shared + text(26).encode() for _ in range(40)]
    keys, pieces = [], []
    for t in texts:
        data = rp.keys_of(np.frombuffer(t, np.uint8))
        for a, b in zip(*rp.runs(data)):
            keys.append(data[a])
            pieces.append(t[a : b + rp.LENGTH - 1])
    keys = np.array(keys, np.uint64)
    low, high = rp.shared_ranges(keys, pieces)
    assert sum((high - low)[high - low >= rp.LENGTH]) < sum(map(len, pieces)) * 2 / 3
    docs = np.arange(len(pieces))[::-1] // 3
    least, whole = ([np.full(len(p) - rp.LENGTH + 1, d) for p, d in zip(pieces, docs)] for _ in range(2))
    rp.narrowed(keys, pieces, docs, least)
    rp.first_documents(pieces, docs, whole)
    assert [x.tolist() for x in least] == [x.tolist() for x in whole]


def test_hot_passage(documents):
    """One passage in a third of all documents, its surroundings different, near it alike, or periodic."""
    rnd = random.Random(9)
    text = lambda n: "".join(rnd.choice("abcde é") for _ in range(n))
    hot, near = text(70), [text(30) for _ in range(3)]
    edge = lambda: rnd.choice([text(40), rnd.choice(near) + text(5), "ab" * 30, hot[:40], ""])
    pairs = [(i * 7 % 90, edge() + (hot if i % 3 == 0 else text(20)) + edge()) for i in range(90)]
    verify(documents(pairs), pairs, part_bytes=2000)


def test_all_suffixes_of_different_pieces_are_sorted(monkeypatch):
    """Pieces of one key that differ go to the suffix sort whole, also where they share less than a string."""
    rnd = random.Random(12)
    text = lambda n: "".join(rnd.choice("abcdefghij") for _ in range(n))
    shared = text(40)
    texts = [(text(26) + (shared if i % 2 else shared + text(3)) + text(26)).encode() for i in range(30)]
    columns, parts, pieces_of = [], [], {}
    for node, t in enumerate(texts):
        keys = rp.keys_of(np.frombuffer(t, np.uint8))
        for a, b in zip(*rp.runs(keys)):
            columns.append([keys[a].view(np.int64), node, 29 - node, a, b - a + rp.LENGTH - 1])
            parts.append(t[a : b + rp.LENGTH - 1])
            pieces_of.setdefault(keys[a], set()).add(parts[-1])
    rows = rp.packed(np.array(columns, np.int64).T)
    blob = zstandard.ZstdCompressor().compress(b"".join(parts))
    sorted_, sort = [], rp.suffix_order
    monkeypatch.setattr(rp, "suffix_order", lambda symbols: sorted_.append(len(symbols)) or sort(symbols))
    list(rp.repeated((), iter([pa.RecordBatch.from_pydict({"rows": [rows], "bytes": [blob]})])))
    different = sum(len(p) + 1 for found in pieces_of.values() if len(found) > 1 for p in found)
    assert different > 0 and sum(sorted_) - len(sorted_) == different
