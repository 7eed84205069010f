import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from weftload.llm import packing

ODD = [None, "", " ", "  two  spaces ", "a\tb\nc \n d", "x<|endoftext|>y", " <|endoftext|> a <|endoftext|><|endoftext|>", "<|endof text|>", "it's we'll 'S", "   lead", "tail   ", "été 漢字 😀 12,5%", "a b 　c", "z" * 3000]


def ids_of(texts):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [[*tokenizer.encode(t or "", add_special_tokens=False).ids, packing.END_ID] for t in texts]


def verify(rows, wanted, window):
    """Every id once, exact checksums, windows without gaps or overlaps."""
    by_doc, by_window = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_window[r.sequence_id].append(r)
    assert set(by_doc) == set(wanted)
    for doc, ids in wanted.items():
        at = 0
        for r in sorted(by_doc[doc], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids)) and r.length > 0
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    assert sorted(by_window) == list(range(len(by_window)))
    for seq, group in by_window.items():
        at = 0
        for r in sorted(group, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == window or seq == len(by_window) - 1
    return by_window


def test_documents(spark, sample):
    docs = sample.collect()
    wanted = dict(zip([d.doc_id for d in docs], ids_of([d.text for d in docs])))
    rows = packing.pack(sample).collect()
    windows = verify(rows, wanted, 2048)
    tokens, share = sum(map(len, wanted.values())), Counter()
    for d in docs:
        share[d.source] += len(wanted[d.doc_id]) / tokens
    source = {d.doc_id: d.source for d in docs}
    for seq in range(len(windows) - 1):
        held = Counter()
        for r in windows[seq]:
            held[source[r.doc_id]] += r.length
        assert all(abs(held[s] - share[s] * 2048) < 2 * len(share) for s in share)


def test_odd_texts_and_clashing_columns(documents):
    texts = ODD * 5
    verify(packing.pack(documents(texts, clash=True), window=16).collect(), dict(enumerate(ids_of(texts))), 16)


def test_one_source_and_null_sources(documents):
    texts = [f"w{i} x y z" for i in range(50)]
    for source in (lambda i: "one", lambda i: None if i % 3 else "rare"):
        verify(packing.pack(documents(texts, source=source), window=8).collect(), dict(enumerate(ids_of(texts))), 8)


def test_repeated_rows_and_null_ids(documents):
    rows = packing.pack(documents([(1, "a b"), (1, "a b"), (None, "c")]), window=4).collect()
    ids = ids_of(["a b", "a b", "c"])
    assert sum(r.length for r in rows) == sum(map(len, ids))
    assert {r.doc_id for r in rows} == {1, None}


def test_empty(documents):
    assert packing.pack(documents([])).collect() == []
