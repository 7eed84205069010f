import base64
import re

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from weftload.llm import wordpiece


def greedy(word, pieces):
    """Longest match from the left; a word that can't be covered counts once."""
    at = n = 0
    while at < len(word):
        end = next((e for e in range(len(word), at, -1) if word[at:e] in pieces), None)
        if end is None:
            return 1
        at, n = end, n + 1
    return n


@settings(max_examples=200, deadline=None)
@given(st.sets(st.text("abc", min_size=1, max_size=5), min_size=1, max_size=12), st.lists(st.text("abcd", min_size=1, max_size=14), min_size=1, max_size=20))
def test_automaton(pieces, words):
    pieces = {p.encode() for p in pieces}
    got = wordpiece.Automaton(sorted(pieces)).counts([w.encode() for w in words])
    assert got.tolist() == [greedy(w.encode(), pieces) for w in words]


def vocabulary():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
        return {base64.b64decode(line.split()[0]) for line in file}


def test_documents(sample):
    pieces = vocabulary()
    got = {r.doc_id: (r.n_words, r.n_tokens) for r in wordpiece.token_counts(sample).collect()}
    for d in sample.limit(40).collect():
        words = re.findall(rb"[^\x20\x09-\x0d]+", d.text.encode())
        assert got[d.doc_id] == (len(words), sum(greedy(b" " + w, pieces) for w in words))


def test_odd_texts(documents):
    pieces = vocabulary()
    texts = [None, "", " \t\n ", "a\x0bb\x0cc", "été 漢字😀  x", "w" * 5000, "same", "same"]
    got = {r.doc_id: r for r in wordpiece.token_counts(documents(texts, clash=True)).collect()}
    for i, t in enumerate(texts):
        words = re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode())
        assert (got[i].n_words, got[i].n_tokens) == (len(words), sum(greedy(b" " + w, pieces) for w in words))
    assert wordpiece.token_counts(documents([])).collect() == []
    assert len(wordpiece.token_counts(documents([(None, "a"), (1, "b"), (1, "b")])).collect()) == 3
