"""Token counts by a linear longest-match automaton.

Greedy longest-match word pieces are counted without building them. Nodes of the vocabulary's
trie carry a failure link and the number of pieces popped on the way along it, both computed
once; a word then takes as many steps as it has bytes, plus one per link followed. The words of
a slice of texts go through the automaton together, each different word once.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftload.llm.words import Words, segment_sums, slices, split_words

NONE = -1


class Automaton:
    """Failure links and popped counts over the trie of the pieces (bytes).

    A word is a leading mark (a space) and its bytes; every piece may stand anywhere in it.
    A word that the pieces can't cover counts as one unknown token.
    """

    def __init__(self, pieces: list[bytes]):
        child: list[dict[int, int]] = [{}]
        whole = [False]
        for piece in pieces:
            node = 0
            for byte in piece:
                if byte not in child[node]:
                    child[node][byte] = len(child)
                    child.append({})
                    whole.append(False)
                node = child[node][byte]
            whole[node] = bool(piece)
        self.next = np.full((len(child), 256), NONE, np.int32)
        self.link = np.full(len(child), NONE, np.int32)
        self.popped = np.zeros(len(child), np.int32)
        level = [0]
        while level:
            below = []
            for node in level:
                for byte, to in child[node].items():
                    self.next[node, byte] = to
                    below.append(to)
                    if whole[to]:  # the piece itself is popped, and matching starts anew
                        self.link[to], self.popped[to] = 0, 1
                        continue
                    back, count = self.link[node], self.popped[node]
                    while back != NONE and byte not in child[back]:
                        count += self.popped[back]
                        back = self.link[back]
                    if back != NONE:
                        self.link[to], self.popped[to] = child[back][byte], count
            level = below

    def counts(self, words: list[bytes]) -> np.ndarray:
        """Pieces of each word; all words advance side by side."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        text = np.frombuffer(b"".join(words), np.uint8)
        at = np.concatenate([[0], np.cumsum(sizes)])
        end, at = at[1:].copy(), at[:-1].copy()
        node, count = np.zeros(len(words), np.int32), np.zeros(len(words), np.int64)
        live = np.flatnonzero(sizes)
        while len(live):
            here, reading = node[live], at[live] < end[live]
            to = np.full(len(live), NONE, np.int32)
            to[reading] = self.next[here[reading], text[at[live[reading]]]]
            step = to != NONE
            at[live[step]] += 1
            node[live[step]] = to[step]
            stuck = live[~step]
            back = self.link[node[stuck]]
            lost = stuck[back == NONE]
            count[lost] = 1
            count[stuck] += np.where(back == NONE, 0, self.popped[node[stuck]])
            node[stuck] = np.maximum(back, 0)
            done = (at == end) & (node == 0)
            done[lost] = True
            live = live[~done[live]]
        return count


@lru_cache(maxsize=2)
def automaton(path: str) -> Automaton:
    """From a file of ranked pieces: base64 text and rank on each line."""
    with open(path, "rb") as file:
        return Automaton([base64.b64decode(line.split()[0]) for line in file if line.strip()])


def word_counts(words: Words, machine: Automaton) -> np.ndarray:
    return machine.counts([b" " + w for w in words.vocab.cast(pa.binary()).to_pylist()])


def token_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Per row of documents (doc_id, text; other columns are ignored): doc_id, n_words, n_tokens.

    Words are runs without ASCII white space, upper and lower case kept. A null or empty text has no
    words and no tokens; a null doc_id stays null; repeated rows are counted each; no rows give none.
    One pass without a shuffle; a task holds the automaton and a slice of texts.
    """
    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words = split_words(batch.column("text"), lower=False)
            counts = word_counts(words, automaton(path))[words.codes]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.diff(words.starts)), pa.array(segment_sums(counts, words.starts))],
                ["doc_id", "n_words", "n_tokens"],
            )

    columns = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return columns.mapInArrow(run, "doc_id long, n_words long, n_tokens long")
