"""Packing documents into training windows by deficit round-robin over source queues.

Every source has a queue of tokens. A round grants each queue credit in proportion to its
share of all tokens; a queue spends the whole tokens of its credit and keeps the fraction,
its deficit, for later rounds. With a share of T_s / N tokens a round, the credit spent
before round k is floor(k * T_s / N), so a token's round follows from its position in its
queue alone. Rounds follow each other in one stream, cut every ``window`` tokens. No task
needs another's state: deficits carry over windows and partitions in closed form.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftload.llm.words import ranges, slices
from weftload.session import written_table

WINDOW = 2048
#: Sources share queues by hash beyond this number; it bounds what each task keeps of the totals.
QUEUES = 1 << 16
#: Bytes of text, or of ids, that are worked on at once: a task's memory beside its batch.
AT_ONCE_BYTES = 2 << 20
END_ID = 1

TOKENS = "doc_id long, queue int, part int, queue_start long, n_tokens long, ids binary"
PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "queue int, round long"
)


@lru_cache(maxsize=2)
def encoding(path: str) -> tiktoken.Encoding:
    """The byte-level vocabulary of a tokenizers file."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
    ranks = {bytes(byte_of[c] for c in piece): i for piece, i in spec["model"]["vocab"].items() if piece not in special}
    return tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


@lru_cache(maxsize=2)
def token_sizes(path: str) -> np.ndarray:
    enc = encoding(path)
    return np.array([len(enc.decode_single_token_bytes(i)) for i in range(enc.max_token_value + 1)], np.int64)


def special_texts(texts: pa.Array, enc: tiktoken.Encoding) -> np.ndarray:
    """Texts that hold a special token's content."""
    found = np.zeros(len(texts), bool)
    for content in enc.special_tokens_set:
        found |= pc.fill_null(pc.match_substring(texts, content), False).to_numpy(zero_copy_only=False)
    return found


def token_ids(texts: pa.Array, path: str) -> list[np.ndarray]:
    """Ids of each text. A token never crosses a single space between two other characters,
    so each different piece between such spaces is encoded once for all texts given."""
    enc, sizes = encoding(path), token_sizes(path)
    marked = special_texts(texts, enc)
    lists = pc.split_pattern(pc.fill_null(texts, ""), " ")
    offsets = lists.offsets.to_numpy().astype(np.int64)
    offsets -= offsets[0]
    coded = lists.flatten().dictionary_encode()
    codes, pieces = coded.indices.to_numpy(), coded.dictionary.to_pylist()
    sound = np.fromiter((bool(p) and not p[0].isspace() and not p[-1].isspace() for p in pieces), bool, len(pieces))
    good = [p for p, ok in zip(pieces, sound) if ok]
    ids = np.array(enc.encode_ordinary(" " + " ".join(good)) if good else [], np.uint32)
    piece_ends = np.cumsum([len(p.encode()) + 1 for p in good], dtype=np.int64)
    ends = np.searchsorted(np.cumsum(sizes[ids]), piece_ends) + 1 if good else np.zeros(0, np.int64)
    first, count = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64)
    first[sound] = np.concatenate([[0], ends[:-1]]) if good else []
    count[sound] = ends - first[sound]
    broken = np.concatenate([[0], np.cumsum(~sound[codes])])
    out = []
    for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:])):
        if marked[i]:  # a special token cuts the text, wherever it stands
            out.append(np.array(enc.encode(texts[i].as_py(), allowed_special="all"), np.uint32))
            continue
        if broken[b] > broken[a]:  # odd white space: the text as a whole
            out.append(np.array(enc.encode_ordinary(texts[i].as_py() or ""), np.uint32))
            continue
        head = np.array(enc.encode_ordinary(pieces[codes[a]]), np.uint32)
        tail = codes[a + 1 : b]
        out.append(np.concatenate([head, ids[ranges(first[tail], count[tail])]]))
    return out


def tokenized(docs: DataFrame, path: str) -> DataFrame:
    """One row per document: its ids with the closing id, and where it starts in its part of its queue."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, filled = TaskContext.get().partitionId(), {}
        for batch in slices(batches, most=AT_ONCE_BYTES):
            queues, starts, sizes, blobs = batch.column("queue").to_pylist(), [], [], []
            for queue, ids in zip(queues, token_ids(batch.column("text"), path)):
                ids = np.append(ids, np.uint32(END_ID))
                starts.append(filled.get(queue, 0))
                sizes.append(len(ids))
                filled[queue] = starts[-1] + len(ids)
                blobs.append(ids.astype("<u2" if path_fits(path) else "<u4").tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(queues, pa.int32()), pa.array([part] * len(sizes), pa.int32()),
                 pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(blobs, pa.binary())],
                ["doc_id", "queue", "part", "queue_start", "n_tokens", "ids"],
            )

    queue = F.pmod(F.xxhash64("source"), F.lit(QUEUES)).cast("int")
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), queue.alias("queue")).mapInArrow(run, TOKENS)


def path_fits(path: str) -> bool:
    return encoding(path).max_token_value < 1 << 16


class Rounds:
    """Which round a queue's token falls in, and where the rounds lie in the stream."""

    def __init__(self, totals: dict[int, int], window: int):
        self.queues = np.array(sorted(totals), np.int64)
        self.total = np.array([totals[q] for q in self.queues.tolist()], np.int64)
        self.n = max(1, -(-int(self.total.sum()) // window))
        self.rate = self.total / self.n

    def spent(self, queue: np.ndarray, rounds: np.ndarray) -> np.ndarray:
        """Tokens that a queue has given before a round; never falls with the round, and ends at the queue's total."""
        total = self.total[queue]
        given = np.minimum(np.floor(rounds * self.rate[queue]).astype(np.int64), total)
        return np.where(rounds >= self.n, total, given)

    def round_of(self, queue: np.ndarray, token: np.ndarray) -> np.ndarray:
        k = np.clip((token / self.rate[queue]).astype(np.int64), 0, self.n - 1)
        while (high := self.spent(queue, k) > token).any():
            k -= high
        while (low := self.spent(queue, k + 1) <= token).any():
            k += low
        return k

    def stream(self, queue: np.ndarray, rounds: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Place in the stream: all earlier rounds, the queues before this one in its round, its own tokens."""
        place = token - self.spent(queue, rounds)
        for other in range(len(self.queues)):
            all_of = np.full(len(rounds), other)
            before = self.spent(all_of, rounds)
            place += before + np.where(other < queue, self.spent(all_of, rounds + 1) - before, 0)
        return place


def cut(starts: np.ndarray, ends: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Repeats each owner over starts..ends (both included); gives owners and the values."""
    n = ends - starts + 1
    return np.repeat(owner, n), ranges(starts, n)


def pieces(tokens: DataFrame, totals: dict[int, int], window: int, wide: bool) -> DataFrame:
    """Cuts every document where a round or a window ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rounds = Rounds(totals, window)
        for batch in slices(batches, "ids", AT_ONCE_BYTES):
            col = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in ("queue", "n_tokens", "first")}
            queue = np.searchsorted(rounds.queues, col["queue"])
            first, last = col["first"].astype(np.int64), col["first"] + col["n_tokens"] - 1
            row, k = cut(rounds.round_of(queue, first), rounds.round_of(queue, last), np.arange(len(queue)))
            a = np.maximum(rounds.spent(queue[row], k), first[row])
            b = np.minimum(rounds.spent(queue[row], k + 1), last[row] + 1)
            row, k, a, b = (x[b > a] for x in (row, k, a, b))
            place = rounds.stream(queue[row], k, a)
            at, seq = cut(place // window, (place + b - a - 1) // window, np.arange(len(row)))
            begin = np.maximum(place[at], seq * window)
            end = np.minimum((place + b - a)[at], (seq + 1) * window)
            start, length, row = (a - first[row])[at] + begin - place[at], end - begin, row[at]
            ids = [np.frombuffer(x.as_buffer(), "<u4" if wide else "<u2").astype("<u4") for x in batch.column("ids")]
            sums = [zlib.crc32(ids[r][s : s + n]) for r, s, n in zip(row.tolist(), start.tolist(), length.tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(row)), *map(pa.array, (start, length, np.array(sums, np.int64), col["n_tokens"][row].astype(np.int64), seq, begin - seq * window, col["queue"][row].astype(np.int32), k[at]))],
                [x.split()[0] for x in PIECES.split(", ")],
            )

    return tokens.mapInArrow(run, PIECES)


def pack(docs: DataFrame, path: str | None = None, window: int = WINDOW) -> DataFrame:
    """Packs all documents (doc_id, text, source; other columns are ignored) into windows of ``window`` tokens.

    Each id of each document lies in exactly one piece; windows are filled without gaps, so only the
    last one is short. Null texts are empty and hold the closing id alone; a null source is a queue of
    its own, a null doc_id stays null, repeated rows are packed as often as they stand, and no rows
    give no pieces. Sources meet in one queue only if their hashes do (see QUEUES).

    Ids are kept once, in a table in the shared folder; every later step reads it without a shuffle.
    Totals per queue, at most QUEUES numbers, go to the tasks. What each part of a queue has before
    it is a table of one row per (task, queue), joined by its measured size.
    """
    path = path or public_tokenizers.path("byte_bpe_50k.json")
    wide = not path_fits(path)
    tokens = written_table(tokenized(docs, path), "tokens")
    shares = written_table(tokens.groupBy("part", "queue").agg(F.sum("n_tokens").alias("held")), "shares")
    totals = {r.queue: r.held for r in shares.groupBy("queue").agg(F.sum("held").alias("held")).collect()}
    before = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = written_table(shares.select("part", "queue", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("base")), "offsets")
    placed = tokens.join(offsets, ["part", "queue"]).select("doc_id", "queue", "n_tokens", "ids", (F.col("base") + F.col("queue_start")).alias("first"))
    return pieces(placed, totals, window, wide)
