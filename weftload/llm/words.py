"""Word splitting inside tasks: whole Arrow columns at a time, in slices of bounded size."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard

SLICE_BYTES = 8 << 20


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts batches between rows so that a slice holds about ``most`` bytes of text; a longer row stands alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes, dtype=np.int64) // most
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)
    pa.default_memory_pool().release_unused()  # a worker waits for its next task with what it holds


@dataclass
class Words:
    """Words of several texts: ``codes`` index ``vocab``; text i owns codes[starts[i]:starts[i + 1]]."""

    codes: np.ndarray
    vocab: pa.Array
    starts: np.ndarray

    def rows(self) -> np.ndarray:
        """For each word, the number of its text."""
        return np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts))

    def hashes(self) -> np.ndarray:
        """A 64-bit hash for each entry of the vocabulary."""
        digest = xxhash.xxh3_64_intdigest
        return np.fromiter(map(digest, self.vocab.cast(pa.binary()).to_pylist()), np.uint64, len(self.vocab))


def split_words(texts: pa.Array, lower: bool = True) -> Words:
    """Words are runs of anything but space, tab, line feed, vertical tab, form feed, carriage return.

    Only A-Z are lower-cased. A null text has no words.
    """
    texts = pc.fill_null(texts, "")
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    flat, offsets = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    offsets -= offsets[0]
    full = pc.greater(pc.binary_length(flat), 0)
    before = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False), dtype=np.int64)])
    coded = flat.filter(full).dictionary_encode()
    return Words(coded.indices.to_numpy(), coded.dictionary, before[offsets])


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Combines two arrays of 64-bit hashes, order mattering."""
    with np.errstate(over="ignore"):
        x = a * np.uint64(0x9E3779B97F4A7C15) + b
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(29)
    return x


def pressed(rising: np.ndarray) -> bytes:
    """Sorted 64-bit keys as byte planes of their differences, compressed."""
    steps = np.diff(rising, prepend=np.uint64(0)).astype("<u8")
    return zstandard.ZstdCompressor(level=1).compress(steps.view(np.uint8).reshape(-1, 8).T.tobytes())


def unpressed(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


def distinct(values: np.ndarray) -> np.ndarray:
    """The different values in order; several times as fast as ``np.unique``."""
    ordered = np.sort(values)
    first = np.ones(len(ordered), bool)
    np.not_equal(ordered[1:], ordered[:-1], out=first[1:])
    return ordered[first]


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenation of start, start + 1, ... for each pair."""
    lengths = lengths.astype(np.int64)
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int64) + np.repeat(starts.astype(np.int64) - (ends - lengths), lengths)


def segment_sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of values[starts[i]:starts[i + 1]], empty ranges giving 0."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[starts[1:]] - total[starts[:-1]]
