"""Removal of repeated strings by suffix order.

A byte goes if it lies in a 50-byte string that also starts in a document with a smaller doc_id.
Equal 50-byte strings share their least inner hash (of GRAM bytes), so that hash is the key by which
they meet. Only keys of several texts matter; a first pass finds them, a second sends what
surrounds such keys to the part of the key space that owns them. A part puts the different pieces
around a key behind one another, whole, sorts all their suffixes, and finds each string's first
document among neighbours.

The suffixes are sorted by linear grouping: groups share a prefix that is a Lyndon word. From the
highest group down, each group's members look up the nearest earlier suffix of a lower group; how
many point to the same one splits that one's group. A last pass from the smallest suffix on puts
every group in order by the same pointers. Nothing is renamed and nothing recurses.
"""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftload.llm.components import Filter
from weftload.llm.words import distinct, mix, pressed, ranges, slices, unpressed
from weftload.session import written_table

LENGTH, GRAM = 50, 24
#: Bytes of all texts for each part of the key space.
PART_BYTES = 2 << 20
#: Bytes of all texts for each part in which common keys are looked for, which sees about half as many bytes of keys.
KEY_BYTES = 32 << 20
#: Symbols whose suffixes are sorted at once: pieces of different keys need not meet. What is made of them stays in a core's cache.
BATCH = 1 << 12
#: Bytes of texts whose keys are made at once: what is made of them stays in a core's cache.
BLOCK = 1 << 15
LAST = (1 << 63) - 1  # stands for a null doc_id


def suffix_order(text: list[int]) -> list[int]:
    """Starts of all suffixes in ascending order. The last symbol must be smaller than all others."""
    n = len(text)
    symbols = np.array(text)
    ranks = np.argsort(symbols, kind="stable")
    new = np.ones(n, bool)
    new[1:] = symbols[ranks[1:]] != symbols[ranks[:-1]]
    heads = np.flatnonzero(new)
    sizes, groups = np.zeros(n, np.int64), np.zeros(n, np.int64)
    sizes[heads] = np.diff(np.append(heads, n))
    groups[ranks] = heads[np.cumsum(new) - 1]
    order, size, group, at = ranks.tolist(), sizes.tolist(), groups.tolist(), np.argsort(ranks).tolist()
    before = [-1] * n  # at -1 stands the last symbol, which is below all groups and placed
    top = n - 1
    while top > 0:
        start = group[order[top]]
        if start == top:  # a group of one, as most are
            s = order[top]
            p = s - 1
            while group[p] >= start:
                p = before[p]
            before[s] = p
            g = group[p]
            if size[g] > 1:
                size[g] -= 1
                last = g + size[g]
                here, other = at[p], order[last]
                order[here], order[last], at[other], at[p] = other, p, here, last
                group[p], size[last] = last, 1
            top -= 1
            continue
        pointed: dict[int, int] = {}
        for s in sorted(order[start : top + 1]):
            p = s - 1
            while group[p] >= start:
                p = before[p]
            before[s] = p
            if p in pointed:
                pointed[p] += 1
            else:
                pointed[p] = 1
        # those that more members point to go higher; each leaves its group to the one behind it
        moved: dict[int, list[int]] = {}
        for p, k in pointed.items():
            g = group[p]
            if size[g] > 1:
                g += k * n
                if g in moved:
                    moved[g].append(p)
                else:
                    moved[g] = [p]
        for k in sorted(moved, reverse=True):  # moving some of a group leaves the others where they are
            g, members = k % n, moved[k]
            rest = size[g] - len(members)
            if not rest:
                continue
            last = g + size[g]
            for p in members:
                last -= 1
                here, other = at[p], order[last]
                order[here], order[last], at[other], at[p] = other, p, here, last
                group[p] = g + rest
            size[g], size[g + rest] = rest, len(members)
        top = start - 1
    free, placed = list(range(n)), [False] * n
    out = [0] * n
    out[0] = n - 1
    placed[n - 1] = True
    for k in range(n):
        s = out[k] - 1
        while not placed[s]:
            g = group[s]
            to = free[g]
            out[to], free[g], placed[s] = s, to + 1, True
            s = before[s]
    return out


def grams(data: np.ndarray) -> np.ndarray:
    """A hash of each GRAM-byte string."""
    h = [data.astype(np.uint64) + np.uint64(1)]
    for step in (1, 2, 4, 8):
        h.append(mix(h[-1][:-step], h[-1][step:]))
    return mix(h[4][: len(data) - GRAM + 1], h[3][16 : 16 + len(data) - GRAM + 1])  # 16 and 8 bytes


def spread(least: np.ndarray) -> np.ndarray:
    """Keys from least hashes, one to one. These crowd at the small numbers: few parts and one corner of a filter would get them."""
    return mix(least, np.uint64(0))


def keys_of(data: np.ndarray) -> np.ndarray:
    """For each start of a LENGTH-byte string, the least hash of the GRAM-byte strings in it, spread."""
    if len(data) < LENGTH:
        return np.zeros(0, np.uint64)
    least = grams(data)
    for step in (1, 2, 4, 8):
        least = np.minimum(least[:-step], least[step:])
    width = LENGTH - GRAM + 1  # 27: two runs of 16 that overlap
    n = len(data) - LENGTH + 1
    return spread(np.minimum(least[:n], least[width - 16 : width - 16 + n]))


def keys_by_text(texts: list[bytes]) -> Iterator[np.ndarray]:
    """``keys_of`` for each text."""
    block, held = [], 0
    for k, text in enumerate(texts):
        block.append(text)
        held += len(text)
        if held >= BLOCK or k + 1 == len(texts):
            keys = keys_of(np.frombuffer(b"".join(block), np.uint8))
            ends = np.cumsum([len(t) for t in block]).tolist()
            for t, end in zip(block, ends):
                yield keys[end - len(t) : max(end - LENGTH + 1, end - len(t))]
            block, held = [], 0


def first_per_text(batch: pa.RecordBatch) -> list[tuple[int, bytes, int]]:
    """(node, text, smallest doc_id) of the different texts of a slice that are long enough."""
    found: dict[int, list] = {}
    for doc, text in zip(batch.column("id").to_pylist(), batch.column("text")):
        data = text.as_buffer().to_pybytes()
        if len(data) >= LENGTH:
            entry = found.setdefault(node_of(data), [data, doc])
            entry[1] = min(entry[1], doc)
    return [(node, data, doc) for node, (data, doc) in found.items()]


def node_of(data: bytes) -> int:
    return xxhash.xxh3_64_intdigest(data) - (1 << 63)


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of one key."""
    cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
    return np.concatenate([[0], cuts]), np.concatenate([cuts, [len(keys)]])


def common_keys(docs: DataFrame, bits: int = 8) -> Filter:
    """A filter of the keys of several texts, which meet in 2 ** bits parts."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            own = [distinct(keys) for keys in keys_by_text([data for _, data, _ in first_per_text(batch)])]
            if not own:
                continue
            keys, count = np.unique(np.concatenate(own), return_counts=True)
            part = (keys >> np.uint64(64 - bits)).astype(np.int64)
            at, begin = np.unique(part, return_index=True)
            cuts = zip(begin, [*begin[1:], len(keys)])
            packed = [pressed(np.repeat(keys[a:b], np.minimum(count[a:b], 2))) for a, b in cuts]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(packed, pa.binary())], ["part", "keys"])

    def shared(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [unpressed(b.as_py()) for batch in batches for b in batch.column("keys")]
        keys, count = np.unique(np.concatenate(held), return_counts=True)
        keys = keys[count > 1]
        place = Filter.place(keys) // Filter.SLICE
        at = np.unique(place)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array([Filter.slice_of(keys[place == k]) for k in at], pa.binary())], ["slice", "bits"])

    asked = docs.mapInArrow(ask, "part int, keys binary")
    return Filter({r.slice: bytes(r.bits) for r in asked.groupBy("part").applyInArrow(shared, "slice long, bits binary").collect()})


def packed(table: np.ndarray) -> bytes:
    """Five rows of numbers as byte planes, compressed: most planes hold one value."""
    planes = np.ascontiguousarray(table, "<i8").view(np.uint8).reshape(-1, 8).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<i8").reshape(5, -1)


def pieces(docs: DataFrame, known: Filter, bits: int) -> DataFrame:
    """What surrounds common keys, packed by parts: keys, nodes, doc_ids, places, sizes and the bytes themselves."""
    filter_ = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            columns, texts = [], []
            found = first_per_text(batch)
            for (node, data, doc), keys in zip(found, keys_by_text([data for _, data, _ in found])):
                raw = np.frombuffer(data, np.uint8)
                a, b = runs(keys)
                kept = filter_.value.holds(keys[a])
                a, b = a[kept], b[kept]
                sizes = b - a + LENGTH - 1
                columns.append(np.stack([keys[a].view(np.int64), np.full(len(a), node), np.full(len(a), doc), a, sizes]))
                texts.append(raw[ranges(a, sizes)])
            if not columns or not sum(map(len, texts)):
                continue
            table, text = np.concatenate(columns, axis=1), np.concatenate(texts)
            part = (table[0].view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(table.shape[1], np.int64)
            starts = np.cumsum(table[4]) - table[4]
            order = np.argsort(part, kind="stable")
            at, begin = np.unique(part[order], return_index=True)
            rows, blobs = [], []
            for x, y in zip(begin, [*begin[1:], len(order)]):
                mine = order[x:y]
                rows.append(packed(table[:, mine]))
                blobs.append(zstandard.ZstdCompressor(level=1).compress(text[ranges(starts[mine], table[4][mine])].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(rows, pa.binary()), pa.array(blobs, pa.binary())], ["part", "rows", "bytes"])

    return docs.mapInArrow(run, "part int, rows binary, bytes binary")


def agreement(keys: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """With how many of its first numbers each row agrees with any other row of its key. No number of a row is below 0; 0 agrees with nothing."""
    n = len(keys)
    whole = np.concatenate([keys.view(np.uint8).reshape(n, 8), np.ascontiguousarray(rows).view(np.uint8).reshape(n, -1)], axis=1)
    order = np.argsort(whole.view(f"V{whole.shape[1]}").ravel())
    keys, rows = keys[order], rows[order]
    equal = (rows[1:] == rows[:-1]) & (rows[1:] > 0) & (keys[1:] == keys[:-1])[:, None]
    next_ = np.logical_and.accumulate(equal, axis=1).sum(axis=1)
    out = np.zeros(n, np.int64)
    out[order] = np.maximum(np.concatenate([[0], next_]), np.concatenate([next_, [0]]))
    return out


def shared_ranges(keys: np.ndarray, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Of each piece (in the order of keys), start and stop of the bytes in which strings of other pieces of its key may lie.

    A string that two pieces hold has the key's gram at the same place. So pieces are laid at their
    grams, and what a piece has in common with any other to the right, and to the left, is all that
    such strings can cover. Where a gram stands twice in a piece, the key's pieces stay whole.
    """
    sizes = np.array([len(t) for t in texts])
    ends = np.cumsum(sizes)
    starts = ends - sizes
    raw = np.frombuffer(b"".join(texts), np.uint8)
    found = np.flatnonzero(spread(grams(raw)) == np.repeat(keys, sizes)[: len(raw) - GRAM + 1])
    owner = np.searchsorted(starts, found, "right") - 1
    inside = found + GRAM <= ends[owner]
    found, owner = found[inside], owner[inside]
    at = np.zeros(len(texts), np.int64)
    at[owner] = found
    symbols = raw.astype(np.int16) + np.int16(1)
    right = at[:, None] + np.arange(LENGTH)
    left = at[:, None] - 1 - np.arange(LENGTH - GRAM)
    right = np.where(right < ends[:, None], symbols[np.minimum(right, len(raw) - 1)], np.int16(0))
    left = np.where(left >= starts[:, None], symbols[np.maximum(left, 0)], np.int16(0))
    low, high = at - agreement(keys, left) - starts, at + agreement(keys, right) - starts
    whole = np.isin(keys, keys[np.bincount(owner, minlength=len(texts)) != 1])
    return np.where(whole, 0, low), np.where(whole, sizes, high)


def narrowed(keys: np.ndarray, texts: list[bytes], docs: np.ndarray, least: list[np.ndarray]) -> None:
    """``first_documents`` for the pieces of whole keys, by what is left of them when only shared ranges are kept.

    Not a step of ``remove_repeats``, which sorts whole pieces: another way to the same, to hold that one against.
    """
    number: dict[tuple[int, bytes], list[int]] = {}
    low, high = shared_ranges(keys, texts)
    for i in np.flatnonzero(high - low >= LENGTH).tolist():
        number.setdefault((int(keys[i]), texts[i][low[i] : high[i]]), []).append(i)
    rest = [t for _, t in number]
    first = np.array([docs[held].min() for held in number.values()], np.int64)
    found = [np.full(len(t) - LENGTH + 1, d) for t, d in zip(rest, first)]
    per_key = Counter(k for k, _ in number)
    mixed = [j for j, (k, _) in enumerate(number) if per_key[k] > 1]
    if mixed:
        first_documents([rest[j] for j in mixed], first[mixed], [found[j] for j in mixed])
    for held, lows in zip(number.values(), found):
        for i in held:
            mine = least[i][low[i] : low[i] + len(lows)]
            np.minimum(mine, lows, out=mine)


def first_documents(texts: list[bytes], docs: np.ndarray, least: list[np.ndarray]) -> None:
    """Lowers, for each start of a LENGTH-byte string in each piece, the smallest doc_id that has the string."""
    sizes = np.array([len(t) for t in texts])
    begin = np.cumsum(sizes + 1) - sizes - 1
    symbols = np.ones(begin[-1] + sizes[-1] + 2, np.int16)
    symbols[ranges(begin, sizes)] = np.frombuffer(b"".join(texts), np.uint8).astype(np.int16) + 2
    symbols[-1] = 0
    order = np.array(suffix_order(symbols.tolist()))
    whole = np.zeros(len(symbols), bool)  # suffixes that begin with LENGTH bytes of one piece
    whole[ranges(begin, sizes - LENGTH + 1)] = True
    order = order[whole[order]]
    windows = np.lib.stride_tricks.sliding_window_view(symbols, LENGTH)
    new = np.ones(len(order), bool)
    for k in range(1, len(order), 20_000):
        part = slice(k, min(k + 20_000, len(order)))
        new[part] = (windows[order[part]] != windows[order[part.start - 1 : part.stop - 1]]).any(1)
    owner = np.searchsorted(begin, order, "right") - 1
    low = np.zeros(len(symbols), np.int64)
    low[order] = np.minimum.reduceat(docs[owner], np.flatnonzero(new))[np.cumsum(new) - 1]
    for mine, b in zip(least, begin.tolist()):
        mine[:] = low[b : b + len(mine)]


def repeated(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, start, stop): starts of strings of that text that also start in an earlier document."""
    tables, texts = [], []
    for batch in batches:
        for rows, data in zip(batch.column("rows"), batch.column("bytes")):
            tables.append(unpacked(rows.as_py()))
            texts.append(np.frombuffer(zstandard.ZstdDecompressor().decompress(data.as_py()), np.uint8))
    keys, node, doc, place, size = np.concatenate(tables, axis=1)
    text = np.concatenate(texts)
    starts = np.cumsum(size) - size
    # the smallest doc_id of a text, and of a piece
    different, at = np.unique(node, return_inverse=True)
    own = np.full(len(different), LAST)
    np.minimum.at(own, at, doc)
    own = own[at]
    data = text.tobytes()
    number: dict[tuple[int, bytes], int] = {}
    piece = np.fromiter((number.setdefault((k, data[s : s + n]), len(number)) for k, s, n in zip(keys.tolist(), starts.tolist(), size.tolist())), np.int64, len(keys))
    first = np.full(len(number), LAST)
    np.minimum.at(first, piece, doc)
    contents = list(number)
    per_key = Counter(k for k, _ in contents)
    # pieces that differ around one key are compared through their suffixes
    mixed = [i for i, (k, _) in enumerate(contents) if per_key[k] > 1]
    counts = np.array([len(t) - LENGTH + 1 for _, t in contents])
    ends = np.cumsum(counts)
    lows = np.repeat(first, counts)
    least = np.split(lows, ends[:-1])  # views
    mixed.sort(key=lambda i: contents[i][0])
    batch, held = [], 0
    for n, i in enumerate(mixed):  # whole keys, as many as BATCH symbols hold
        batch.append(i)
        held += len(contents[i][1]) + 1
        if n + 1 == len(mixed) or held >= BATCH and contents[mixed[n + 1]][0] != contents[i][0]:
            first_documents([contents[k][1] for k in batch], first[batch], [least[k] for k in batch])
            batch, held = [], 0
    begins = ends - counts
    none = np.minimum.reduceat(lows, begins)[piece] >= own
    all_ = np.maximum.reduceat(lows, begins)[piece] < own
    out = [np.stack([node[all_], place[all_], place[all_] + counts[piece[all_]]])]
    some = np.flatnonzero(~none & ~all_)
    of = counts[piece[some]]
    begin = np.cumsum(of + 1) - of - 1  # an unmarked place before each piece
    marked = np.zeros(len(some) + of.sum() + 1, np.int8)
    marked[ranges(begin + 1, of)] = lows[ranges(begins[piece[some]], of)] < np.repeat(own[some], of)
    edges = np.flatnonzero(np.diff(marked))
    row = np.searchsorted(begin, edges, "right") - 1
    edges += place[some[row]] - begin[row]
    out.append(np.stack([node[some[row[::2]]], edges[::2], edges[1::2]]))
    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in np.concatenate(out, axis=1)], ["node", "start", "stop"])


ROWS = "doc_id long, id long, node long, n_bytes long, whole binary, text binary"
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def texts_of(docs: DataFrame, touched: Filter) -> DataFrame:
    """Each document with its digest; with its text only if strings of it may go."""
    filter_ = docs.sparkSession.sparkContext.broadcast(touched)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows, least = [], {}
            for doc, text in zip(batch.column("id").to_pylist(), batch.column("text")):
                data = text.as_buffer().to_pybytes()
                node = node_of(data)
                least[node] = min(least.get(node, LAST), doc)
                rows.append([doc, node, len(data), hashlib.sha256(data).digest(), data])
            held = filter_.value.holds(np.array([r[1] for r in rows], np.int64)) if rows else []
            # of equal texts, only those of the smallest doc_id may keep anything
            kept = [r[4] if h and r[0] == least[r[1]] else None for r, h in zip(rows, held)]
            columns = list(zip(*rows))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, kinds)), pa.array(kept, pa.binary())], [x.split()[0] for x in ROWS.split(", ")]
            )

    return docs.mapInArrow(run, ROWS)


def results(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    nothing = hashlib.sha256(b"").hexdigest()
    for batch in slices(batches):
        out = []
        spans = batch.column("spans")
        at = spans.offsets.to_numpy()
        starts, stops = (x.to_numpy(zero_copy_only=False) for x in spans.values.flatten())
        docs, ids, sizes, least = (batch.column(c).to_pylist() for c in ("doc_id", "id", "n_bytes", "least"))
        for k, (doc, n, a, b) in enumerate(zip(docs, sizes, at[:-1].tolist(), at[1:].tolist())):
            if n >= LENGTH and least[k] < ids[k]:  # all of it stands in an earlier document
                out.append((doc, n, n, 1, nothing))
                continue
            if a == b:
                out.append((doc, n, 0, 0, batch.column("whole")[k].as_py().hex()))
                continue
            edges = np.bincount(starts[a:b], minlength=n + 1) - np.bincount(stops[a:b] + LENGTH - 1, minlength=n + 1)
            gone = np.cumsum(edges[:n]) > 0
            kept = np.frombuffer(batch.column("text")[k].as_buffer(), np.uint8)[~gone].tobytes()
            cuts = int((np.diff(np.concatenate([[0], gone.view(np.int8)])) == 1).sum())
            out.append((doc, n, int(gone.sum()), cuts, hashlib.sha256(kept).hexdigest()))
        names = [x.split()[0] for x in RESULT.split(", ")]
        kinds = [pa.int64()] * 4 + [pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate(kinds)], names)


def remove_repeats(docs: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """Per row of documents (doc_id, text): n_bytes, n_removed, n_spans, kept_sha256 of the UTF-8 bytes.

    Strings are judged on the input; matches never cross documents. Null texts are empty; texts under
    LENGTH bytes keep all. Rows of one doc_id don't remove from each other; a null doc_id comes after all
    others. Other columns are ignored; no rows give none. Texts that keep everything, or lose everything
    to an equal one, are never shuffled.
    """
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = named.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    bits = max(0, int(np.ceil(np.log2(max(1, size / part_bytes)))))
    key_bits = max(8, int(np.ceil(np.log2(max(1, size / KEY_BYTES)))))
    sent = pieces(named.select("id", "text"), common_keys(named.select("id", "text"), key_bits), bits)
    marks = written_table(sent.groupBy("part").applyInArrow(repeated, "node long, start long, stop long"), "marks")
    rows = written_table(texts_of(named, Filter.of(marks, "node")), "rows")
    least = rows.groupBy("node").agg(F.min("id").alias("least"))
    spans = marks.groupBy("node").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    known = written_table(least.join(spans, "node", "left"), "known")
    spans = F.when(F.col("id") == F.col("least"), F.col("spans")).alias("spans")  # other rows keep all or nothing
    return rows.join(known, "node").select("doc_id", "id", "n_bytes", "whole", "text", "least", spans).mapInArrow(results, RESULT)
