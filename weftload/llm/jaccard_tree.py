"""N-gram Jaccard join: which documents link, and the components that the links make.

Two sets link when their shingles overlap enough: J >= p / 100. Equal sets are one node. Nodes are
first brought together without loss: sets that link differ in at most k elements, so of more
than k parts that a hash cuts them into, one is equal in both. Most sets have parts enough that several must be
equal: then each leaves out as many of its most frequent parts, less one, and still meets its
partners by the rarest part that they share. So a passage that many texts hold brings none of them
together. Nodes that share one of the parts left form clusters; inside a cluster a signature tree finds the links. Tree nodes hold OR-combined bitmaps
of the shingles and size ranges; two tree nodes are visited together only if their maximum
possible overlap can make a link, and only while they are not yet one component.

A cluster too large for a task is compared with one of its members first; what links to it is one
component already, and the rest meets all blocks of the cluster in separate tasks.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftload.llm.components import Filter, components
from weftload.llm.words import Words, distinct, mix, pressed, slices, split_words, unpressed
from weftload.session import written_table

#: Elements of sets that a task compares: larger clusters are cut into blocks of this size.
TASK_ELEMENTS = 500_000
#: Bytes of texts that a task splits into words at once.
SLICE_BYTES = 4 << 20
LEAF, FAN = 8, 4
#: Bits of a key that hold its size class (there are 69 classes).
CLASS = np.uint64(127)


def shingle_sets(words: Words, n: int) -> list[np.ndarray]:
    """Sorted hashes of each text's different n-word shingles; of all its words, if there are fewer."""
    if not len(words.codes):
        return [np.zeros(0, np.uint64)] * (len(words.starts) - 1)
    hashed = words.hashes()[words.codes]
    rolled = [hashed]
    for k in range(1, n):
        before = rolled[-1]
        rolled.append(mix(before[:-1], hashed[k:]) if len(before) > 1 else before[:0])
    out = []
    for a, b in zip(words.starts[:-1].tolist(), words.starts[1:].tolist()):
        size = min(n, b - a)
        # a short text's one sequence must not equal a shingle of another length
        out.append(distinct(rolled[size - 1][a : b - size + 1] + np.uint64(size)) if size else np.zeros(0, np.uint64))
    return out


def packed(text: str) -> bytes:
    """A text on its way to a task: about a quarter of its shingles' hashes."""
    return zstandard.ZstdCompressor(level=3).compress(text.encode())


def unpacked(column: pa.Array, n: int) -> list[np.ndarray]:
    """Shingles of packed texts."""
    out = []
    for k in range(0, len(column), 64):
        texts = [zstandard.ZstdDecompressor().decompress(b.as_py()) for b in column[k : k + 64]]
        out += shingle_sets(split_words(pa.array(texts, pa.binary()).cast(pa.string())), n)
    return out


def node_of(shingles: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - (1 << 63)


class Parts:
    """Keys by which sets that may link meet."""

    def __init__(self, percent: int):
        self.percent = percent
        self.edges = [1]  # size classes
        while self.edges[-1] < 1 << 40:
            self.edges.append(max(self.edges[-1] + 1, self.edges[-1] * 3 // 2))

    def differences(self, high: int) -> int:
        """In how many elements sets of at most this size may differ and link."""
        return (100 - self.percent) * 2 * high // (100 + self.percent)

    def keys(self, s: np.ndarray) -> np.ndarray:
        return self.keyed(s)[0]

    def keyed(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys, and how many keys of the same class the set may leave out: any as many, the same order of keys given for all sets.

        A set looks for partners in its own size class and in those of larger partners; a key's last bits name the class.
        Of its non-empty parts at most as many as the differences are unlike a partner's, so it shares the others.
        """
        n, out, spared = len(s), [], np.zeros(int(CLASS) + 1, np.int32)
        first = np.searchsorted(self.edges, n, "right") - 1
        last = np.searchsorted(self.edges, n * 100 // self.percent, "right") - 1
        for c in range(first, last + 1):
            high = self.edges[c + 1] - 1
            most = self.differences(high)
            spare = 1 + most // 3 if most else 0  # parts that may be empty, or are equal in sets that link
            parts = most + 1 + spare
            # a stable sort of 16-bit numbers counts instead of comparing
            part = ((s >> np.uint64(11)) % np.uint64(parts)).astype(np.uint16 if parts <= 1 << 16 else np.int64)
            order = np.argsort(part, kind="stable")
            part = part[order]
            begin = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            at = part[begin].astype(np.int64)
            with np.errstate(over="ignore"):
                total = np.add.reduceat(mix(s, np.full(n, np.uint64(c + 1)))[order], begin)
            mine = [mix(total, (at + 1 + (c << 40)).astype(np.uint64))]
            if len(at) <= most:  # an equal part might be an empty one: meet by the prefix in hash order as well
                overlap = -(-self.percent * n // 100)
                mine.append(mix(s[: n - overlap + 1], np.full(n - overlap + 1, np.uint64((c << 40) + (1 << 39)))))
            spared[c] = max(0, len(at) - most - 1)
            out += [m & ~CLASS | np.uint64(c) for m in mine]
        keys = distinct(np.concatenate(out))
        return keys, spared[(keys & CLASS).astype(np.int64)]


def sets_in(batch: pa.RecordBatch, n: int) -> Iterator[tuple[int, np.ndarray]]:
    yield from enumerate(shingle_sets(split_words(batch.column("text")), n))


def shared_keys(docs: DataFrame, n: int, percent: int) -> Filter:
    """A filter of the keys that at least two nodes have. Tasks send their different keys, packed by parts of the key space."""
    parts = Parts(percent)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in slices(batches, most=SLICE_BYTES):
            found = []
            for _, s in sets_in(batch, n):
                if len(s) and (node := node_of(s)) not in seen:
                    seen.add(node)
                    found.append(parts.keys(s))
            if not found:
                continue
            keys, count = np.unique(np.concatenate(found), return_counts=True)
            part = (keys >> np.uint64(56)).astype(np.int64)
            at, begin = np.unique(part, return_index=True)
            cuts = list(zip(begin, [*begin[1:], len(keys)]))
            # within a slice a key of several nodes is told by standing twice
            yield pa.RecordBatch.from_arrays(
                [pa.array(at, pa.int32()), pa.array([pressed(np.repeat(keys[a:b], np.minimum(count[a:b], 2))) for a, b in cuts], pa.binary())], ["part", "keys"]
            )

    def shared(key: tuple[pa.Scalar, ...], tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in tables:
            held += [unpressed(b.as_py()) for b in batch.column("keys")]
        keys, count = np.unique(np.concatenate(held), return_counts=True)
        keys = keys[count > 1]
        place = Filter.place(keys) // Filter.SLICE
        at = np.unique(place)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array([Filter.slice_of(keys[place == k]) for k in at], pa.binary())], ["slice", "bits"])

    asked = docs.select("text").mapInArrow(ask, "part int, keys binary")
    return Filter({r.slice: bytes(r.bits) for r in asked.groupBy("part").applyInArrow(shared, "slice long, bits binary").collect()})


def members(docs: DataFrame, n: int, percent: int, known: Filter) -> DataFrame:
    """doc_id, n_shingles, node, and those keys that others may have as well with what may be left out (once in a task for equal sets)."""
    parts, shared = Parts(percent), docs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in slices(batches, most=SLICE_BYTES):
            sizes, nodes, keys, spared = [], [], [], []
            for _, s in sets_in(batch, n):
                sizes.append(len(s))
                nodes.append(node_of(s) if len(s) else None)
                new = bool(len(s)) and nodes[-1] not in seen
                mine, spare = parts.keyed(s) if new else (np.zeros(0, np.uint64), np.zeros(0, np.int32))
                seen.add(nodes[-1])
                some = shared.value.holds(mine)
                keys.append(mine[some].view(np.int64))
                spared.append(spare[some])
            starts = pa.array(np.cumsum([0, *map(len, keys)]), pa.int32())
            lists = [pa.ListArray.from_arrays(starts, pa.array(np.concatenate(x))) for x in (keys, spared)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), *lists], ["doc_id", "n_shingles", "node", "keys", "spared"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, node long, keys array<long>, spared array<int>")


def meetings(held: DataFrame) -> DataFrame:
    """(node, place, key): the keys by which nodes meet, without those that each may leave out, the most frequent ones.

    Sets that link share one more key than either leaves out, at least. Of the keys that they share, the last in the order of
    (count, key) is left out by neither. A node has a place in each size class that it looks into, so sets of unlike size never share a cluster.
    """
    keyed = held.select("node", F.explode(F.arrays_zip("keys", "spared")).alias("k")).select("node", F.col("k.keys").alias("key"), F.col("k.spared").alias("spared"))
    met = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("held"), F.min("node").alias("a"), F.max("node").alias("z")).where("a <> z")
    placed = keyed.join(met.select("key", "held"), "key").withColumn("place", F.xxhash64("node", F.col("key").bitwiseAND(int(CLASS))))
    # equal sets of several tasks count as one
    nth = F.dense_rank().over(Window.partitionBy("node", "place").orderBy(F.desc("held"), F.desc("key")))
    return placed.withColumn("nth", nth).where("nth > spared").select("node", "place", "key").distinct()


def sets_of(docs: DataFrame, n: int, wanted: Filter) -> DataFrame:
    """(node, n, text) of nodes that the filter holds, at least once each; n shingles, packed texts."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in slices(batches, most=SLICE_BYTES):
            out = {}
            for i, s in sets_in(batch, n):
                if len(s) and (node := node_of(s)) not in seen and node not in out and shared.value.holds(np.array([node]))[0]:
                    out[node] = len(s), packed(batch.column("text")[i].as_py())
            seen.update(out)
            sizes, texts = zip(*out.values()) if out else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int64()), pa.array(sizes, pa.int64()), pa.array(texts, pa.binary())], ["node", "n", "packed"])

    return docs.select("text").mapInArrow(run, "node long, n long, packed binary")


class Tree:
    """Sets, their bitmaps, and a hierarchy of OR-combined bitmaps with size ranges over them."""

    def __init__(self, sets: list[np.ndarray], bits: int):
        # near copies share their least hashes, which brings them into one leaf
        self.order = sorted(range(len(sets)), key=lambda i: (sets[i][:2].tolist(), len(sets[i])))
        self.sets = [sets[i] for i in self.order]
        self.size = np.array([len(s) for s in self.sets])
        maps = np.zeros((len(sets), bits), bool)
        for i, s in enumerate(self.sets):
            maps[i, (s & np.uint64(bits - 1)).astype(np.int64)] = True
        rows = np.packbits(maps, axis=1).view(np.uint64)
        surplus = self.size - np.bitwise_count(rows).sum(1)
        self.levels = [(rows, self.size, self.size, surplus)]
        width = LEAF
        while len(self.levels[-1][0]) > 1:
            maps, low, high, more = self.levels[-1]
            at = np.arange(0, len(maps), width)
            self.levels.append((np.bitwise_or.reduceat(maps, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(more, at)))
            width = FAN

    def children(self, level: int, i: int) -> np.ndarray:
        width = LEAF if level == 1 else FAN
        return np.arange(i * width, min((i + 1) * width, len(self.levels[level - 1][0])))


class Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i


def may_link(x: Tree, i: np.ndarray, y: Tree, j: np.ndarray, level: tuple[int, int], percent: int) -> np.ndarray:
    """For all pairs of tree nodes (i of x, j of y): can the maximum possible overlap make a link?"""
    (a, la, ha, sa), (b, lb, hb, sb) = x.levels[level[0]], y.levels[level[1]]
    sizes = (100 * ha[i][:, None] >= percent * lb[j][None, :]) & (100 * hb[j][None, :] >= percent * la[i][:, None])
    if not sizes.any():
        return sizes
    both = np.bitwise_count(a[i][:, None, :] & b[j][None, :, :]).sum(2, dtype=np.int64)
    overlap = both + np.minimum(sa[i][:, None], sb[j][None, :])  # shared bits, and elements that share a bit with others
    overlap = np.minimum(overlap, np.minimum(ha[i][:, None], hb[j][None, :]))
    need = percent * (la[i][:, None] + lb[j][None, :])
    return sizes & ((100 + percent) * overlap >= need)


def tree_links(left: list[np.ndarray], right: list[np.ndarray] | None, percent: int) -> list[tuple[int, int]]:
    """Links that join left sets with right ones (None: with each other), as many as make the components."""
    made: dict[tuple[int, int, int], list[tuple[np.ndarray, Tree]]] = {}
    sides = [left] if right is None else [left, right]
    classes = [defaultdict(list) for _ in sides]  # sets of like size share trees: bitmaps as long as these sets need
    for held, sets in zip(classes, sides):
        for i, s in enumerate(sets):
            held[int(np.log(len(s)) / np.log(100 / percent))].append(i)

    def trees(side: int, kind: int, bits: int) -> list[tuple[np.ndarray, Tree]]:
        if (side, kind, bits) not in made:
            mine, step = classes[side][kind], max(1, (8 << 20) // bits)  # a tree's bitmaps take at most 8 MB while they are made
            made[side, kind, bits] = [(np.array(mine[k : k + step]), Tree([sides[side][i] for i in mine[k : k + step]], bits)) for k in range(0, len(mine), step)]
        return made[side, kind, bits]

    base = 0 if right is None else len(left)
    union, out = Union(len(left) + len(right or [])), []

    def pairs() -> Iterator[tuple[np.ndarray, Tree, np.ndarray, Tree]]:
        """Trees whose sizes allow links."""
        other = len(sides) - 1
        for kind in sorted(classes[0]):
            for near in range(kind - 1, kind + 2) if other else (kind, kind + 1):
                if near not in classes[other]:
                    continue
                longest = max(max(len(sides[k][i]) for i in classes[k][c]) for k, c in ((0, kind), (other, near)))
                bits = 1 << max(9, int(np.ceil(np.log2(8 * longest))))
                xs, ys = trees(0, kind, bits), trees(other, near, bits)
                for k, (wx, x) in enumerate(xs):
                    yield from ((wx, x, wy, y) for wy, y in (ys[k:] if xs is ys else ys))
            for key in [k for k in made if k[1] < kind - 1]:
                del made[key]

    for wx, x, wy, y in pairs():
        wx, wy, same = wx[x.order], base + wy[y.order], x is y
        todo = [(len(x.levels) - 1, 0, len(y.levels) - 1, 0)]
        while todo:
            lx, i, ly, j = todo.pop()
            if lx == 0 and ly == 0:
                if (same and i >= j) or union.root(wx[i]) == union.root(wy[j]):
                    continue
                s, t = x.sets[i], y.sets[j]
                common = len(np.intersect1d(s, t, assume_unique=True))
                if 100 * common >= percent * (len(s) + len(t) - common):
                    p, q = int(wx[i]), int(wy[j])
                    union.up[union.root(p)] = union.root(q)
                    out.append((p, q))
                continue
            down_x = lx > 0 and lx >= ly
            down_y = ly > 0 and ly >= lx
            ci = x.children(lx, i) if down_x else np.array([i])
            cj = y.children(ly, j) if down_y else np.array([j])
            level = lx - down_x, ly - down_y
            ok = may_link(x, ci, y, cj, level, percent)
            for u, v in np.argwhere(ok)[::-1].tolist():
                if same and level[0] == level[1] and ci[u] > cj[v]:
                    continue
                todo.append((level[0], int(ci[u]), level[1], int(cj[v])))
    return out


def links_in_tasks(rows: DataFrame, n: int, percent: int) -> DataFrame:
    """(a, b) from rows (cluster, block, part, side, node, packed): side 0 is joined with side 1, or with itself if a task has no side 1."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        side = table.column("side").to_numpy()
        nodes = table.column("node").to_numpy()
        sets = unpacked(table.column("packed").combine_chunks(), n)
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        both = np.concatenate([left, right])
        pairs = tree_links([sets[i] for i in left], [sets[i] for i in right] if len(right) else None, percent) if len(left) and len(both) > 1 else []
        a, b = (np.array(pairs, np.int64).reshape(-1, 2)).T
        return pa.table({"a": pa.array(nodes[both[a]], pa.int64()), "b": pa.array(nodes[both[b]], pa.int64())})

    return rows.groupBy("cluster", "block", "part").applyInArrow(run, "a long, b long")


def links(sets: DataFrame, clusters: DataFrame, n: int, percent: int, task_elements: int) -> DataFrame:
    """Links (a, b) between nodes, enough for the components."""
    rows = written_table(sets.dropDuplicates(["node"]).join(clusters.withColumnRenamed("root", "cluster"), "node"), "sets")
    sizes = rows.groupBy("cluster").agg(F.sum("n").alias("held"), F.min("node").alias("first"))
    sizes = written_table(sizes.withColumn("blocks", F.ceil(F.col("held") / task_elements)), "sizes")
    rows = rows.join(sizes, "cluster")
    small = rows.where("blocks = 1").select("cluster", F.lit(0).alias("block"), F.lit(0).alias("part"), F.lit(0).alias("side"), "node", "packed")
    found = links_in_tasks(small, n, percent)
    if not sizes.where("blocks > 1").limit(1).count():
        return found

    def pivot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            pivots = batch.column("pivot").dictionary_encode()
            firsts = unpacked(pivots.dictionary, n)
            for s, k in zip(unpacked(batch.column("packed"), n), pivots.indices.to_pylist()):
                t = firsts[k]
                common = len(np.intersect1d(s, t, assume_unique=True))
                linked.append(100 * common >= percent * (len(s) + len(t) - common))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("cluster", "first", "blocks", "node", "n", "packed")), pa.array(linked, pa.bool_())], ["cluster", "first", "blocks", "node", "n", "packed", "linked"])

    large = rows.where("blocks > 1").select("cluster", "first", "blocks", "node", "n", "packed")
    firsts = large.where("node = first").select("cluster", F.col("packed").alias("pivot"))
    tested = large.join(firsts, "cluster").mapInArrow(pivot, "cluster long, first long, blocks long, node long, n long, packed binary, linked boolean")
    tested = written_table(tested, "tested")
    star = tested.where("linked AND node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    rest = tested.where("NOT linked").groupBy("cluster").agg(F.ceil(F.sum("n") / task_elements).alias("parts"))
    open_ = tested.join(rest, "cluster")
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    part = F.pmod(F.xxhash64(F.lit(1), "node"), F.col("parts")).cast("int")
    left = open_.select("cluster", block.alias("block"), F.explode(F.sequence(F.lit(0), (F.col("parts") - 1).cast("int"))).alias("part"), F.lit(0).alias("side"), "node", "packed")
    right = open_.where("NOT linked").select("cluster", F.explode(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int"))).alias("block"), part.alias("part"), F.lit(1).alias("side"), "node", "packed")
    return found.unionByName(star).unionByName(links_in_tasks(left.unionByName(right), n, percent))


def jaccard_components(docs: DataFrame, n: int = 5, percent: int = 80, task_elements: int = TASK_ELEMENTS) -> DataFrame:
    """Per row of documents (doc_id, text): doc_id, n_shingles, component_id.

    A set holds the different shingles of n words (lower-cased A-Z), or the whole sequence of fewer words.
    Null, empty and blank texts have an empty set and link with nothing: their component is their own id.
    component_id is the smallest doc_id that links lead to. Repeated rows stand each; a null doc_id takes
    part but is never a component's id unless all its ids are null. Other columns are ignored; no rows give none.

    Texts are read three times and never shuffled; what moves is packed keys, and the sets of nodes that
    share a part with another one. Two filters of fixed size keep the rest at home.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    held = written_table(members(docs, n, percent, shared_keys(docs, n, percent)), "members")
    placed = written_table(meetings(held), "meetings")
    meet = placed.groupBy("key").agg(F.min("place").alias("a"), F.max("place").alias("z")).where("a <> z").select("key", "a")
    edges = placed.join(meet, "key").where("place <> a").select("a", F.col("place").alias("b"))
    clusters = components(edges).withColumnRenamed("node", "place").join(placed.select("node", "place").distinct(), "place")
    clusters = written_table(clusters.select("node", "root").distinct(), "clusters")
    found = links(sets_of(docs, n, Filter.of(clusters, "node")), clusters, n, percent, task_elements)
    roots = written_table(components(found), "roots")
    least = held.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("least"))
    least = written_table(least, "least")
    ids = roots.join(least, "node").groupBy("root").agg(F.min("least").alias("id"))
    of_root = roots.join(ids, "root").select("node", "id")
    named = least.join(of_root, "node", "left").select("node", F.coalesce("id", "least").alias("component_id"))
    return held.select("doc_id", "n_shingles", "node").join(written_table(named, "named"), "node", "left").select(
        "doc_id", "n_shingles", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")
    )
