"""Phrase collocations: frequent phrases by Misra-Gries summaries, counted exactly, scored by their weakest cut.

A phrase of m words can only be frequent if both phrases of m - 1 words in it are. So the texts are read
for words first, then for pairs of frequent words, then for all longer phrases whose pairs are
frequent. Each reading finds candidates the same way:

* A task counts the hashes of the phrases it reads; what it counted goes, by hash partition, to a table.
* A partition's mass is the number of phrases counted in it. A summary of more than mass / threshold
  counters merges the counts. Where it overflows, the largest count left out is taken off all counters, at
  most mass / counters in all, which is less than the threshold: every frequent phrase keeps a counter.

Hashes may collide and summaries keep some rare phrases, so a last reading counts the candidates
exactly, by their words. Candidates reach the readings as bit filters, sized by how many there are up to
MOST_BITS; a filter only lessens what is counted, so a full one costs time and not results.

Memory: a task holds ``flush`` counts, a summary those of one partition. There is a partition for
every PART_BYTES of text, so the mass of one does not grow with the table; a very common phrase adds mass to
its partition, but one entry per task. Tasks times partitions pieces are exchanged; pieces hold a thousand
entries or more up to about 16 TB of text, beyond which ``flush`` is to grow.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftload.llm import interpolation
from weftload.llm.words import mix, pressed, slices, unpressed
from weftload.session import written_table

THRESHOLD, LONGEST, KEPT = 100, 5, 2000
PART_BYTES = 32 << 20
FLUSH = 4 << 20
BITS_PER_KEY, LEAST_BITS, MOST_BITS, SLICE_BITS = 16, 16, 30, 1 << 18
NO_LANG = "und"

# What ends a piece, what parts words within a piece.
BREAKS, BLANKS = b".,;:!?\x0a\x0b\x0c\x0d", b"\x20\x09"
WORD, BLANK, BREAK = 0, 1, 2
CLASS, LOWER = np.zeros(256, np.uint8), np.arange(256, dtype=np.uint8)
CLASS[np.frombuffer(BLANKS, np.uint8)] = BLANK
CLASS[np.frombuffer(BREAKS, np.uint8)] = BREAK
LOWER[ord("A") : ord("Z") + 1] += 32

HELD = "part int, mass long, keys binary, counts binary"
PACKED = "part int, lang array<string>, n_words array<int>, phrase array<string>, count array<long>"
COUNTED = "lang string, n_words int, phrase string, count long"
#: Copies of each language's number of words, so that no language is joined in one task.
SALTS = 64


@dataclass
class Tokens:
    """Words of several texts: ``codes`` index ``vocab``; ``piece`` and ``lang`` number a word's piece and language."""

    codes: np.ndarray
    vocab: pa.Array
    piece: np.ndarray
    lang: np.ndarray
    langs: pa.Array


def tokens(texts: pa.Array, langs: pa.Array) -> Tokens:
    texts, langs = pc.fill_null(texts, ""), pc.fill_null(langs, NO_LANG).dictionary_encode()
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    held = texts.buffers()[2]
    data = np.frombuffer(held, np.uint8)[offsets[0] : offsets[-1]] if held is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    kind = CLASS[data]
    inside = kind == WORD
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]  # where texts that aren't empty begin
    begins[first] = inside[first]
    breaks = (kind == BREAK).astype(np.int32)
    breaks[first] += 1
    at = np.flatnonzero(begins)
    piece = np.cumsum(breaks, dtype=np.int64)[at]
    starts = np.flatnonzero(begins[inside])
    letters = LOWER[data[inside]]
    bounds = np.append(starts, len(letters)).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(bounds), pa.py_buffer(letters)]).dictionary_encode()
    text = np.searchsorted(offsets, at, side="right") - 1
    codes = langs.indices.to_numpy(zero_copy_only=False)
    return Tokens(words.indices.to_numpy().astype(np.int64), words.dictionary, piece, codes[text].astype(np.int64), langs.dictionary)


def hashes(values: pa.Array) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, values.cast(pa.binary()).to_pylist()), np.uint64, len(values))


class BitFilter:
    """A bitmap that holds every added hash and, by chance, few others: two places a hash."""

    def __init__(self, bits: int, slices_held: dict[int, bytes]):
        self.bits = bits
        self.map = np.zeros((1 << bits) // 8, np.uint8)
        width = min(SLICE_BITS, 1 << bits) // 8
        for k, held in slices_held.items():
            self.map[k * width : (k + 1) * width] = np.frombuffer(held, np.uint8)

    @staticmethod
    def places(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        return tuple((x >> np.uint64(64 - bits)).astype(np.int64) for x in (keys, mix(keys, np.uint64(bits))))

    def holds(self, keys: np.ndarray) -> np.ndarray:
        a, b = self.places(keys, self.bits)
        return ((self.map[a >> 3] >> (a & 7).astype(np.uint8)) & (self.map[b >> 3] >> (b & 7).astype(np.uint8)) & 1).astype(bool)

    @classmethod
    def of(cls, found: DataFrame) -> BitFilter:
        """Of a table of keys. Tasks make slices of the map; the driver gets no more than the map."""
        n = found.count()
        bits = min(max(int(n * BITS_PER_KEY).bit_length(), LEAST_BITS), MOST_BITS)
        width = min(SLICE_BITS, 1 << bits)

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                both = np.unique(np.concatenate(cls.places(batch.column("key").to_numpy().view(np.uint64), bits)))
                yield pa.RecordBatch.from_arrays([pa.array(both // width), pa.array((both % width).astype(np.int32))], ["slice", "bit"])

        def fill(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
            out = np.zeros(width, bool)
            out[table.column("bit").to_numpy()] = True
            return pa.table({"slice": pa.array([key[0].as_py()], pa.int64()), "held": pa.array([np.packbits(out, bitorder="little").tobytes()], pa.binary())})

        marked = found.mapInArrow(place, "slice long, bit int").distinct()
        return cls(bits, {r.slice: bytes(r.held) for r in marked.groupBy("slice").applyInArrow(fill, "slice long, held binary").collect()})


def occurrences(t: Tokens, lengths: list[int], filters: dict[int, BitFilter]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each length: the hash of the phrase that begins at each word, and which of them may be frequent."""
    single = mix(hashes(t.langs)[t.lang], hashes(t.vocab)[t.codes]) if len(t.codes) else np.zeros(0, np.uint64)
    key, open_ = single, np.ones(len(single), bool)
    for m in range(1, max(lengths) + 1):
        if m > 1:
            if len(t.codes) < m:
                return
            key = mix(key[:-1], single[m - 1 :])
            open_ = open_[:-1] & open_[1:] & (t.piece[: len(key)] == t.piece[m - 1 :])
        if m in filters:
            at = np.flatnonzero(open_)
            open_ = np.zeros(len(key), bool)
            open_[at] = filters[m].holds(key[at])
        if m in lengths:
            yield m, key, open_


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys in order, and the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def tallied(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.diff(np.append(first, len(keys)))


class Counts:
    """Counts of hashes in bounded memory."""

    def __init__(self, pending: int):
        self.most_pending = pending
        self.keys, self.counts, self.pending, self.n = np.zeros(0, np.uint64), np.zeros(0, np.int64), [], 0

    def add(self, keys: np.ndarray) -> None:
        self.pending.append(keys)
        self.n += len(keys)
        if self.n >= self.most_pending:
            self.settle()

    def settle(self) -> None:
        new, counts = tallied(np.concatenate([np.zeros(0, np.uint64), *self.pending]))
        self.keys, self.counts = summed(np.concatenate([self.keys, new]), np.concatenate([self.counts, counts]))
        self.pending, self.n = [], 0

    def flushed(self, bits: int) -> pa.RecordBatch:
        """All counts, a row for each hash partition; then none."""
        self.settle()
        keys, counts = self.keys, self.counts
        part = (keys >> np.uint64(64 - bits)).astype(np.int32) if bits else np.zeros(len(keys), np.int32)
        parts, first = np.unique(part, return_index=True)
        cuts = list(zip(first.tolist(), [*first[1:].tolist(), len(keys)]))
        self.__init__(self.most_pending)
        return pa.RecordBatch.from_arrays(
            [pa.array(parts, pa.int32()), pa.array([int(counts[a:b].sum()) for a, b in cuts], pa.int64()),
             pa.array([pressed(keys[a:b]) for a, b in cuts], pa.binary()), pa.array([interpolation.pressed(counts[a:b], "<u8") for a, b in cuts], pa.binary())],
            ["part", "mass", "keys", "counts"],
        )


def held(docs: DataFrame, lengths: list[int], filters: Broadcast, bits: int, flush: int) -> DataFrame:
    """What tasks count of the phrases of some lengths, by hash partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts(max(1, flush // 4))
        for batch in slices(batches):
            for _, key, open_ in occurrences(tokens(batch.column("text"), batch.column("lang")), lengths, filters.value):
                counts.add(key[open_])
                if len(counts.keys) >= flush:
                    yield counts.flushed(bits)
        yield counts.flushed(bits)

    return docs.mapInArrow(run, HELD)


def survivors(table: pa.Table, threshold: int) -> np.ndarray:
    """Merges the counts of a hash partition into one summary; hashes that may have the threshold."""
    capacity = sum(table.column("mass").to_pylist()) // threshold + 1
    keys, counts, lost = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0
    for more, told in zip(table.column("keys"), table.column("counts")):
        more, told = unpressed(more.as_py()), interpolation.unpressed(told.as_py(), "<u8").astype(np.int64)
        keys, counts = summed(np.concatenate([keys, more]), np.concatenate([counts, told]))
        if len(keys) > capacity:
            cut = int(np.partition(counts, len(counts) - capacity - 1)[len(counts) - capacity - 1])
            counts, lost = counts - cut, lost + cut
            keys, counts = keys[counts > 0], counts[counts > 0]
    return keys[counts + lost >= threshold]


def candidates(docs: DataFrame, lengths: list[int], filters: dict[int, BitFilter], bits: int, threshold: int, flush: int) -> DataFrame:
    """Hashes of phrases that may have the threshold; all that have it are among them."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        return pa.table({"key": pa.array(survivors(table, threshold).view(np.int64))})

    sent = docs.sparkSession.sparkContext.broadcast(filters)
    counted = written_table(held(docs, lengths, sent, bits, flush), "held")
    return written_table(counted.groupBy("part").applyInArrow(run, "key long"), "candidates")


def exact(t: Tokens, longest: int, filters: dict[int, BitFilter]) -> Iterator[pa.Table]:
    """Counts of the candidates in several texts, and of all words (as the empty phrase), each by language."""
    if not len(t.codes):
        return
    langs, words = t.langs.cast(pa.string()), t.vocab.cast(pa.string())
    n = np.bincount(t.lang, minlength=len(langs))
    yield table_of(langs, 0, pa.array([""] * len(langs), pa.string()), n, hashes(langs))
    named, size = t.lang, len(langs)  # a number for the language and the words before the last one
    for m, key, open_ in occurrences(t, list(range(1, longest + 1)), filters):
        at = np.flatnonzero(open_)
        if not len(at):
            return
        assert size <= np.iinfo(np.int64).max // len(words)
        _, first, place, count = np.unique(named[at] * len(words) + t.codes[at + m - 1], return_index=True, return_inverse=True, return_counts=True)
        named, size = np.zeros(len(key), np.int64), len(first)
        named[at] = place
        starts = at[first]
        phrase = pc.binary_join_element_wise(*[words.take(pa.array(t.codes[starts + i])) for i in range(m)], " ")
        yield table_of(langs.take(pa.array(t.lang[starts])), m, phrase, count, key[starts])


def table_of(lang: pa.Array, n_words: int, phrase: pa.Array, count: np.ndarray, key: np.ndarray) -> pa.Table:
    values = [lang, pa.array(np.full(len(lang), n_words, np.int32)), phrase, pa.array(count.astype(np.int64)), pa.array(key.view(np.int64))]
    return pa.table(values, ["lang", "n_words", "phrase", "count", "key"])


def merged(tables: list[pa.Table]) -> pa.Table:
    """Each phrase once, with the sum of its counts."""
    summed_up = pa.concat_tables(tables).group_by(["lang", "n_words", "phrase"]).aggregate([("count", "sum"), ("key", "min")])
    return summed_up.rename_columns(["lang", "n_words", "phrase", "count", "key"])


def packed(table: pa.Table, bits: int) -> pa.RecordBatch:
    """A row for each hash partition, with its phrases and counts."""
    key = table.column("key").to_numpy().view(np.uint64)
    part = (key >> np.uint64(64 - bits)).astype(np.int32) if bits else np.zeros(len(key), np.int32)
    order = np.argsort(part, kind="stable")
    parts, first = np.unique(part[order], return_index=True)
    bounds = pa.array(np.append(first, len(part)).astype(np.int32))
    table = table.take(pa.array(order)).combine_chunks()
    lists = [pa.ListArray.from_arrays(bounds, table.column(c).chunk(0)) for c in ("lang", "n_words", "phrase", "count")]
    return pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), *lists], ["part", "lang", "n_words", "phrase", "count"])


def exact_counts(docs: DataFrame, longest: int, filters: Broadcast, bits: int, threshold: int, flush: int) -> DataFrame:
    """The candidates that have the threshold. Tasks add up what they count; the rest is added up by hash partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, n = [], 0
        for batch in slices(batches):
            for table in exact(tokens(batch.column("text"), batch.column("lang")), longest, filters.value):
                tables, n = [*tables, table], n + table.num_rows
            if n > flush // 4:
                tables = [merged(tables)]
                n = tables[0].num_rows
            if n > flush // 8:
                yield packed(merged(tables), bits)
                tables, n = [], 0
        if tables:
            yield packed(merged(tables), bits)

    def add(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        flat = pa.table([pc.list_flatten(table.column(c)) for c in ("lang", "n_words", "phrase", "count")], ["lang", "n_words", "phrase", "count"])
        total = flat.group_by(["lang", "n_words", "phrase"]).aggregate([("count", "sum")]).rename_columns(["lang", "n_words", "phrase", "count"])
        return total.filter(pc.or_(pc.equal(total.column("n_words"), 0), pc.greater_equal(total.column("count"), threshold)))

    return docs.mapInArrow(run, PACKED).groupBy("part").applyInArrow(add, COUNTED)


def phrase_counts(docs: DataFrame, threshold: int = THRESHOLD, longest: int = LONGEST, flush: int = FLUSH) -> DataFrame:
    """lang, n_words, phrase, count of all phrases with the threshold, of one word upwards; n_words 0 is the number of words."""
    docs = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(0, (size // PART_BYTES).bit_length())
    filters: dict[int, BitFilter] = {}
    for lengths in ([1], [2], list(range(3, longest + 1))):
        lengths = [m for m in lengths if m <= longest]
        if lengths:
            found = BitFilter.of(candidates(docs, lengths, filters, bits, threshold, flush))
            filters = filters | dict.fromkeys(lengths, found)
    sent = docs.sparkSession.sparkContext.broadcast(filters)
    return written_table(exact_counts(docs, longest, sent, bits, threshold, flush), "phrases")


def wide(name: str) -> Column:
    return F.col(name).cast("decimal(19,0)")


def scored(counts: DataFrame) -> DataFrame:
    """Each phrase of two or more words with its weakest cut: lang, phrase, n_words, a, l, r, n, score.

    Products are decimals of 38 digits; a larger one is an error.
    """
    words = F.split("phrase", " ", -1)
    cut = F.explode(F.sequence(F.lit(1), F.col("n_words") - 1)).alias("k")
    longer = counts.where("n_words >= 2").select("lang", "phrase", "n_words", F.col("count").alias("a"), words.alias("words"), cut)
    longer = longer.withColumn("left", F.array_join(F.slice("words", F.lit(1), F.col("k")), " "))
    longer = longer.withColumn("right", F.array_join(F.slice("words", F.col("k") + 1, F.col("n_words")), " "))
    for side, name in (("left", "l"), ("right", "r")):
        longer = longer.join(counts.where("n_words > 0").select("lang", F.col("phrase").alias(side), F.col("count").alias(name)), ["lang", side])
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    sizes = counts.where("n_words = 0").select("lang", F.col("count").alias("n"), salts)
    longer = longer.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).cast("int")).join(sizes, ["lang", "salt"])
    ratio = (wide("a") * wide("n") * F.lit(1000).cast("decimal(4,0)")).alias("x"), (wide("l") * wide("r")).alias("y")
    longer = longer.select("*", *ratio).withColumn("score", F.expr("x div y"))
    weakest = F.min_by(F.struct("l", "r", "score"), F.struct("score", "k")).alias("cut")
    return longer.groupBy("lang", "phrase", "n_words", "a", "n").agg(weakest).select("lang", "phrase", "n_words", "a", "cut.l", "cut.r", "n", "cut.score")


def whole(phrases: DataFrame) -> DataFrame:
    """Drops phrases that stand in a longer one as often as at all.

    If a longer one does, so does one that is longer by one word, since each one between them stands as often; so
    only first and last parts of phrases are looked at.
    """
    words = F.split("phrase", " ", -1)
    parts = F.explode(F.array(F.slice(words, F.lit(1), F.col("n_words") - 1), F.slice(words, F.lit(2), F.col("n_words") - 1)))
    inner = phrases.where("n_words > 2").select("lang", "a", parts.alias("part")).select("lang", F.array_join("part", " ").alias("phrase"), "a").distinct()
    return phrases.join(inner, ["lang", "phrase", "a"], "left_anti")


def collocations(docs: DataFrame, threshold: int = THRESHOLD, longest: int = LONGEST, kept: int = KEPT, flush: int = FLUSH) -> DataFrame:
    """The highest-scoring phrases of each language of documents (lang, text; other columns are ignored).

    Returns lang, rank, phrase, a, l, r, n, score, n_words. A-Z are lower-cased; a null lang is ``und``; null and
    empty texts have no words; repeated rows count as often as they stand; equal scores go by a, then by
    phrase. Scores are whole numbers of thousandths. No rows give none.
    """
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = whole(written_table(scored(phrase_counts(docs, threshold, longest, flush)), "scored")).withColumn("rank", F.row_number().over(best).cast("long"))
    return ranked.where(f"rank <= {int(kept)}").select("lang", "rank", "phrase", "a", "l", "r", "n", "score", "n_words")


CHECK_SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM p),
g AS (
  SELECT lang, m AS n_words, array_to_string(words[i:i + m - 1], ' ') AS phrase
  FROM (SELECT lang, words, m, unnest(range(1, len(words) - m + 2)) AS i FROM w, range(1, 6) AS sizes(m) WHERE len(words) >= m)),
f AS (SELECT lang, n_words, phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 100),
n AS (SELECT lang, sum(len(words))::BIGINT AS n FROM w GROUP BY lang),
c AS (
  SELECT f.lang, f.n_words, f.phrase, f.a, k, array_to_string(string_split(phrase, ' ')[1:k], ' ') AS head, array_to_string(string_split(phrase, ' ')[k + 1:], ' ') AS rest
  FROM f, range(1, 5) AS cuts(k) WHERE k < f.n_words),
s AS (
  SELECT c.lang, c.n_words, c.phrase, c.a, l.a AS l, r.a AS r, n.n, (1000 * c.a::HUGEINT * n.n::HUGEINT // (l.a::HUGEINT * r.a::HUGEINT))::BIGINT AS score, k
  FROM c JOIN f l ON l.lang = c.lang AND l.phrase = c.head JOIN f r ON r.lang = c.lang AND r.phrase = c.rest JOIN n ON n.lang = c.lang),
least AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
kept AS (
  SELECT * FROM least x WHERE NOT EXISTS (
    SELECT 1 FROM f y WHERE y.lang = x.lang AND y.n_words > x.n_words AND 100 * y.a >= 100 * x.a AND contains(' ' || y.phrase || ' ', ' ' || x.phrase || ' '))),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score, n_words FROM ranked WHERE rank <= 2000
"""
