"""Benchmark decontamination: BM25 search of every training passage over an index of test items.

Items are cut into units of bounded length, and the index keeps each term's share of its unit's
BM25 weight, so a passage scores between 0 and 1: how much of the unit it holds. Units lie in
blocks, and each term has its largest share per list and per block. A passage goes through
block-max WAND: terms whose list bounds can't reach the threshold together can't bring up a
candidate (the pivot rule); candidate blocks must reach it by their block bounds; only then are
units scored. All passages of a slice of documents take each step together. What scores above
the threshold is verified: the passage must hold the word sequences of question and answer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftload.llm.words import distinct, mix, ranges, slices, split_words
from weftload.session import written_table

UNIT, STRIDE = 64, 64
PASSAGE = UNIT + STRIDE  # any run of UNIT words lies in one passage
BLOCK = 16
K1, B = 1.2, 0.75
THRESHOLD, OVERLAP, GRAM = 0.5, 0.5, 3
#: Items with fewer words are found only where all their word sequences stand.
LEAST_WORDS = 6
#: Words of items in one index: the size of what is broadcast. More items make more indexes, one pass each.
SHARD_WORDS = 1_000_000
#: Bytes of text that are searched at once, and (passage, term, block) entries that are looked up at once: both bound a
#: task's memory beside the index. A longer text, or a passage with more entries, stands alone.
AT_ONCE_BYTES, AT_ONCE = 1 << 20, 250_000
FOUND = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"


def question_answer(text: str = "text"):
    """Question and answer of a plain item: its last sentence is the answer, if it has several."""
    parts = F.regexp_extract(F.trim(text), r"(?s)^(.*[.!?])\s+(\S.*)$", 1), F.regexp_extract(F.trim(text), r"(?s)^(.*[.!?])\s+(\S.*)$", 2)
    return [F.when(parts[0] == "", F.col(text)).otherwise(parts[0]).alias("question"), F.nullif(parts[1], F.lit("")).alias("answer")]


def terms_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Lower-cased words without punctuation at their ends: codes, vocabulary, starts."""
    words = split_words(texts)
    coded = pc.ascii_trim(words.vocab, ".,;:!?\"'()[]{}|*#&%$<>-_").dictionary_encode()
    codes = coded.indices.to_numpy()[words.codes] if len(words.codes) else np.zeros(0, np.int64)
    full = pc.greater(pc.binary_length(coded.dictionary), 0).to_numpy(zero_copy_only=False)
    kept = full[codes] if len(codes) else np.zeros(0, bool)
    before = np.concatenate([[0], np.cumsum(kept)])
    return codes[kept].astype(np.int64), coded.dictionary, before[words.starts]


def hashes(vocab: pa.Array) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, vocab.cast(pa.binary()).to_pylist()), np.uint64, len(vocab))


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all sequences of n words; of all words if there are fewer."""
    n = min(n, len(words))
    if not n:
        return words[:0]
    out = words[: len(words) - n + 1]
    for k in range(1, n):
        out = mix(out, words[k : len(words) - n + 1 + k])
    return distinct(out)


class Index:
    """Units of items in blocks, with each term's share of a unit's weight. df: term to number of units
    among all n units; mean: their mean length."""

    def __init__(self, rows: list, df: dict[str, int], n: int, mean: float):
        self.items, self.parts, self.short = [], [], []
        units: list[tuple[int, dict[str, int]]] = []
        for r in rows:
            texts = [r.question or "", r.answer or ""]
            codes, vocab, starts = terms_of(pa.array(texts, pa.string()))
            if not len(codes):
                continue
            if starts[1] == 0:  # an item of an answer only
                starts = np.array([0, len(codes), len(codes)])
            hashed = hashes(vocab)[codes] if len(codes) else np.zeros(0, np.uint64)
            self.items.append(r.item_id)
            self.short.append(len(codes) < LEAST_WORDS)
            self.parts.append([(hashed[a:b], min(GRAM, b - a)) for a, b in zip(starts[:-1], starts[1:])])
            names = vocab.to_pylist()
            for a in range(0, len(codes), UNIT):
                part = codes[a : a + UNIT] if len(codes) - a >= LEAST_WORDS or not a else codes[-UNIT:]
                terms, counts = np.unique(part, return_counts=True)
                units.append((len(self.items) - 1, {names[t]: int(c) for t, c in zip(terms, counts)}))
        units.sort(key=lambda u: (sum(u[1].values()), u[0]))
        self.item_of = np.array([u[0] for u in units], np.int64)
        self.place: dict[str, int] = {}
        term, unit, share = [], [], []
        for k, (_, counts) in enumerate(units):
            size = sum(counts.values())
            weight = {
                t: np.log(1 + (n - df.get(t, 1) + 0.5) / (df.get(t, 1) + 0.5)) * c * (K1 + 1) / (c + K1 * (1 - B + B * size / mean))
                for t, c in counts.items()
            }
            total = sum(weight.values())
            for t, w in weight.items():
                term.append(self.place.setdefault(t, len(self.place)))
                unit.append(k)
                share.append(w / total)
        self.blocks = max(1, -(-len(units) // BLOCK))
        term, unit, share = np.array(term, np.int64), np.array(unit, np.int64), np.array(share)
        order = np.lexsort((unit, term))
        term, self.unit, self.share = term[order], unit[order], share[order]
        key = term * self.blocks + self.unit // BLOCK
        self.key, first = np.unique(key, return_index=True)  # one entry for each term and block
        self.from_, self.size = first, np.diff([*first, len(key)])
        self.block_best = np.maximum.reduceat(self.share, first) if len(first) else np.zeros(0)
        heads = np.searchsorted(self.key, np.arange(len(self.place) + 1) * self.blocks)
        self.head, self.n_blocks = heads[:-1], np.diff(heads)
        self.best = np.maximum.reduceat(self.block_best, self.head) if len(self.head) else np.zeros(0)

    def search(self, passage: np.ndarray, term: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Passages, units and scores of all that reach the threshold. (passage, term): different pairs, by passage."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        close = threshold - 1e-9
        # 1. pivot rule: in a passage's terms by rising list bound, those before the threshold is reached bring up nothing
        order = np.lexsort((self.best[term], passage))
        passage, term = passage[order], term[order]
        bound = self.best[term]
        run = np.cumsum(bound)
        first = np.searchsorted(passage, passage)
        lead = (run - np.where(first > 0, run[first - 1], 0)) >= close
        here, its = passage[lead], term[lead]
        found = [none]
        for part in self._parts(here, self.n_blocks[its]):
            # 2. blocks of the leading terms
            heads, sizes = self.head[its[part]], self.n_blocks[its[part]]
            key = distinct(np.repeat(here[part], sizes) * self.blocks + self.key[ranges(heads, sizes)] % self.blocks)
            where, block = key // self.blocks, key % self.blocks
            a, b = np.searchsorted(passage, where), np.searchsorted(passage, where, "right")
            step = max(1, AT_ONCE // max(1, int((b - a).max(initial=0))))
            for k in range(0, len(key), step):
                some = slice(k, k + step)
                found.append(self._score(where[some], block[some], a[some], b[some], term, close))
        return tuple(np.concatenate(column) for column in zip(*found))

    @staticmethod
    def _parts(passage: np.ndarray, sizes: np.ndarray) -> list[slice]:
        """Cuts between passages, so that the sizes of a part come to AT_ONCE at most, or that it is one passage."""
        first = np.flatnonzero(np.diff(passage, prepend=-1))
        before = np.concatenate([[0], np.cumsum(sizes)])
        cuts, ends = [0], np.append(first[1:], len(passage))
        upto = before[ends]
        while cuts[-1] < len(passage):
            within = np.searchsorted(upto, before[cuts[-1]] + AT_ONCE, "right") - 1
            cuts.append(int(ends[max(within, np.searchsorted(ends, cuts[-1], "right"))]))
        return [slice(*cut) for cut in zip(cuts, cuts[1:])]

    def _score(self, where, block, a, b, term, close: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of candidate blocks, whose passages' terms are term[a:b]: passages, units and scores that reach the threshold."""
        # 3. block bounds over all terms of the passage
        owner = np.repeat(np.arange(len(where)), b - a)
        key = term[ranges(a, b - a)] * self.blocks + block[owner]
        entry = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        there = self.key[entry] == key
        owner, entry = owner[there], entry[there]
        good = np.bincount(owner, self.block_best[entry], len(where)) >= close
        # 4. exact scores in the blocks that are left
        kept = good[owner]
        owner, entry = owner[kept], entry[kept]
        at = ranges(self.from_[entry], self.size[entry])
        cell = np.repeat(owner, self.size[entry]) * BLOCK + self.unit[at] % BLOCK
        cells, place = np.unique(cell, return_inverse=True)
        score = np.bincount(place, self.share[at], len(cells))
        hit = score >= close
        owner = cells[hit] // BLOCK
        return where[owner], block[owner] * BLOCK + cells[hit] % BLOCK, score[hit]

    def overlaps(self, item: int, passages: list[np.ndarray], whole: np.ndarray) -> list[float]:
        """The share of the question's word sequences that the passages hold, and of the answer's that the whole text holds (an empty part: 1)."""
        out = []
        for (part, n), words in zip(self.parts[item], (passages, [whole])):
            wanted = grams(part, n)
            held = [grams(w, n) for w in words if n and len(w) >= n]
            out.append(float(np.isin(wanted, np.concatenate(held)).mean()) if held else float(not n))
        return out


def passages_of(starts: np.ndarray, position: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First passage number of each text; and for words at these positions, their passages (two at most) and which word."""
    size = np.diff(starts)
    n = np.maximum(1, -(-(size - (PASSAGE - STRIDE)) // STRIDE))
    base = np.concatenate([[0], np.cumsum(n)])
    local = (position - starts[text]) // STRIDE
    word = np.arange(len(position))
    ok0, ok1 = local < n[text], local > 0
    return base, np.concatenate([(base[text] + local)[ok0], (base[text] + local - 1)[ok1]]), np.concatenate([word[ok0], word[ok1]])


def search_slice(index: Index, texts: pa.Array, threshold: float, overlap: float) -> list[tuple[int, int, float, float, float]]:
    """(text, item, score, question overlap, answer overlap) of all verified finds."""
    codes, vocab, starts = terms_of(texts)
    to = np.fromiter((index.place.get(t, -1) for t in vocab.to_pylist()), np.int64, len(vocab))
    term = to[codes] if len(codes) else codes
    known = np.flatnonzero(term >= 0)
    text = np.repeat(np.arange(len(starts) - 1), np.diff(starts))[known]
    base, passage, word = passages_of(starts, known, text)
    pair = distinct(passage * max(1, len(index.place)) + term[known][word])
    found = index.search(pair // max(1, len(index.place)), pair % max(1, len(index.place)), threshold)
    if not len(found[0]):
        return []
    owner = np.searchsorted(base, found[0], "right") - 1
    groups: dict[tuple[int, int], tuple[float, set[int]]] = {}
    for t, p, u, s in zip(owner.tolist(), found[0].tolist(), found[1].tolist(), found[2].tolist()):
        key = (t, int(index.item_of[u]))
        best, places = groups.setdefault(key, (0.0, set()))
        places.add(p - int(base[t]))
        groups[key] = (max(best, s), places)
    used = distinct(np.concatenate([codes[starts[t] : starts[t + 1]] for t in {t for t, _ in groups}]))  # of texts with a find
    hashed, out = np.zeros(len(vocab), np.uint64), []
    hashed[used] = hashes(vocab.take(pa.array(used)))
    for (t, item), (best, places) in groups.items():
        mine = hashed[codes[starts[t] : starts[t + 1]]]
        # the passages found, and what stands next to them
        spans = [mine[max(0, (p - 1) * STRIDE) : p * STRIDE + PASSAGE + STRIDE] for p in sorted(places)]
        q, a = index.overlaps(item, spans, mine)
        if min(q, a) >= (1.0 if index.short[item] else overlap):
            out.append((t, index.items[item], min(1.0, best), q, a))
    return out


def leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP, shard_words: int = SHARD_WORDS) -> DataFrame:
    """One row per row of documents (doc_id, text) and test item (item_id, question, answer) that it leaks.

    The question must stand around a passage that was found, its answer anywhere in the document. Null and
    empty texts leak nothing, and items without words are not found; short items must stand word for
    word. An item may lack an answer, then its question decides. Items under one id stand each for
    themselves; a document that leaks several of them has that id once, with the best figures. Repeated
    documents have their own rows. Without items or documents there are no rows; other columns are ignored.

    Documents are read once per SHARD_WORDS words of items and never shuffled; term statistics cover all
    items, whatever the number of indexes.
    """
    spark = docs.sparkSession
    size = F.size(F.split(F.concat_ws(" ", "question", "answer"), r"\s+"))
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("question").cast("string").alias("question"), F.col("answer").cast("string").alias("answer"))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    total = items.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    shards = max(1, -(-total // shard_words))
    items = items.withColumn("shard", F.pmod(F.xxhash64("item_id", "question", "answer"), F.lit(shards)))

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Terms of the units and how many units hold them; under null, the number of units and of words."""
        for batch in batches:
            n = words = 0
            held: dict[str, int] = {}
            for t in pc.binary_join_element_wise(pc.fill_null(batch.column("question"), ""), pc.fill_null(batch.column("answer"), ""), " "):
                codes, vocab, _ = terms_of(pa.array([t.as_py()], pa.string()))
                names = vocab.to_pylist()
                for a in range(0, len(codes), UNIT):
                    n, words = n + 1, words + len(codes[a : a + UNIT])
                    for c in np.unique(codes[a : a + UNIT]).tolist():
                        held[names[c]] = held.get(names[c], 0) + 1
            yield pa.RecordBatch.from_arrays(
                [pa.array([None, *held], pa.string()), pa.array([n, *held.values()], pa.int64()), pa.array([words, *[0] * len(held)], pa.int64()), pa.array([batch.column("shard")[0].as_py()] * (1 + len(held)), pa.int64())],
                ["term", "n", "words", "shard"],
            )

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=AT_ONCE_BYTES):
            codes, vocab, _ = terms_of(batch.column("text"))
            yield pa.RecordBatch.from_arrays([vocab.take(pa.array(distinct(codes))).cast(pa.string())], ["term"])

    parts = items.select("question", "answer", "shard").repartition(shards, "shard").sortWithinPartitions("shard")
    counted = parts.mapInArrow(units, "term string, n long, words long, shard long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("words").alias("words"))
    counted = written_table(counted, "terms")
    sums = counted.where("term IS NULL").first()
    outs = []
    for shard in range(shards):
        mine = items.where(F.col("shard") == shard)
        if shards == 1:
            df = counted
        else:
            own = mine.select(F.concat_ws(" ", "question", "answer").alias("text")).mapInArrow(terms, "term string").distinct()
            df = counted.join(own, "term", "left_semi")
        known = {r.term: r.n for r in df.where("term IS NOT NULL").collect()}
        rows = sorted(mine.collect(), key=lambda r: (r.item_id is None, r.item_id, str(r.question), str(r.answer)))
        index = Index(rows, known, sums.n if sums else 0, max(1.0, sums.words / max(1, sums.n)) if sums else 1.0)
        outs.append(scan(docs, spark.sparkContext.broadcast(index), threshold, overlap))
    found = outs[0]
    for more in outs[1:]:
        found = found.unionByName(more)
    return found


def scan(docs: DataFrame, shared, threshold: float, overlap: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=AT_ONCE_BYTES):
            best: dict[tuple, tuple] = {}
            for row, item, *figures in search_slice(shared.value, batch.column("text"), threshold, overlap):
                best[row, item] = tuple(max(x) for x in zip(figures, best.get((row, item), figures)))
            rows = pa.array([r for r, _ in best], pa.int64())
            columns = zip(*best.values()) if best else ([], [], [])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(rows), pa.array([i for _, i in best], pa.int64()), *(pa.array(c, pa.float64()) for c in columns)],
                ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"],
            )

    return docs.mapInArrow(run, FOUND)
