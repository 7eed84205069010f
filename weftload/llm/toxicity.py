"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

The examples are a bounded sample of the labelled documents; their whole vocabulary makes the
vectors. A term weighs by its frequency in all documents, times how significantly its document
frequencies differ between the labels (1 at least). Cosines with all examples are worked out in
single precision for many queries at once: terms that many examples hold by a dense product, the
others by their postings. Whatever may belong to the nearest within the bound of that precision's
error is worked out again in double precision, so the neighbours are exact. Neighbours vote by
closeness; votes of the examples on each other calibrate the score.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftload.llm.words import ranges, slices, split_words
from weftload.session import written_table

#: Examples of each label at most, taken by the hash of doc_id: the bound of the sample.
PER_LABEL = 6000
#: Examples that must hold a term before the labels' difference on it counts.
LEAST_DOCS = 4
#: A term that more than this share of the examples holds is searched by a dense product.
DENSE = 1 / 12
NEIGHBOURS, BINS = 15, 10
#: Queries that are searched at once.
AT_ONCE = 128
#: Bytes of text that are split at once, and scored texts that a task remembers: both bound its memory beside the model.
AT_ONCE_BYTES, REMEMBERED = 2 << 20, 10_000
FOLDS = 5


def stripped(words: pa.Array) -> pa.Array:
    """Words without punctuation at their ends."""
    return pc.ascii_trim(words, ".,;:!?\"'()[]{}|*#&%$<>-_")


def term_rows(words) -> tuple[np.ndarray, np.ndarray, np.ndarray, list]:
    """Different (text, term) pairs with their counts: texts, codes, counts, and the terms."""
    coded = stripped(words.vocab).dictionary_encode()
    codes = coded.indices.to_numpy()[words.codes].astype(np.int64) if len(words.codes) else np.zeros(0, np.int64)
    terms = coded.dictionary.to_pylist()
    width = max(1, len(terms))
    pairs, counts = np.unique(words.rows() * width + codes, return_counts=True)
    return pairs // width, pairs % width, counts, terms


def labelled(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, dict[int, int]]:
    """A bounded, stable sample of the labelled training documents, and how many rows have each label."""
    known = (
        labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)")
        .where(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(FOLDS)) != 0)
        .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    )
    sizes = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = known.where("toxic = 1").orderBy(*order).limit(PER_LABEL).unionByName(known.where("toxic = 0").orderBy(*order).limit(PER_LABEL))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return written_table(texts.join(F.broadcast(chosen), "doc_id"), "examples"), sizes


def vocabulary(examples: DataFrame) -> tuple[list[str], np.ndarray]:
    """All terms of the examples in order, and how far the labels differ on each: the root of chi-squared, 1 at least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=AT_ONCE_BYTES):
            text, code, _, terms = term_rows(split_words(batch.column("text")))
            toxic = batch.column("toxic").to_numpy(zero_copy_only=False)[text]
            n1, n0 = (np.bincount(code[toxic == y], minlength=len(terms)) for y in (1, 0))
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array(n1), pa.array(n0)], ["term", "n1", "n0"])

    sizes = {r.toxic: r["count"] for r in examples.groupBy("toxic").count().collect()}
    all1, all0 = float(sizes.get(1, 0)), float(sizes.get(0, 0))
    if not all1 or not all0:
        return [], np.zeros(0)
    found = examples.select("text", "toxic").mapInArrow(run, "term string, n1 long, n0 long").where("term <> ''")
    found = found.groupBy("term").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0")).toArrow().sort_by("term")
    n1, n0 = (found.column(c).to_numpy().astype(np.float64) for c in ("n1", "n0"))
    have, total = n1 + n0, all1 + all0
    gap = n1 * all0 - n0 * all1
    chi = gap * gap * total / np.maximum(have * (total - have) * all1 * all0, 1e-300)
    return found.column("term").to_pylist(), np.where((have >= LEAST_DOCS) & (have < total), np.maximum(1.0, np.sqrt(chi)), 1.0)


def vectors(batch: pa.RecordBatch, place: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts, terms of the vocabulary in order and their counts within the texts."""
    text, code, count, terms = term_rows(split_words(batch.column("text")))
    to = np.fromiter((place.get(t, -1) for t in terms), np.int64, len(terms))
    term = to[code] if len(terms) else code
    kept = np.flatnonzero(term >= 0)
    kept = kept[np.lexsort((term[kept], text[kept]))]
    return text[kept], term[kept], count[kept]


def document_frequencies(docs: DataFrame, place: Broadcast, n: int) -> tuple[np.ndarray, int]:
    """How many of all documents hold each term, and how many there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(n + 1, np.int64)
        for batch in slices(batches, most=AT_ONCE_BYTES):
            held[:n] += np.bincount(vectors(batch, place.value)[1], minlength=n)[:n]
            held[n] += batch.num_rows
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(held[some])], ["term", "n"])

    counts = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    held = np.zeros(n + 1, np.int64)
    held[counts.column("term").to_numpy()] = counts.column("n").to_numpy()
    return held[:n].astype(np.float64), int(held[n])


class Index:
    """Vectors of the examples by example, by term, and as a dense table for terms that many of them hold."""

    def __init__(self, ids: np.ndarray, toxic: np.ndarray, row: np.ndarray, term: np.ndarray, weight: np.ndarray, n_terms: int):
        order = np.argsort(row, kind="stable")
        self.ids, self.toxic, self.n_terms = ids, toxic, n_terms
        self.starts = np.searchsorted(row[order], np.arange(len(ids) + 1))
        self.term, self.weight = term[order].astype(np.int32), weight[order].astype(np.float64)

    def prepare(self) -> None:
        """Lists and table, where queries are searched: they aren't sent."""
        row, order = np.repeat(np.arange(len(self.ids), dtype=np.int32), np.diff(self.starts)), np.argsort(self.term, kind="stable")
        held = np.bincount(self.term, minlength=self.n_terms)
        common = np.flatnonzero(held > DENSE * len(self.ids))
        self.column = np.full(self.n_terms, -1, np.int32)
        self.column[common] = np.arange(len(common))
        self.table = np.zeros((len(common), len(self.ids)), np.float32)
        mine = self.column[self.term] >= 0
        self.table[self.column[self.term[mine]], row[mine]] = self.weight[mine]
        order = order[~mine[order]]
        self.lists, self.list_weights = row[order], self.weight[order].astype(np.float32)
        self.list_starts = np.concatenate([[0], np.cumsum(np.where(self.column >= 0, 0, held))])
        # sums of so many products of unit vectors in single precision are off by this at most, on both sides
        self.error = 4 * (len(common) + 8) * 2.0**-24
        self.scratch = np.zeros(self.n_terms)

    def __getstate__(self) -> dict:
        return {k: self.__dict__[k] for k in ("ids", "toxic", "n_terms", "starts", "term", "weight")}

    def nearest_of(self, queries: list[tuple[np.ndarray, np.ndarray]], skip: list[int] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """What nearest() gives, for each of several queries."""
        if not hasattr(self, "table"):
            self.prepare()
        for a in range(0, len(queries), AT_ONCE):
            part = queries[a : a + AT_ONCE]
            asked = np.zeros((len(part), len(self.table)), np.float32)
            for q, (term, weight) in zip(asked, part):
                column = self.column[term]
                q[column[column >= 0]] = weight[column >= 0]
            for k, (near, (term, weight)) in enumerate(zip(asked @ self.table, part)):
                yield self.exact(near, term, weight, None if skip is None else skip[a + k])

    def nearest(self, term: np.ndarray, weight: np.ndarray, skip: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Places and cosines of the nearest examples that share a term; equal cosines go by doc_id."""
        return next(self.nearest_of([(term, weight)], None if skip is None else [skip]))

    def exact(self, near: np.ndarray, term: np.ndarray, weight: np.ndarray, skip: int | None) -> tuple[np.ndarray, np.ndarray]:
        """The nearest, from the sums over the terms of the table."""
        sizes = self.list_starts[term + 1] - self.list_starts[term]
        at = ranges(self.list_starts[term], sizes)
        near = near + np.bincount(self.lists[at], weights=self.list_weights[at] * np.repeat(weight, sizes), minlength=len(near))
        if skip is not None:
            near[self.ids == skip] = 0
        least = np.partition(near, -NEIGHBOURS)[-NEIGHBOURS] - self.error if len(near) > NEIGHBOURS else 0
        places = np.flatnonzero((near >= least) & (near > 0))
        sizes = self.starts[places + 1] - self.starts[places]
        at = ranges(self.starts[places], sizes)
        self.scratch[term] = weight
        scores = np.bincount(np.repeat(np.arange(len(places)), sizes), weights=self.weight[at] * self.scratch[self.term[at]], minlength=len(places))
        self.scratch[term] = 0
        kept = np.lexsort((self.ids[places], -np.round(scores, 12)))[:NEIGHBOURS]
        return places[kept], scores[kept]

    def vote(self, places: np.ndarray, scores: np.ndarray, odds: float) -> float:
        """The toxic share of the closeness of the neighbours, labels weighed to their true shares."""
        near = 1 / (1.05 - np.minimum(scores, 1.0))
        near = near * np.where(self.toxic[places] == 1, odds, 1.0)
        return float(near[self.toxic[places] == 1].sum() / near.sum())


class Model:
    """Terms, their weights, the index and the calibration: all bounded by the texts of PER_LABEL examples of each label."""

    def __init__(self, place: dict[str, int], weights: np.ndarray, sizes: dict[int, int]):
        self.place, self.weights, self.sizes = place, weights, sizes
        self.index, self.odds, self.curve, self.bare = None, 1.0, np.zeros(0), 0.0
        self.share = {1: 0.0, 0: 0.0}

    def weigh(self, term: np.ndarray, count: np.ndarray) -> np.ndarray:
        w = (1 + np.log(count)) * self.weights[term]
        return w / max(np.sqrt((w * w).sum()), 1e-300)

    def learn(self, ids: np.ndarray, toxic: np.ndarray, vecs: list[tuple[np.ndarray, np.ndarray]]) -> None:
        n1, n0 = max(1, int((toxic == 1).sum())), max(1, int((toxic == 0).sum()))
        self.share = share = {1: self.sizes.get(1, 0) / n1, 0: self.sizes.get(0, 0) / n0}
        self.odds = share[1] / share[0] if share[0] else 1.0
        some = [i for i, (t, _) in enumerate(vecs) if len(t)]
        if some:
            self.index = Index(
                ids[some], toxic[some], np.repeat(np.arange(len(some)), [len(vecs[i][0]) for i in some]),
                np.concatenate([vecs[i][0] for i in some]), np.concatenate([self.weigh(*vecs[i]) for i in some]), len(self.place),
            )
        bare = np.setdiff1d(np.arange(len(ids)), some)
        y = toxic[bare]
        prior = self.sizes.get(1, 0) / max(1, sum(self.sizes.values()))
        self.bare = float((share[1] * (y == 1).sum() + prior) / (share[1] * (y == 1).sum() + share[0] * (y == 0).sum() + 1))

    def calibrate(self, toxic: np.ndarray, votes: np.ndarray) -> None:
        """From the labels of examples and the others' votes on them."""
        place = np.minimum(BINS - 1, (votes * BINS).astype(np.int64))
        seen = np.array([self.share[y] * np.bincount(place[toxic == y], minlength=BINS) for y in (0, 1)])
        middle = (np.arange(BINS) + 0.5) / BINS
        self.curve = np.maximum.accumulate((seen[1] + 2 * middle) / (seen.sum(0) + 2))

    def votes(self, vecs: list[tuple[np.ndarray, np.ndarray]], skip: list[int] | None = None) -> list[tuple[float | None, list[int], float]]:
        """For each text the vote of its neighbours (none without any), the nearest as evidence, and the best cosine."""
        if self.index is None:
            return [(None, [], 0.0)] * len(vecs)
        out = []
        for places, scores in self.index.nearest_of([(t, self.weigh(t, n)) for t, n in vecs], skip):
            vote = self.index.vote(places, scores, self.odds) if len(places) else None
            out.append((vote, self.index.ids[places[:3]].tolist(), float(min(1.0, scores[0])) if len(places) else 0.0))
        return out

    def scores(self, vecs: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[float, list[int], float]]:
        """The calibrated score, the nearest examples as evidence, and the best cosine of each text."""
        middle = (np.arange(BINS) + 0.5) / BINS
        return [(self.bare if v is None else float(np.interp(v, middle, self.curve)), near, best) for v, near, best in self.votes(vecs)]


def parts(batch: pa.RecordBatch, place: dict[str, int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Terms and counts of each text."""
    text, term, count = vectors(batch, place)
    cuts = np.searchsorted(text, np.arange(batch.num_rows + 1)).tolist()
    return [(term[a:b], count[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Learns from labelled rows whose crc32(doc_id as text) mod 5 isn't 0."""
    examples, sizes = labelled(docs, labels)
    terms, contrast = vocabulary(examples)
    context = docs.sparkSession.sparkContext
    places = {t: i for i, t in enumerate(terms)}
    place = context.broadcast(places)
    held, n = document_frequencies(docs, place, len(terms))
    model = Model(places, (np.log((1 + n) / (1 + held)) + 1) * contrast, sizes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=AT_ONCE_BYTES):
            vecs = parts(batch, place.value)
            lists = [pa.array([v[k] for v in vecs], pa.list_(pa.int32())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), *lists], ["doc_id", "toxic", "term", "n"])

    rows = examples.select("doc_id", "toxic", "text").mapInArrow(run, "doc_id long, toxic int, term array<int>, n array<int>").toArrow()
    columns = {c: [x for chunk in rows.column(c).chunks for x in ((chunk[i].values.to_numpy() for i in range(len(chunk))) if c in ("term", "n") else chunk.to_pylist())] for c in rows.column_names}
    order = sorted(range(rows.num_rows), key=lambda i: (columns["doc_id"][i], columns["term"][i].tobytes(), columns["n"][i].tobytes()))
    model.learn(*(np.array([columns[c][i] for i in order], np.int64) for c in ("doc_id", "toxic")), [(columns["term"][i], columns["n"][i]) for i in order])
    del rows, columns
    place.destroy()
    shared = context.broadcast(model)

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=AT_ONCE_BYTES):
            votes = [v for v, _, _ in shared.value.votes(parts(batch, shared.value.place), batch.column("doc_id").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(votes, pa.float64())], ["toxic", "vote"])

    # the examples lie in a few files; their search is dealt out
    dealt = examples.select("doc_id", "toxic", "text").repartition(max(1, context.defaultParallelism))
    votes = dealt.mapInArrow(judged, "toxic int, vote double").where("vote IS NOT NULL").toArrow()
    shared.destroy()
    model.calibrate(votes.column("toxic").to_numpy(), votes.column("vote").to_numpy())
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Adds score, evidence and nearest to doc_id of each row of documents."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, seen = shared.value, {}
        for batch in slices(batches, most=AT_ONCE_BYTES):
            vecs = parts(batch, model.place)
            keys = [hashlib.blake2b(t.tobytes() + n.tobytes(), digest_size=16).digest() for t, n in vecs]
            if len(seen) > REMEMBERED:
                seen.clear()
            new = {k: i for i, k in enumerate(keys) if k not in seen}
            seen.update(zip(new, model.scores([vecs[i] for i in new.values()])))
            out = [seen[k] for k in keys]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([o[0] for o in out], pa.float64()), pa.array([o[1] for o in out], pa.list_(pa.int64())), pa.array([o[2] for o in out], pa.float64())],
                ["doc_id", "score", "evidence", "nearest"],
            )

    columns = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return columns.mapInArrow(run, "doc_id long, score double, evidence array<long>, nearest double")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row of documents (doc_id, text): held_out, score, predicted, evidence, nearest.

    labels (doc_id, toxic) may hold nulls and repeated ids (the highest label stands). Labels, language,
    source and doc_id never enter a score. Null and empty texts, and texts without a term of the vocabulary, get the
    share of toxic examples among such texts. Without labels of both kinds all texts get one score, the
    known share (0 without labels). Repeated rows are scored each, no rows give none, other columns are
    ignored. held_out is whether crc32(doc_id as text) mod 5 is 0 (a null doc_id: false).
    """
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(FOLDS))
    return score(docs, fit(docs, labels)).select(
        "doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence", "nearest",
    )
