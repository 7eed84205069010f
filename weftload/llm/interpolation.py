"""Language-model scores by deleted interpolation of bigram, unigram and uniform estimates.

Counting and looking up share one exchange. Documents lie in chunks of bounded size. A chunk
sends each of its different keys (hashes of bigrams and words) once, with its count in the
chunk's training documents, to the part of the key space that owns it; the part adds the
counts up and answers every chunk in the order it asked. So a common word costs a part one
entry per chunk, however often it stands in the texts, and no table of counts is broadcast.

A chunk then knows, for every token, how often the token, its context and their bigram stand
in all training documents. Mixture weights are learned per bucket of context frequency by
expectation-maximisation on deleted counts: each training token is predicted from counts
without itself. What that needs of the tokens is a histogram of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftload.llm.words import mix, slices, split_words
from weftload.session import written_table

FOLDS, HELD_FOLD = 7, 2
CHUNK_BYTES = 8 << 20
#: Bytes of text for each part of the key space: its keys must fit in a task.
PART_BYTES = 8 << 20
END, WORD_KEY = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
BUCKETS, FINE = 48, 8
ROUNDS = 60

ASKED = "chunk int, part int, keys binary, counts binary"
TOLD = "chunk int, part int, counts binary, types long, tokens long"
COUNTED = (
    "kind int, doc_id long, held_out boolean, n_tokens long, n_known long, base_sum double, "
    "seen binary, bucket array<int>, ratio array<int>, single array<int>, weight array<long>, types long, tokens long"
)


def pressed(numbers: np.ndarray, kind: str = "<u4") -> bytes:
    """Byte planes side by side, compressed: most numbers are small."""
    width = np.dtype(kind).itemsize
    return zstandard.ZstdCompressor(level=1).compress(numbers.astype(kind).view(np.uint8).reshape(-1, width).T.tobytes())


def unpressed(data: bytes, kind: str = "<u4") -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def lookups(table: pa.Table) -> dict[str, np.ndarray]:
    """Tokens of a chunk, its different keys in order, and each token's keys among them.

    A document's tokens are its words and one end; its first context is the end as well.
    """
    words = split_words(table.column("text").combine_chunks())
    n_docs = len(words.starts) - 1
    ends = words.starts[1:] + np.arange(n_docs)
    token = np.full(len(words.codes) + n_docs, END)
    inner = np.ones(len(token), bool)
    inner[ends] = False
    if len(words.codes):
        token[inner] = words.hashes()[words.codes]
    context = np.concatenate([[END], token[:-1]])
    single = mix(token, np.full(len(token), WORD_KEY)) | np.uint64(1)
    double = mix(context, token) & ~np.uint64(1)
    keys, place = np.unique(np.concatenate([single, double]), return_inverse=True)
    return {"keys": keys, "single": place[: len(token)], "double": place[len(token) :], "starts": words.starts + np.arange(n_docs + 1)}


def ask(bits: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        """Every different key of the chunk with its count in training documents, cut by parts."""
        got = lookups(table)
        trained = np.repeat(~held(table), np.diff(got["starts"]))
        places = np.concatenate([got["single"][trained], got["double"][trained]])
        counts = np.bincount(places, minlength=len(got["keys"])).astype("<u4")
        part = (got["keys"] >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(got["keys"]), np.int64)
        parts, first = np.unique(part, return_index=True)
        cuts = list(zip(first, [*first[1:], len(part)]))
        return pa.table(
            [[key[0].as_py()] * len(parts), parts.astype(np.int32), [pressed(np.diff(got["keys"][a:b], prepend=np.uint64(0)), "<u8") for a, b in cuts], [pressed(counts[a:b]) for a, b in cuts]],
            schema=pa.schema([("chunk", pa.int32()), ("part", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())]),
        )

    return run


def held(table: pa.Table) -> np.ndarray:
    return table.column("held_out").combine_chunks().to_numpy(zero_copy_only=False).astype(bool)


def answer(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Counts over all chunks, for each chunk in the order it asked; chunk -1 gets the part's totals."""
    chunks = table.column("chunk").to_pylist()
    keys = [np.cumsum(unpressed(b.as_py(), "<u8"), dtype=np.uint64) for b in table.column("keys").combine_chunks()]
    counts = [unpressed(b.as_py()) for b in table.column("counts").combine_chunks()]
    different, place = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(place, np.concatenate(counts), len(different)).astype(np.int64)
    words = (different & np.uint64(1)) == 1
    ends = np.cumsum([len(k) for k in keys])
    told = [pressed(total[place[e - len(k) : e]], "<u8") for e, k in zip(ends, keys)]
    n, part = len(chunks), key[0].as_py()
    return pa.table(
        [[*chunks, -1], [part] * (n + 1), [*told, b""], [0] * n + [int((words & (total > 0)).sum())], [0] * n + [int(total[words].sum())]],
        schema=pa.schema([("chunk", pa.int32()), ("part", pa.int32()), ("counts", pa.binary()), ("types", pa.int64()), ("tokens", pa.int64())]),
    )


def bucket_of(context: np.ndarray) -> np.ndarray:
    """Contexts never seen, seen once, twice, up to 4, 8, ... times."""
    return np.minimum(np.ceil(np.log2(np.maximum(context, 1))).astype(np.int64) + (context > 0), BUCKETS - 1)


def empty_rows(n: int) -> dict:
    return {name.split()[0]: [None] * n for name in COUNTED.split(", ")}


SCHEMA = pa.schema(
    [("kind", pa.int32()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_sum", pa.float64()), ("seen", pa.binary())]
    + [(n, pa.list_(pa.int32())) for n in ("bucket", "ratio", "single")] + [("weight", pa.list_(pa.int64())), ("types", pa.int64()), ("tokens", pa.int64())]
)


def count(key: tuple[pa.Scalar, ...], docs: pa.Table, told: pa.Table) -> pa.Table:
    """Kind 0: a document with what its tokens' counts are; kind 1: the chunk's histogram of deleted
    counts; kind 2: totals of the training tokens."""
    if not docs.num_rows:
        out = empty_rows(1) | {"kind": [2], "types": [sum(told.column("types").to_pylist())], "tokens": [sum(told.column("tokens").to_pylist())]}
        return pa.table(out, schema=SCHEMA)
    got = lookups(docs)
    told = told.sort_by("part")
    counts = np.concatenate([unpressed(b.as_py(), "<u8") for b in told.column("counts").combine_chunks()]).astype(np.int64)
    single, double, starts = counts[got["single"]], counts[got["double"]], got["starts"]
    n = np.diff(starts)
    rows = np.repeat(np.arange(len(n)), n)
    last = single[starts[1:] - 1]
    context = np.concatenate([[0], single[:-1]])
    context[starts[:-1]] = last  # the end's count is the number of training documents
    trained = np.flatnonzero(~held(docs)[rows])
    c2, c1, c0 = double[trained] - 1, single[trained] - 1, context[trained] - 1
    ratio = np.where(c2 > 0, 1 + np.round(FINE * np.log2(np.maximum(c0, 1) / np.maximum(c2, 1))), 0).astype(np.int64)
    alone = np.where(c1 > 0, 1 + np.round(FINE * np.log2(np.maximum(c1, 1))), 0).astype(np.int64)
    cell = (bucket_of(c0) * 4096 + ratio) * 4096 + alone
    cells, weight = np.unique(cell, return_counts=True)
    out, m = empty_rows(len(n) + 1), len(n)
    out["kind"] = [0] * m + [1]
    out["doc_id"] = docs.column("doc_id").to_pylist() + [None]
    out["held_out"] = held(docs).tolist() + [None]
    out["n_tokens"] = n.tolist() + [None]
    out["n_known"] = np.bincount(rows, single > 0, m).astype(np.int64).tolist() + [None]
    out["base_sum"] = np.bincount(rows, np.log10(single + 1), m).tolist() + [None]
    out["seen"] = [pressed(np.concatenate([single[a:b], double[a:b], context[a : a + 1]]), "<u8") for a, b in zip(starts[:-1], starts[1:])] + [None]
    for name, values in (("bucket", cells // 4096 // 4096), ("ratio", cells // 4096 % 4096), ("single", cells % 4096), ("weight", weight)):
        out[name] = [None] * m + [values.tolist()]
    return pa.table(out, schema=SCHEMA)


def learn(cells: np.ndarray, tokens: int, types: int) -> np.ndarray:
    """Weights of bigram, unigram and uniform for each bucket, by expectation-maximisation.

    A bucket without deleted counts takes the weights over all buckets.
    """
    bucket, ratio, single, weight = cells.T if len(cells) else np.zeros((4, 0))
    p = np.stack([
        np.where(ratio > 0, 2.0 ** (-(ratio - 1) / FINE), 0.0),
        np.where(single > 0, 2.0 ** ((single - 1) / FINE) / max(tokens - 1, 1), 0.0),
        np.full(len(bucket), 1 / (types + 1)),
    ])

    def fitted(mine: np.ndarray, start: np.ndarray) -> np.ndarray:
        if not mine.any():
            return start
        mixture, q, w = np.full(3, 1 / 3), p[:, mine], weight[mine]
        for _ in range(ROUNDS):
            share = mixture[:, None] * q
            mixture = (share / share.sum(0) * w).sum(1)
            mixture /= mixture.sum()
        return np.maximum(mixture, 1e-9) / np.maximum(mixture, 1e-9).sum()

    common = fitted(np.ones(len(bucket), bool), np.full(3, 1 / 3))
    return np.stack([fitted(bucket == b, common) for b in range(BUCKETS)])


def log_probability(single, double, context, mixture: np.ndarray, tokens: int, types: int) -> np.ndarray:
    """Per token; in a context never seen, the bigram's share goes to the other two in proportion."""
    m = mixture[bucket_of(context)].copy()
    never = context == 0
    m[never, 0] = 0
    m /= m.sum(1, keepdims=True)
    return np.log10(m[:, 0] * double / np.maximum(context, 1) + m[:, 1] * single / max(tokens, 1) + m[:, 2] / (types + 1))


def lm_scores(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES, part_bytes: int = PART_BYTES) -> DataFrame:
    """Per row of documents (doc_id, text; other columns are ignored): held_out, n_tokens, n_known,
    train_tokens, base_score and score.

    Documents whose crc32(doc_id as text) mod 7 is 2 are held out; a null doc_id is trained on. A null or
    empty text is one end token. Repeated rows count and are scored each. Without training documents
    every token is unknown (train_tokens 0); no rows give none. Tasks hold one chunk of documents or one
    part of the keys; the driver gets the histogram's cells (at most its bins) and two totals.
    """
    crc = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(FOLDS))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(crc == HELD_FOLD, F.lit(False)).alias("held_out"))
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text") + 8), F.lit(0))).first()[0]
    chunks, bits = max(1, -(-size // chunk_bytes)), max(0, int(np.ceil(np.log2(max(1, size / part_bytes)))))
    spread = docs.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("int"))
    asked = spread.groupBy("chunk").applyInArrow(ask(bits), ASKED)
    told = asked.groupBy("part").applyInArrow(answer, TOLD)
    counted = written_table(spread.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(count, COUNTED), "counted")
    totals = counted.where("kind = 2").agg(F.coalesce(F.sum("types"), F.lit(0)), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    types, tokens = totals
    zipped = F.explode(F.arrays_zip("bucket", "ratio", "single", "weight")).alias("c")
    cells = counted.where("kind = 1").select(zipped).select("c.*").groupBy("bucket", "ratio", "single").agg(F.sum("weight")).collect()
    mixture = learn(np.array([tuple(r) for r in cells], np.float64).reshape(-1, 4), tokens, types)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "seen", 2 << 20):
            scores = []
            for data, n in zip(batch.column("seen"), batch.column("n_tokens").to_pylist()):
                seen = unpressed(data.as_py(), "<u8").astype(np.int64)
                single, double = seen[:n], seen[n : 2 * n]
                context = np.concatenate([seen[2 * n :], single[:-1]])
                scores.append(float(log_probability(single, double, context, mixture, tokens, types).sum()))
            kept = [batch.column(c) for c in ("doc_id", "held_out", "n_tokens", "n_known", "base_sum")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(scores, pa.float64())], ["doc_id", "held_out", "n_tokens", "n_known", "base_sum", "score"])

    scored = counted.where("kind = 0").select("doc_id", "held_out", "n_tokens", "n_known", "base_sum", "seen")
    scored = scored.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, base_sum double, score double")
    return scored.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base_sum") - F.col("n_tokens") * F.log10(F.lit(float(tokens + types + 1)))).alias("base_score"), "score",
    )
