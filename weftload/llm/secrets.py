"""Secret scans: known patterns, and formats learned from the credentials that these find.

A sample of the credentials found by the patterns trains probabilistic automata, one per kind:
prefix-tree states whose statistics are compatible are merged, so what stays is the format (a
fixed start, an alphabet, a length) and not the credentials. Every run of credential letters in
every text is then scored, whatever its length and also beside a pattern's span: how much likelier it is
under a format than as ordinary text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftload.llm.words import slices

KINDS = ("assign", "access", "hex", "format")
# The base patterns and the least lengths of what they must hold.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # a run of hex letters is one match, so the length may stand in the pattern
LEAST_ASSIGN, LEAST_ACCESS = 12, 18
CUES = ("passw", "secret", "token", "api")
#: Runs that may be credentials: all of these are scored.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{12,}")
ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/_.=-"
CODE = np.full(256, 0, np.int64)
CODE[[ord(c) for c in ALPHABET]] = np.arange(len(ALPHABET))
A = len(ALPHABET)

#: Credentials of each kind that train an automaton, the longest of them, and the certainty of a state test.
SAMPLE, LONGEST, ALPHA = 600, 128, 0.01
#: A run must be this much likelier (natural logarithm) under a format than as ordinary text.
LIKELIER, UNSEEN, SMALL = 14.0, np.log(1e-7), 0.05
#: Times that each pair of letters counts as seen in ordinary text: a rare run must not vouch for itself.
PRIOR = 10.0
#: Runs that are scored one by one once no others last as long.
FEW = 16


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, in order."""
    out = [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    if any(c in low for low in (text.lower(),) for c in CUES):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    return sorted(out)


def credential(text: str, start: int, kind: int, end: int) -> str:
    return ASSIGN.match(text, start, end)[2] if kind == 0 else text[start:end]


def merged(spans: list[tuple[int, int, int]]) -> list[list[int]]:
    """What the spans cover, as disjoint stretches in order."""
    out: list[list[int]] = []
    for s, _, e in spans:
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


def ordinary(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Runs of credential letters that meet no base span."""
    found = [m.span() for m in CANDIDATE.finditer(text)]
    if not spans or not found:
        return found
    starts, ends = np.array(merged(spans)).T
    a, b = np.array(found).T
    k = np.searchsorted(ends, a, "right")
    free = (k == len(starts)) | (starts[np.minimum(k, len(starts) - 1)] >= b)
    return [f for f, ok in zip(found, free) if ok]


def candidates(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Runs of credential letters; of one that meets base spans, all that these leave."""
    out, at = [], 0
    for s, e in [*merged(spans), (len(text), len(text))]:
        out += [m.span() for m in CANDIDATE.finditer(text, at, s)]
        at = e
    return out


@dataclass
class State:
    n: int = 0
    final: int = 0
    to: dict[str, "State"] = field(default_factory=dict)
    moves: dict[str, int] = field(default_factory=dict)
    merged: "State | None" = None

    def real(self) -> "State":
        """The state that this one has become part of, or itself."""
        at = self
        while at.merged is not None:
            at = at.merged
        return at

    def after(self, letter: str) -> "State":
        return self.to[letter].real()


def prefix_tree(words: list[str]) -> State:
    root = State()
    for word in words:
        at = root
        at.n += 1
        for c in word:
            at.moves[c] = at.moves.get(c, 0) + 1
            at = at.to.setdefault(c, State())
            at.n += 1
        at.final += 1
    return root


def alike(x: State, y: State, alpha: float) -> bool:
    """Whether ends and moves of both, and of all that follows, may come from one distribution (Hoeffding)."""
    todo, seen, scale = [(x, y)], set(), np.sqrt(0.5 * np.log(2 / alpha))
    while todo:
        a, b = todo.pop()
        if a is b or (id(a), id(b)) in seen:
            continue
        seen.add((id(a), id(b)))
        gap = scale * (a.n**-0.5 + b.n**-0.5)
        if abs(a.final / a.n - b.final / b.n) > gap:
            return False
        for c in a.moves.keys() | b.moves.keys():
            if abs(a.moves.get(c, 0) / a.n - b.moves.get(c, 0) / b.n) > gap:
                return False
        todo += [(a.after(c), b.after(c)) for c in sorted(a.to.keys() & b.to.keys())]
    return True


def merge(into: State, other: State) -> None:
    """Makes two states one, and so what follows both by the same letter."""
    todo = [(into, other)]
    while todo:
        a, b = (s.real() for s in todo.pop())
        if a is b:
            continue
        b.merged, a.n, a.final = a, a.n + b.n, a.final + b.final
        for c, k in b.moves.items():
            a.moves[c] = a.moves.get(c, 0) + k
            if c in a.to:
                todo.append((a.to[c], b.to[c]))
            else:
                a.to[c] = b.to[c]


def below(states: list[State]) -> list[State]:
    """The states that follow, each once, the most frequent first."""
    found = {id(s.after(c)): s.after(c) for s in states for c in sorted(s.to)}
    return sorted(found.values(), key=lambda s: -s.n)


def merge_alike(states: list[State], kept: list[State], alpha: float) -> None:
    """Merges each state with the first kept one that is alike, or keeps it."""
    for state in states:
        state = state.real()
        if any(state is k.real() for k in kept):
            continue
        match = next((k for k in (k.real() for k in kept) if alike(k, state, alpha)), None)
        if match is None:
            kept.append(state)
        else:
            merge(match, state)


def infer(words: list[str], alpha: float = ALPHA) -> list[State]:
    """States of the automaton, the first one first.

    States of one depth are compared first, from the top down: together they have the evidence that
    single ones lack. Then those of different depths are compared, which turns repetition into loops.
    """
    root = prefix_tree(words)
    level = [root]
    while level:
        kept: list[State] = []
        merge_alike(below(level), kept, alpha)
        level = list({id(k.real()): k.real() for k in kept}.values())
    kept, level = [root], [root]
    while level:
        known = {id(k.real()) for k in kept}
        merge_alike([s for s in below(level) if id(s) not in known], kept, alpha)
        level = [k for k in {id(k.real()): k.real() for k in kept}.values() if id(k) not in known]
    out, seen = [root.real()], {id(root.real())}
    for state in out:
        for c in sorted(state.to):
            if id(state.after(c)) not in seen:
                seen.add(id(state.after(c)))
                out.append(state.after(c))
    return out


class Format:
    """An automaton as tables of next states and logarithms of probabilities."""

    def __init__(self, words: list[str]):
        states = infer(words)
        number = {id(s): i for i, s in enumerate(states)}
        self.next = np.zeros((len(states), A), np.int64)
        self.log = np.zeros((len(states), A))
        self.end = np.full(len(states), UNSEEN)
        for i, s in enumerate(states):
            if s.final:
                self.end[i] = np.log(s.final / s.n)
            # a letter not seen here gets a small share, and goes where most letters go
            self.log[i] = np.log(SMALL / (s.n + SMALL * A))
            self.next[i] = number[id(s.after(max(s.moves, key=s.moves.get)))] if s.moves else i
            for c, k in s.moves.items():
                self.next[i, ALPHABET.index(c)] = number[id(s.after(c))]
                self.log[i, ALPHABET.index(c)] = np.log((k + SMALL) / (s.n + SMALL * A))

    def likelihoods(self, codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Logarithm of each run's probability; runs advance side by side, what is left of the FEW longest one by one."""
        order = np.argsort(-sizes, kind="stable")
        state, total = np.zeros(len(sizes), np.int64), np.zeros(len(sizes))
        together = int(sizes[order[FEW]]) if len(sizes) > FEW else 0
        lasting = np.searchsorted(-sizes[order], -np.arange(1, together + 1), "right")
        for k, n in enumerate(lasting.tolist()):
            live = order[:n]
            c = codes[starts[live] + k]
            total[live] += self.log[state[live], c]
            state[live] = self.next[state[live], c]
        longest = [i for i in order[:FEW].tolist() if sizes[i] > together]
        if longest:
            after, log = self.next.tolist(), self.log.tolist()
        for i in longest:
            at, sum_ = int(state[i]), float(total[i])
            for c in codes[starts[i] + together : starts[i] + sizes[i]].tolist():
                sum_ += log[at][c]
                at = after[at][c]
            state[i], total[i] = at, sum_
        return total + self.end[state]


@dataclass
class Model:
    formats: list[Format]
    ordinary: np.ndarray  # logarithms: first letter or letter before, then letter

    def scores(self, runs: list[bytes]) -> np.ndarray:
        """By how much each run is likelier under its best format than as ordinary text."""
        sizes = np.fromiter(map(len, runs), np.int64, len(runs))
        if not len(sizes):
            return np.zeros(0)
        starts = np.cumsum(sizes) - sizes
        codes = CODE[np.frombuffer(b"".join(runs), np.uint8)]
        before = np.concatenate([[A], codes[:-1]])
        before[starts] = A
        plain = np.add.reduceat(self.ordinary[before, codes], starts)
        best = np.full(len(runs), -np.inf)
        for f in self.formats:
            best = np.maximum(best, f.likelihoods(codes, starts, sizes))
        return best - plain


def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Credentials by kind, and under kind -1 how often letters follow each other in ordinary runs."""
    pairs = np.zeros((A + 1) * A, np.int64)
    for batch in slices(batches):
        kinds, values, runs = [], [], []
        for text in batch.column("text").to_pylist():
            text = text or ""
            spans = base_spans(text)
            for s, k, e in spans:
                value = credential(text, s, k, e)
                if len(value) <= LONGEST:
                    kinds.append(k)
                    values.append(value)
            runs += [text[a:b] for a, b in ordinary(text, spans)]
        if runs:
            sizes = np.fromiter(map(len, runs), np.int64, len(runs))
            codes = CODE[np.frombuffer("".join(runs).encode(), np.uint8)]
            before = np.concatenate([[A], codes[:-1]])
            before[np.cumsum(sizes) - sizes] = A
            pairs += np.bincount(before * A + codes, minlength=len(pairs))
        yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(values, pa.string()), pa.array([1] * len(kinds), pa.int64())], ["kind", "value", "n"])
    seen = np.flatnonzero(pairs)
    yield pa.RecordBatch.from_arrays([pa.array([-1] * len(seen), pa.int32()), pa.array([str(i) for i in seen], pa.string()), pa.array(pairs[seen], pa.int64())], ["kind", "value", "n"])


def fit(docs: DataFrame) -> Model:
    """Formats from SAMPLE different credentials of each kind (those of the smallest hashes); letters of
    ordinary runs are counted over all documents."""
    found = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(gather, "kind int, value string, n long")
    found = found.groupBy("kind", "value").agg(F.sum("n").alias("n"))
    pairs = np.full((A + 1, A), PRIOR)
    words: dict[int, list[str]] = {0: [], 1: [], 2: []}
    first = F.row_number().over(Window.partitionBy("kind").orderBy(F.xxhash64("value"), "value"))
    rows = found.withColumn("rank", F.when(F.col("kind") < 0, F.lit(0)).otherwise(first)).where(F.col("rank") <= SAMPLE)
    for r in rows.collect():
        if r.kind < 0:
            pairs.flat[int(r.value)] += r.n
        else:
            words[r.kind].append(r.value)
    formats = [Format(sorted(w)) for w in words.values() if w]
    return Model(formats, np.log(pairs / pairs.sum(1, keepdims=True)))


def spans_of(texts: list[str | None], model: Model) -> list[tuple[list, list[float]]]:
    """For each text all spans in order, and the scores of the added ones."""
    base = [base_spans(t or "") for t in texts]
    places = [candidates(t or "", b) for t, b in zip(texts, base)]
    runs = [t[a:b].encode() for t, p in zip(texts, places) for a, b in p]
    scores = model.scores(runs).tolist() if runs else []
    out, at = [], 0
    for b, p in zip(base, places):
        mine = scores[at : at + len(p)]
        at += len(p)
        added = [(x, s) for x, s in zip(p, mine) if s >= LIKELIER]
        out.append((sorted([*b, *((x, 3, y) for (x, y), _ in added)]), [s for _, s in added]))
    return out


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """Per row of documents (doc_id, text): n_assign, n_access, n_hex, base_sha256, spans, n_format, best.

    Spans are kind:start:end in code points, the end excluded, by start and then kind; base_sha256 is over
    the base ones. Null texts are empty; without spans the strings are empty. Repeated rows are scanned
    each, a null doc_id stays null, other columns are ignored, no rows give none. Without credentials in
    any text nothing is added. A task holds the formats (at most SAMPLE credentials' states) and one slice.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model or fit(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for spans, scores in spans_of(batch.column("text").to_pylist(), shared.value):
                base = [s for s in spans if s[1] < 3]
                n = [sum(s[1] == k for s in spans) for k in range(4)]
                rows.append((*n[:3], hashlib.sha256(written(base).encode()).hexdigest(), written(spans), n[3], max(scores, default=None)))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.float64()]
            columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_format", "best"])

    columns = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return columns.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_format long, best double")


MASK = "[secret]"


def redact(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """The same rows and columns, every span of a text replaced by a mask (overlapping spans by one); n_chars follows."""
    shared = docs.sparkSession.sparkContext.broadcast(model or fit(docs))
    names = docs.columns

    def masked(text: str | None, spans: list[tuple[int, int, int]]) -> str | None:
        out, at = [], 0
        for s, _, e in spans:
            if s >= at:
                out += [text[at:s], MASK]
            at = max(at, e)
        return "".join([*out, text[at:]]) if spans else text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column("text").to_pylist()
            new = [masked(t, spans) for t, (spans, _) in zip(texts, spans_of(texts, shared.value))]
            columns = {n: batch.column(n) for n in names} | {"text": pa.array(new, batch.schema.field("text").type)}
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out
