"""What to generate: templates, weights and run parameters, checked on the driver."""

from __future__ import annotations

import hashlib
import json
import re
from collections import Counter
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass, fields, replace
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftload.functions.patterns import (
    Increment,
    Pattern,
    Slot,
    Text,
    parse_pattern,
    placeholder_regex,
)
from weftload.functions.text import PagedVocabulary, Vocabulary

WEIGHT_TOLERANCE = Fraction(1, 1_000_000)
_BATCHABLE = re.compile(r"(insert|replace)", re.I)
_TUPLE = re.compile(r"(.*VALUES\s*)\((.*)\)(.*)", re.I | re.S)
_COLUMN_LIST = re.compile(r"\binto\s+\S+?\s*\(([^()]*)\)\s*values", re.I)


@dataclass(frozen=True)
class Placeholder:
    text: str
    start: int
    end: int
    pattern: Pattern
    name: str


@dataclass(frozen=True)
class Template:
    """A statement text with typed placeholders, compiled once."""

    sql: str
    placeholders: tuple[Placeholder, ...]
    tuple_span: tuple[int, int] | None

    @staticmethod
    def compile(
        sql: str, load_words: Callable[[str], Vocabulary | PagedVocabulary] | None = None
    ) -> Template:
        known: dict[str, Pattern] = {}
        found = []
        for match in placeholder_regex().finditer(sql):
            text = match.group(1)
            if text not in known:
                known[text] = parse_pattern(text, load_words)
            found.append((text, match.start(), match.end(), known[text]))
        # Placeholders are blanked so that brackets inside them cannot mislead the split.
        masked = sql
        for _, start, end, _ in found:
            masked = masked[:start] + "_" * (end - start) + masked[end:]
        split = _TUPLE.fullmatch(masked)
        span = None
        if split:
            if split.group(3).strip(" ;\r\n\t"):
                if _BATCHABLE.match(sql):
                    raise ValueError(f"text after the VALUES tuple is not supported: {sql}")
            span = (split.start(2), split.end(2))
        names = _slot_names(masked, span, found)
        return Template(
            sql,
            tuple(Placeholder(t, s, e, p, n) for (t, s, e, p), n in zip(found, names)),
            span,
        )

    @property
    def batchable(self) -> bool:
        """True for statements whose rows can be merged (no trimming, any case)."""
        return bool(_BATCHABLE.match(self.sql))

    @property
    def needs_rank(self) -> bool:
        return any(isinstance(p.pattern, Increment) for p in self.placeholders)

    @property
    def lookups(self) -> dict[int, Pattern]:
        """Texts that are looked up before the statement is put together, by slot."""
        paged = {i: p.pattern for i, p in enumerate(self.placeholders) if isinstance(p.pattern, Text)}
        return {i: p for i, p in paged.items() if isinstance(p.vocabulary, PagedVocabulary)}

    def slots(self, seed: int, index: int, row_id: Column, rank: Column) -> list[Slot]:
        """One slot per occurrence; equal increments count down from the right."""
        counters = [
            p.pattern if isinstance(p.pattern, Increment) else None for p in self.placeholders
        ]
        total = Counter(c for c in counters if c)
        seen: Counter = Counter()
        slots = []
        for number, counter in enumerate(counters):
            seen[counter] += 1
            slots.append(
                Slot(
                    seed, index, number, row_id, rank,
                    per_row=total[counter] if counter else 1,
                    from_right=total[counter] - seen[counter] if counter else 0,
                )
            )
        return slots

    def values(self, seed: int, index: int, row_id: Column, rank: Column) -> list[Column]:
        """Typed columns, one per placeholder."""
        return [
            p.pattern.column(slot).alias(p.name)
            for p, slot in zip(self.placeholders, self.slots(seed, index, row_id, rank))
        ]

    def render(
        self, values: Sequence[Column], start: int = 0, end: int | None = None
    ) -> Column:
        """The part ``sql[start:end]`` with values spliced in."""
        end = len(self.sql) if end is None else end
        pieces: list[Column] = []
        at = start
        for p, value in zip(self.placeholders, values):
            if p.start < start or p.end > end:
                continue
            if p.start > at:
                pieces.append(F.lit(self.sql[at : p.start]))
            pieces.append(p.pattern.render(value))
            at = p.end
        if at < end:
            pieces.append(F.lit(self.sql[at:end]))
        return F.concat(*pieces) if pieces else F.lit("")

    def statement(self, seed: int, index: int, row_id: Column, rank: Column) -> Column:
        raw = [p.pattern.column(s) for p, s in
               zip(self.placeholders, self.slots(seed, index, row_id, rank))]
        return self.render(raw)

    def tuple_text(self, seed: int, index: int, row_id: Column, rank: Column) -> Column:
        """``(v1, v2, ...)`` of one row."""
        start, end = self.require_tuple()
        raw = [p.pattern.column(s) for p, s in
               zip(self.placeholders, self.slots(seed, index, row_id, rank))]
        return F.concat(F.lit("("), self.render(raw, start, end), F.lit(")"))

    def prefix_text(self, seed: int, index: int, row_id: Column, rank: Column) -> Column:
        """Everything before the tuple."""
        start, _ = self.require_tuple()
        raw = [p.pattern.column(s) for p, s in
               zip(self.placeholders, self.slots(seed, index, row_id, rank))]
        return self.render(raw, 0, start - 1)

    @property
    def constant_prefix(self) -> bool:
        start, _ = self.require_tuple()
        return all(p.start >= start for p in self.placeholders)

    def require_tuple(self) -> tuple[int, int]:
        if self.tuple_span is None:
            raise ValueError(f"cannot batch a statement without a VALUES tuple: {self.sql}")
        return self.tuple_span


def _slot_names(masked: str, span, found) -> list[str]:
    """Column names from the INSERT column list where a value holds one placeholder."""
    default = [f"c{i + 1}" for i in range(len(found))]
    listed = _COLUMN_LIST.search(masked)
    if not (span and listed):
        return default
    names = [n.strip(" `\"") for n in listed.group(1).split(",")]
    bounds, depth_start, quoted = [], span[0], False
    for i in range(span[0], span[1]):
        if masked[i] == "'":
            quoted = not quoted
        elif masked[i] == "," and not quoted:
            bounds.append((depth_start, i))
            depth_start = i + 1
    bounds.append((depth_start, span[1]))
    if len(bounds) != len(names):
        return default
    result = list(default)
    for (start, end), name in zip(bounds, names):
        inside = [i for i, (_, s, e, _) in enumerate(found) if s >= start and e <= end]
        if len(inside) == 1:
            result[inside[0]] = name
    return result if len(set(result)) == len(result) else default


# What users of load distributions are told.
WRONG_COUNT = "load distribution must have {} values"
NEGATIVE = "load distribution values cannot be negative"
TOO_MUCH = "load distribution values cannot total more than 1"


def check_weights(weights: Sequence[float], count: int) -> list[Fraction]:
    """Exact weights, or an error that says what is wrong."""
    exact = [Fraction(str(w)) for w in weights]
    if len(exact) != count:
        raise ValueError(WRONG_COUNT.format(count))
    if any(w < 0 for w in exact):
        raise ValueError(NEGATIVE)
    missing = 1 - sum(exact)
    if missing < -WEIGHT_TOLERANCE:
        raise ValueError(TOO_MUCH)
    if missing > WEIGHT_TOLERANCE:
        raise ValueError(f"the weights leave {float(missing):g} of the load without a template")
    return exact


def parse_weights(text: str) -> list[float]:
    """``"0.3,0.7"`` to numbers."""
    values = []
    for part in text.split(","):
        try:
            values.append(float(part.strip()))
        except ValueError:
            raise ValueError(f"a weight that is no number: {part.strip()!r}") from None
    return values


@dataclass(frozen=True)
class WorkloadSpec:
    """One process: templates, mix and run parameters.

    ``threads`` and ``batch_sizes`` may hold several values, which makes a sweep; see
    ``sweep``.
    """

    load: tuple[str, ...]
    total: int
    weights: tuple[float, ...] | None = None
    threads: tuple[int, ...] = (1,)
    batch_sizes: tuple[int, ...] = (1,)
    iterations: int = 1
    init: str = ""
    seed: int = 42
    column: str = ""
    process_index: int = 1

    @staticmethod
    def of(load: str | Sequence[str], total: int, **options) -> WorkloadSpec:
        load = (load,) if isinstance(load, str) else tuple(load)
        for name, many in (("threads", "threads"), ("batch_size", "batch_sizes")):
            if name in options:
                options[many] = _int_list(options.pop(name))
        if isinstance(options.get("weights"), str):
            options["weights"] = tuple(parse_weights(options["weights"]))
        elif options.get("weights") is not None:
            options["weights"] = tuple(options["weights"])
        return WorkloadSpec(load, total, **options).validate()

    def validate(self) -> WorkloadSpec:
        where = f" for process {self.process_index}"
        if not self.load or not all(self.load):
            raise ValueError("load is required" + where)
        for name in ("total", "iterations"):
            if int(getattr(self, name)) <= 0:
                raise ValueError(f"{name} must be positive" + where)
        for name in ("threads", "batch_sizes"):
            values = getattr(self, name)
            if not values or any(v <= 0 for v in values):
                raise ValueError(f"{name} must be positive" + where)
        try:
            self.exact_weights()
        except ValueError as error:
            raise ValueError(str(error) + where) from None
        return self

    def exact_weights(self) -> list[Fraction]:
        """Weights are only looked at when there are several templates."""
        if len(self.load) == 1:
            return [Fraction(1)]
        if self.weights is None:
            return [Fraction(1, len(self.load))] * len(self.load)
        return check_weights(self.weights, len(self.load))

    def templates(
        self, load_words: Callable[[str], Vocabulary | PagedVocabulary] | None = None
    ) -> list[Template]:
        return [Template.compile(sql, load_words) for sql in self.load]

    def sweep(self) -> list[WorkloadSpec]:
        """One spec per (threads, batch size), threads outermost."""
        return [
            replace(self, threads=(t,), batch_sizes=(b,))
            for t in self.threads
            for b in self.batch_sizes
        ]

    @property
    def batch_size(self) -> int:
        if len(self.batch_sizes) != 1:
            raise ValueError("pick one batch size with sweep()")
        return self.batch_sizes[0]

    def fingerprint(self, content: dict[str, str] | None = None) -> str:
        """Identity of the generated data.

        Threads do not matter (all runs of a thread sweep share the data), neither does
        the degree of parallelism; the seed does, and so does the ``content`` that the
        templates stand for: a digest per word file, the make of a custom pattern.
        """
        parts = {name: value for name, value in asdict(self).items() if name in IDENTITY}
        parts["content"] = content or {}
        text = json.dumps(parts, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        return hashlib.md5(text.encode()).hexdigest()


#: What of a spec its data depends on, in order.
IDENTITY = ("batch_sizes", "init", "iterations", "load", "process_index", "seed", "total", "weights")


def fingerprint_column(parts: dict[str, Column]) -> Column:
    """``WorkloadSpec.fingerprint`` of specs that are held in columns, named as the fields of one.

    Absent fields are left at their defaults.
    """
    plain = {f.name: f.default for f in fields(WorkloadSpec)}

    def value(name: str) -> Column:
        if name in parts:
            return parts[name]
        default = plain[name]
        return F.array(*[F.lit(v) for v in default]) if isinstance(default, tuple) else F.lit(default)

    known = [value(name).alias(name) for name in IDENTITY]
    empty = F.create_map().cast("map<string,string>").alias("content")
    struct = F.struct(known[0], empty, *known[1:])
    return F.md5(F.to_json(struct, {"ignoreNullFields": "false"}))


def _int_list(value) -> tuple[int, ...]:
    if isinstance(value, int):
        return (value,)
    if isinstance(value, str):
        return tuple(int(v) for v in value.split(","))
    return tuple(value)


def with_defaults(options: dict, common: dict, defaults: dict) -> dict:
    """Process options over common options over defaults; unknown names are dropped."""
    merged = {**defaults, **{k: v for k, v in common.items() if k in defaults}}
    merged.update({k: v for k, v in options.items() if v is not None})
    return merged


def inherited(own: Column, common: Column, defaults: dict[str, object]) -> dict[str, Column]:
    """``with_defaults`` for options held as maps of text in columns: a column per known name."""
    return {
        name: F.coalesce(
            F.try_element_at(own, F.lit(name)), F.try_element_at(common, F.lit(name)),
            F.lit(None if value is None else str(value)),
        )
        for name, value in defaults.items()
    }


def swept(asked: DataFrame, threads: str = "threads", batch_sizes: str = "batch_sizes") -> DataFrame:
    """``WorkloadSpec.sweep`` for parameter lists held as text: a row per pair, threads outermost."""
    rest = [c for c in asked.columns if c not in (threads, batch_sizes)]
    runs = asked.select(*rest, F.explode(F.split(threads, ",")).alias("_t"), batch_sizes)
    runs = runs.select(*rest, "_t", F.explode(F.split(batch_sizes, ",")).alias("_b"))
    return runs.select(*rest, F.trim("_t").cast("int").alias("threads"), F.trim("_b").cast("int").alias("batch_size"))
