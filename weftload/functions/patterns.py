"""Typed placeholders: parsing their text and turning them into columns.

A placeholder becomes a column expression over ``row_id`` (the row's 0-based number)
and ``rank`` (its number among the rows of its template). Only built-in expressions
are used, so generated columns that nobody reads are pruned by the optimizer.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftload.functions.draws import (
    NARROW_SPAN,
    SPAN_LIMIT,
    element_draws,
    element_in,
    key60,
    let,
    uniform_long,
)
from weftload.functions.text import PagedVocabulary, Vocabulary, lookup_name, text_column

# The placeholder types of the template language.
KNOWN_TYPES = [
    "increment", "string", "text", "int", "bigint", "float", "boolean", "array", "array_float",
]
LETTERS = "abcdefghijklmnopqrstuvwxyz"
DECIMALS = 8
GRID = 10**DECIMALS


@dataclass(frozen=True)
class Slot:
    """Where a value is needed: everything a pattern may depend on."""

    seed: int
    template: int
    slot: int
    row_id: Column
    rank: Column
    per_row: int = 1
    from_right: int = 0

    def key(self) -> Column:
        return key60(self.seed, self.template, self.row_id, self.slot)


@dataclass(frozen=True)
class Pattern:
    """Base of all placeholder types."""

    def column(self, at: Slot) -> Column:
        raise NotImplementedError

    def render(self, value: Column) -> Column:
        """The value as it is written into a statement."""
        return value.cast("string")


def _check_range(low, high, what: str) -> None:
    if low > high:
        raise ValueError(f"{what}: minimum {low} is above maximum {high}")
    if high - low + 1 > SPAN_LIMIT:
        raise ValueError(f"{what}: range is wider than 2**60")


def _check_size(low: int, high: int, what: str) -> None:
    _check_range(low, high, what)
    if low < 0:
        raise ValueError(f"{what}: sizes cannot be negative")


@dataclass(frozen=True)
class Increment(Pattern):
    """A counter per template and definition, as a closed form of the rank.

    When a definition occurs several times in a row, the rightmost gets the lowest value.
    """

    start: int = 1

    def column(self, at: Slot) -> Column:
        return (at.rank * at.per_row + (self.start + at.from_right)).cast("bigint")


@dataclass(frozen=True)
class Int(Pattern):
    low: int
    high: int

    def __post_init__(self) -> None:
        _check_range(self.low, self.high, "int")

    def column(self, at: Slot) -> Column:
        return uniform_long(at.key(), self.low, self.high)


def _grid(value: Decimal) -> int:
    return int(value * GRID)


@dataclass(frozen=True)
class Float(Pattern):
    """Uniform on a grid of 1e-8."""

    low: Decimal
    high: Decimal

    def __post_init__(self) -> None:
        _check_range(_grid(self.low), _grid(self.high), "float")

    def column(self, at: Slot) -> Column:
        return uniform_long(at.key(), _grid(self.low), _grid(self.high)).cast("double") / GRID

    def render(self, value: Column) -> Column:
        return value.cast(f"decimal(28,{DECIMALS})").cast("string")


@dataclass(frozen=True)
class Boolean(Pattern):
    """0 or 1."""

    def column(self, at: Slot) -> Column:
        return (at.key() % 2).cast("int")


@dataclass(frozen=True)
class String(Pattern):
    """Lower-case letters, length uniform."""

    low: int = 3
    high: int = 10

    def __post_init__(self) -> None:
        _check_size(self.low, self.high, "string")

    def column(self, at: Slot) -> Column:
        def letters(state: Column) -> Column:
            def of_length(length: Column) -> Column:
                picked = F.transform(
                    element_draws(state, length),
                    lambda d: F.substring(F.lit(LETTERS), (d % 26 + 1).cast("int"), F.lit(1)),
                )
                text = F.array_join(picked, "")
                return F.when(length > 0, text).otherwise(F.lit("")) if self.low == 0 else text

            return let(element_in(state, F.lit(0).cast("bigint"), self.low, self.high), of_length)

        return let(at.key(), letters)


@dataclass(frozen=True)
class Text(Pattern):
    """Words with marks; see ``weftload.functions.text``."""

    low: int = 20
    high: int = 300
    vocabulary: Vocabulary | PagedVocabulary = field(default_factory=Vocabulary.default)
    path: str | None = None

    def __post_init__(self) -> None:
        _check_size(self.low, self.high, "text")

    def column(self, at: Slot) -> Column:
        if isinstance(self.vocabulary, PagedVocabulary):
            return F.col(lookup_name(at.template, at.slot))
        return text_column(at.key(), self.low, self.high, self.vocabulary)


def _element_array(at: Slot, size_low: int, size_high: int, low: int, high: int) -> Column:
    """Array of integers in [low, high]; a drawn size of 0 gives an empty array."""

    def elements(state: Column) -> Column:
        def of_size(size: Column) -> Column:
            if high - low + 1 <= NARROW_SPAN:
                values = F.transform(
                    element_draws(state, size), lambda d: d % (high - low + 1) + low
                )
            else:
                one = F.lit(1).cast("bigint")
                values = F.transform(
                    F.sequence(one, size), lambda k: element_in(state, k, low, high)
                )
            if size_low > 0:
                return values
            return F.when(size > 0, values).otherwise(F.array().cast("array<bigint>"))

        return let(element_in(state, F.lit(0).cast("bigint"), size_low, size_high), of_size)

    return let(at.key(), elements)


@dataclass(frozen=True)
class Array(Pattern):
    size_low: int
    size_high: int
    low: int
    high: int

    def __post_init__(self) -> None:
        _check_size(self.size_low, self.size_high, "array size")
        _check_range(self.low, self.high, "array")

    def column(self, at: Slot) -> Column:
        return _element_array(at, self.size_low, self.size_high, self.low, self.high)

    def render(self, value: Column) -> Column:
        return F.array_join(value.cast("array<string>"), ",")


@dataclass(frozen=True)
class ArrayFloat(Pattern):
    size_low: int
    size_high: int
    low: Decimal
    high: Decimal

    def __post_init__(self) -> None:
        _check_size(self.size_low, self.size_high, "array_float size")
        _check_range(_grid(self.low), _grid(self.high), "array_float")

    def column(self, at: Slot) -> Column:
        grid = _element_array(
            at, self.size_low, self.size_high, _grid(self.low), _grid(self.high)
        )
        return F.transform(grid, lambda g: g.cast("double") / GRID)

    def render(self, value: Column) -> Column:
        return F.array_join(value.cast(f"array<decimal(28,{DECIMALS})>").cast("array<string>"), ",")


@dataclass(frozen=True)
class Exact(Pattern):
    """Text that is no known type: a quoted literal with quotes and slashes escaped."""

    text: str

    def column(self, at: Slot) -> Column:
        return F.lit("'" + re.sub(r"(['\"\\])", r"\\\1", self.text) + "'")


PLACEHOLDER = re.compile("<((?:" + "|".join(KNOWN_TYPES) + ")[^>]*)>")
_VOCABULARY_FORM = re.compile(r"text/\{([^}]+)\}/(\d+)/(\d+)")

_CUSTOM: dict[str, Callable[[list[str]], Pattern]] = {}


def register_pattern(name: str, make: Callable[[list[str]], Pattern]) -> None:
    """Add a placeholder type. ``make`` gets the ``/``-separated arguments."""
    if name in KNOWN_TYPES:
        raise ValueError(f"{name} is a built-in type")
    _CUSTOM[name] = make


def placeholder_regex() -> re.Pattern[str]:
    if not _CUSTOM:
        return PLACEHOLDER
    names = sorted([*KNOWN_TYPES, *_CUSTOM], key=len, reverse=True)
    return re.compile("<((?:" + "|".join(map(re.escape, names)) + ")[^>]*)>")


def parse_pattern(
    text: str, load_words: Callable[[str], Vocabulary | PagedVocabulary] | None = None
) -> Pattern:
    """Turn the text between ``<`` and ``>`` into a pattern."""
    match = _VOCABULARY_FORM.fullmatch(text)
    if match:
        if load_words is None:
            raise ValueError("a vocabulary file needs a loader")
        path, low, high = match.groups()
        return Text(int(low), int(high), load_words(path), path)
    kind, *args = text.split("/")
    if kind in _CUSTOM:
        return _CUSTOM[kind](args)
    if kind not in KNOWN_TYPES:
        return Exact(text)
    if kind == "increment":
        return Increment(int(args[0])) if args else Increment()
    if kind == "boolean":
        return Boolean()
    wanted = 4 if kind.startswith("array") else 2
    if len(args) != wanted:
        raise ValueError(f"<{text}>: {kind} takes {wanted} arguments")
    if kind == "string":
        return String(int(args[0]), int(args[1]))
    if kind == "text":
        return Text(int(args[0]), int(args[1]))
    if kind in ("int", "bigint"):
        return Int(int(args[0]), int(args[1]))
    if kind == "float":
        return Float(Decimal(args[0]), Decimal(args[1]))
    sizes = int(args[0]), int(args[1])
    if kind == "array":
        return Array(*sizes, int(args[2]), int(args[3]))
    return ArrayFloat(*sizes, Decimal(args[2]), Decimal(args[3]))
