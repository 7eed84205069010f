"""Random draws as pure column expressions.

A draw depends only on ``(seed, template, row, slot, k)``; the number of
partitions, retries and speculative tasks cannot change it. One md5 digest seeds
each value; the elements of strings, texts and arrays come from integer
arithmetic on that seed, because a digest per element would dominate the cost.
Everything stays in signed 64-bit range, so ANSI overflow checks never fire.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

PRIME = 2147483647
STEP = 1099511628211
MULT_A = 1103515245
MULT_B = 1812433253
SPAN_LIMIT = 1 << 60
NARROW_SPAN = 1 << 16


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times inside one expression.

    Higher-order functions re-evaluate outer expressions for each element, so a
    digest used inside a ``transform`` has to be bound to a lambda variable.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def key60(seed: int, template: int, row_id: Column, slot: int, k: int = 0) -> Column:
    """Uniform integer in [0, 2**60) for one value."""
    text = F.concat(F.lit(f"{seed}|{template}|"), row_id.cast("string"), F.lit(f"|{slot}|{k}"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("bigint")


def element31(state: Column, k: Column) -> Column:
    """Uniform integer in [0, 2**31 - 1) for element ``k`` of the value seeded by ``state``."""
    y = state + k * STEP
    x = (y % PRIME).bitwiseXOR(F.shiftright(y, 30))
    x = x * MULT_A % PRIME
    x = x.bitwiseXOR(F.shiftright(x, 15))
    return x * MULT_B % PRIME


def element_draws(state: Column, count: Column) -> Column:
    """The draws of elements 1..count as an array; same values as ``element31``.

    Two nested transforms bind the intermediate values, so nothing is computed twice.
    ``count`` must be positive.
    """
    steps = F.sequence(state + STEP, state + count * STEP, F.lit(STEP))
    mixed = F.transform(
        steps, lambda y: (y % PRIME).bitwiseXOR(F.shiftright(y, 30)) * MULT_A % PRIME
    )
    return F.transform(mixed, lambda x: x.bitwiseXOR(F.shiftright(x, 15)) * MULT_B % PRIME)


def element_in(state: Column, k: Column, low: int, high: int) -> Column:
    """Uniform integer in [low, high] for element ``k``."""
    span = high - low + 1
    if span <= NARROW_SPAN:
        draw = element31(state, k)
    else:
        draw = element31(state, k * 2) * PRIME + element31(state, k * 2 + 1)
    return draw % span + low


def draws_in(state: Column, count: Column, span: int) -> Column:
    """``element_in(state, k, 0, span - 1)`` of elements 1..count as an array."""
    if span <= NARROW_SPAN:
        return F.transform(element_draws(state, count), lambda d: d % span)
    # Elements 2, 3, 4, ... in pairs.
    pairs = element_draws(state + STEP, count * 2)
    one = F.lit(1).cast("bigint")

    def joined(drawn: Column) -> Column:
        def pair(k: Column) -> Column:
            first = (k * 2 - 2).cast("int")
            return (F.get(drawn, first) * PRIME + F.get(drawn, first + 1)) % span

        return F.transform(F.sequence(one, count), pair)

    return let(pairs, joined)


def uniform_long(draw: Column, low: int, high: int) -> Column:
    """Map a 60-bit draw to an integer in [low, high]."""
    return draw % (high - low + 1) + low
