"""Pieces of the checking SQL: the draws, written out for the checking tool."""

from __future__ import annotations

from weftload.functions.draws import MULT_A, MULT_B, NARROW_SPAN, PRIME, STEP


def key60(template: int, slot: int, row: str = "row_id", seed: int = 42, k: int = 0) -> str:
    text = f"'{seed}|{template}|' || {row} || '|{slot}|{k}'"
    return f"('0x' || substr(md5({text}), 1, 15))::BIGINT"


def _first_round(y: str) -> str:
    return f"(xor(({y}) % {PRIME}, ({y}) >> 30) * {MULT_A} % {PRIME})"


def _second_round(x: str) -> str:
    return f"(xor({x}, ({x}) >> 15) * {MULT_B} % {PRIME})"


def element31(state: str, k: str) -> str:
    return _second_round(_first_round(f"{state} + ({k}) * {STEP}"))


def element_in(state: str, k: str, low: int, high: int) -> str:
    span = high - low + 1
    if span <= NARROW_SPAN:
        draw = element31(state, k)
    else:
        draw = f"({element31(state, f'({k}) * 2')} * {PRIME} + {element31(state, f'({k}) * 2 + 1')})"
    return f"({draw} % {span} + {low})"


def element_list(state: str, count: str) -> str:
    """Draws of elements 1..count."""
    steps = f"list_transform(range(1, {count} + 1), lambda k: {state} + k * {STEP})"
    mixed = f"list_transform({steps}, lambda y: {_first_round('y')})"
    return f"list_transform({mixed}, lambda x: {_second_round('x')})"


def strings(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def nearest_rank(value: str, keys: str, source: str, percents: list[int], prefix: str = "p") -> str:
    """Percentiles by sorting and counting: keys plus one column per percent."""
    order = f"PARTITION BY {keys} ORDER BY {value}"
    picked = ", ".join(
        f"max({value}) FILTER (WHERE rn = greatest((cnt * {p} + 99) // 100, 1)) AS {prefix}{p}"
        for p in percents
    )
    return (
        f"SELECT {keys}, {picked} FROM (SELECT *, row_number() OVER ({order}) AS rn, "
        f"count(*) OVER (PARTITION BY {keys}) AS cnt FROM {source} WHERE {value} IS NOT NULL) "
        f"GROUP BY {keys}"
    )


BUCKET = (
    "CASE WHEN latency_ms <= 100 THEN greatest(CAST(ceil(latency_ms) AS BIGINT), 1) "
    "WHEN latency_ms <= 1000 THEN CAST(ceil(latency_ms / 10) AS BIGINT) * 10 "
    "WHEN latency_ms <= 10000 THEN CAST(ceil(latency_ms / 100) AS BIGINT) * 100 "
    "WHEN latency_ms <= 100000 THEN CAST(ceil(latency_ms / 1000) AS BIGINT) * 1000 "
    "ELSE 100000 END"
)


def histogram_percentiles(source: str, keys: str, percents: list[int], prefix: str = "p") -> str:
    """Percentiles by bucket from rows with ``latency_ms``."""
    picked = ", ".join(
        f"min(bucket) FILTER (WHERE upto * 100 >= total * {p}) AS b{p}" for p in percents
    )
    middle = ", ".join(
        f"CAST(b{p} - CASE WHEN b{p} <= 100 THEN 0.5 WHEN b{p} <= 1000 THEN 5 "
        f"WHEN b{p} <= 10000 THEN 50 ELSE 500 END AS DOUBLE) AS {prefix}{p}"
        for p in percents
    )
    return (
        f"SELECT {keys}, {middle} FROM (SELECT {keys}, {picked} FROM ("
        f"SELECT {keys}, bucket, sum(n) OVER (PARTITION BY {keys} ORDER BY bucket) AS upto, "
        f"sum(n) OVER (PARTITION BY {keys}) AS total FROM ("
        f"SELECT {keys}, {BUCKET} AS bucket, count(*) AS n FROM {source} "
        f"WHERE latency_ms IS NOT NULL GROUP BY {keys}, bucket)) GROUP BY {keys})"
    )
