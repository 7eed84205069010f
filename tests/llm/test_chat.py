from collections import defaultdict

import pytest

from weftload.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    """Kept conversations with their number of copies and rendered text."""
    low = lambda x: (x is not None, x)
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        convs[conv].append((turn, role, text))
    logs = {c: tuple((r, t) for _, r, t in sorted(ts, key=lambda x: tuple(map(low, x)))) for c, ts in convs.items()}
    inner = {log[:k] for log in logs.values() for k in range(1, len(log))}
    same = defaultdict(list)
    for c, log in logs.items():
        same[log].append(c)
    kept = {min(cs, key=lambda c: (c is None, c)): (log, len(cs)) for log, cs in same.items() if log not in inner}
    return {c: (len(log), n, "".join(f"<|{r or ''}|>\n{t or ''}<|end|>\n" for r, t in log)) for c, (log, n) in kept.items()}


def verify(spark, rows, parts=3, clash=False):
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    if clash:
        from pyspark.sql import functions as F

        df = df.withColumns({n: F.lit(1) for n in ("position", "part", "h1", "local", "base", "piece")})
    got = defaultdict(list)
    for r in chat.render(df).collect():
        got[r.conv_id].append(r)
    wanted = brute(rows)
    assert set(got) == set(wanted)
    for c, pieces in got.items():
        pieces.sort(key=lambda r: r.piece)
        assert [p.piece for p in pieces] == list(range(-(-wanted[c][0] // chat.PIECE_TURNS)))
        assert {(p.n_turns, p.copies) for p in pieces} == {wanted[c][:2]}
        assert "".join(p.rendered for p in pieces) == wanted[c][2]


def test_snapshots(spark):
    rows = []
    for conv in range(60):
        for k in range(1 + conv % 6):
            rows.append((conv, k, "user" if k % 2 == 0 else "bot", f"story {conv // 6} line {k}"))
    verify(spark, rows)


@pytest.mark.parametrize("clash", [False, True])
def test_odd_rows(spark, clash):
    rows = [
        (1, 0, "user", "a"), (1, 1, "bot", "b"), (2, 0, "user", "a"), (3, 0, None, "a"), (4, 0, "user", None), (5, 0, "user", ""),
        (6, None, "user", "a"), (6, 1, "bot", "c"), (7, 0, "user", "a"), (7, 0, "user", "a"), (8, 1, "b", "x"), (8, 1, "a", "x"),
        (None, 0, "user", "n"), (None, 1, "bot", "n"), (9, 0, "user", "n"), (10, 3, "user", "n"), (10, 9, "bot", "n"), (11, 0, "u", "y" * 100_000),
    ]
    verify(spark, rows, clash=clash)


def test_one_long_conversation(spark):
    rows = [(1, k, "u", f"t{k % 7}") for k in range(1500)] + [(2, k, "u", f"t{k % 7}") for k in range(700)] + [(c, 0, "u", "t0") for c in range(3, 40)]
    verify(spark, rows, parts=5)


def test_empty(spark):
    assert chat.render(spark.createDataFrame([], SCHEMA)).collect() == []


def test_ties_of_one_turn_across_ranges(spark):
    """Two equal conversations of many rows of the same turn, dealt out over several ranges."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        verify(spark, [(c, 0, "u" if k % 3 else None, f"t{k * 7919 % 4000}") for c in (1, 2) for k in range(4000)], parts=5)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
