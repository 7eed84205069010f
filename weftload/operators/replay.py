"""Final table state of a change log, or of the statements that make it.

Each of these is one aggregate per key. Only a few values per key and task reach the
shuffle, so a key with a third of the log costs no more than any other. Positions are
unique.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftload.functions.text import exploded

# A quoted text with doubled or escaped quotes. All repeats are possessive: they never go back, so
# long statements need no deep stack.
QUOTED = r"'(?:[^'\\]++|\\.|'')*+'"
GROUP = rf"\((?:[^()']++|{QUOTED})*+\)"
TUPLE = rf"\(((?:[^()']++|{QUOTED}|{GROUP})*+)\)"
VALUE = rf"\s*+((?:[^,()'\[]++|{QUOTED}|{GROUP}|\[[^\]]*+\])++)"
WRITE = r"(?is)^\s*(insert|replace)\s+into\s+([^\s(]+)\s*(?:\(([^()]*)\))?\s*values\s*(.*)$"
KEYED_UPDATE = (
    rf"(?is)^\s*(update)\s+(\S+)\s+set\s+((?:(?!\swhere\s)[^']|{QUOTED})++)"
    rf"\swhere\s+([^\s=]+)\s*=\s*({QUOTED}|[^\s;']+)\s*;?\s*$"
)
ASSIGNMENT = rf"([^\s,=']+)\s*=\s*((?:[^,()'\[]++|{QUOTED}|{GROUP}|\[[^\]]*+\])++)"


def _only(test: Column, value: Column) -> Column:
    return F.when(test, value)


def replay_inserts(log: DataFrame) -> DataFrame:
    """``(id, a)`` of the inserts: the first one of a key stands, later ones are duplicates."""
    return (
        log.where("op = 'insert'")
        .groupBy("id")
        .agg(F.min_by("a", "pos").alias("a"))
    )


def replay_keyed(log: DataFrame) -> DataFrame:
    """Inserts, then the latest update of a key that came after its insert."""
    insert, update = F.col("op") == "insert", F.col("op") == "update"
    state = log.groupBy("id").agg(
        F.min(_only(insert, F.col("pos"))).alias("_born"),
        F.min_by("a", _only(insert, F.col("pos"))).alias("_first"),
        F.max(_only(update, F.col("pos"))).alias("_changed"),
        F.max_by("a", _only(update, F.col("pos"))).alias("_latest"),
    )
    newer = F.col("_changed") > F.col("_born")
    return state.where("_born IS NOT NULL").select(
        "id", F.when(newer, F.col("_latest")).otherwise(F.col("_first")).alias("a")
    )


def replay_upserts(log: DataFrame) -> DataFrame:
    """Inserts and replaces by key: the last statement wins."""
    return (
        log.where("op IN ('insert', 'replace')").groupBy("id").agg(F.max_by("a", "pos").alias("a"))
    )


def replay(log: DataFrame) -> DataFrame:
    """All three kinds: a replace always takes hold, an insert only on a free key, an
    update only on a row that is there."""
    insert, replace, update = (F.col("op") == o for o in ("insert", "replace", "update"))
    pos = F.col("pos")
    state = log.groupBy("id").agg(
        F.min(_only(insert, pos)).alias("_inserted"),
        F.min_by("a", _only(insert, pos)).alias("_insert"),
        F.max(_only(replace, pos)).alias("_replaced"),
        F.max_by("a", _only(replace, pos)).alias("_replace"),
        F.max(_only(update, pos)).alias("_updated"),
        F.max_by("a", _only(update, pos)).alias("_update"),
    )
    # Once a key has been replaced, its last replace is the latest write of the row.
    written = F.coalesce("_replaced", "_inserted")
    value = F.when(F.col("_replaced").isNotNull(), F.col("_replace")).otherwise(F.col("_insert"))
    return state.where(written.isNotNull()).select(
        "id", F.when(F.col("_updated") > written, F.col("_update")).otherwise(value).alias("a")
    )


def _plain(value: Column) -> Column:
    """A value as it is meant: without quotes and escapes."""
    text = F.trim(value)
    inner = F.substring(text, F.lit(2), F.length(text) - 2)
    return F.when(text.startswith("'"), F.regexp_replace(inner, r"\\(.)|'(')", "$1$2")).otherwise(text)


def _names(listed: Column) -> Column:
    return F.transform(F.split(listed, ","), lambda n: F.lower(F.regexp_replace(n, r"[\s`\"]", "")))


def _by_name(names: Column, values: Column, columns: Sequence[str]) -> list[Column]:
    return [
        _plain(F.get(values, (F.array_position(names, c.lower()) - 1).cast("int"))).alias(c) for c in columns
    ]


def read_changes(
    stmts: DataFrame, columns: Sequence[str], pos: str = "pos", stmt: str = "stmt"
) -> DataFrame:
    """Statements as a change log: ``pos`` (statement, tuple), ``op``, ``target`` and ``columns`` as text.

    The inverse of rendering. INSERT and REPLACE give a row per VALUES tuple; names come from
    the statement's column list, or are ``columns`` in order. An UPDATE gives a row if it is
    keyed by one column (``where key = value``) of ``columns``; what it does not set is null.
    Brackets, commas and key words inside quotes are text. Other statements give no rows.
    """
    text = F.regexp_replace(F.col(stmt), r"[;\s]+$", "")

    def part(pattern: str, group: int) -> Column:
        return F.regexp_extract(text, pattern, group)

    # The parts come first: a row per tuple then needs no copy of its statement.
    written = stmts.where(F.rlike(text, F.lit(WRITE))).select(
        F.col(pos).alias("_pos"), F.lower(part(WRITE, 1)).alias("op"), part(WRITE, 2).alias("target"),
        F.when(part(WRITE, 3) != "", _names(part(WRITE, 3)))
        .otherwise(F.array(*[F.lit(c.lower()) for c in columns])).alias("_names"),
        F.regexp_extract_all(part(WRITE, 4), F.lit(TUPLE), F.lit(1)).alias("_tuples"),
    )
    written = exploded(written, F.col("_tuples"), "_tuple", "_tuple_no").drop("_tuples")
    values = F.regexp_extract_all(F.col("_tuple"), F.lit(VALUE), F.lit(1))
    rows = written.withColumn("_values", values).select(
        F.struct(F.col("_pos").alias("pos"), F.col("_tuple_no").alias("tuple_no")).alias("pos"), "op", "target",
        *_by_name(F.col("_names"), F.col("_values"), columns),
    )
    updates = stmts.where(F.rlike(text, F.lit(KEYED_UPDATE))).select(
        F.struct(F.col(pos).alias("pos"), F.lit(0).alias("tuple_no")).alias("pos"),
        F.lower(part(KEYED_UPDATE, 1)).alias("op"), part(KEYED_UPDATE, 2).alias("target"),
        F.concat(
            F.transform(F.regexp_extract_all(part(KEYED_UPDATE, 3), F.lit(ASSIGNMENT), F.lit(1)), F.lower),
            F.array(F.lower(part(KEYED_UPDATE, 4))),
        ).alias("_names"),
        F.concat(
            F.regexp_extract_all(part(KEYED_UPDATE, 3), F.lit(ASSIGNMENT), F.lit(2)),
            F.array(part(KEYED_UPDATE, 5)),
        ).alias("_values"),
        F.lower(part(KEYED_UPDATE, 4)).alias("_key"),
    )
    updates = updates.where(F.col("_key").isin([c.lower() for c in columns])).select(
        "pos", "op", "target", *_by_name(F.col("_names"), F.col("_values"), columns)
    )
    return rows.unionByName(updates)


def replay_statements(stmts: DataFrame, target: str, pos: str = "pos", stmt: str = "stmt") -> DataFrame:
    """The table ``(id, a)`` that statements on ``target`` leave, in the order of ids.

    Updates that do not set ``a``, or are not keyed by ``id``, change nothing here.
    """
    log = read_changes(stmts, ["id", "a"], pos, stmt).where(F.col("target") == target)
    log = log.where("op <> 'update' OR (a IS NOT NULL AND id IS NOT NULL)")
    log = log.select("pos", "op", F.col("id").cast("bigint").alias("id"), F.col("a").cast("double").alias("a"))
    return replay(log).orderBy("id")
