"""Columns that classify statements and templates held in a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftload.functions.patterns import KNOWN_TYPES
from weftload.functions.text import exploded

# The forms recognised in statements.
PLACEHOLDER_REGEX = "<((?:" + "|".join(KNOWN_TYPES) + ")[^>]*)>"
VOCABULARY_REGEX = r"^text/\{([^}]+)\}/(\d+)/(\d+)$"
BATCHABLE_REGEX = "^(insert|replace)"
STATEMENT_TYPES = ["select", "insert", "replace", "delete", "update"]
TABLE_REGEXES = [
    r"^(?:insert\s+into|replace\s+into)\s+([^\s(]+)",
    r"^create\s+table\s+([^\s(]+)",
    r"\bfrom\s+([^\s,()]+)",
]
LOOSE_TABLE_REGEX = r"(?i)(?:from|into)\s+([^\s(,]+)"
VALID_TABLE_REGEX = "^[a-zA-Z0-9_:]+$"
VALID_NEW_TABLE_REGEX = "^[a-zA-Z0-9_]+$"
# Possessive quantifiers: the regex engine loops instead of recursing, so long scripts
# cannot overflow its stack, and nothing after the match could need backtracking.
SCRIPT_PART_REGEX = r"""((?:[^;"']++|"[^"]*+"|'[^']*+')++)"""


def placeholders(templates: DataFrame, sql: str = "sql") -> DataFrame:
    """One row per placeholder: ``(…, slot, placeholder)``, in order of appearance."""
    found = F.regexp_extract_all(F.col(sql), F.lit(PLACEHOLDER_REGEX), F.lit(1))
    return exploded(templates, found, "placeholder", "slot")


def slot_order(templates: DataFrame, sql: str = "sql") -> DataFrame:
    """Placeholders in the order in which they are filled in, from right to left."""
    found = F.regexp_extract_all(F.col(sql), F.lit(PLACEHOLDER_REGEX), F.lit(1))
    listed = templates.withColumn("_found", F.reverse(found))
    return (
        exploded(listed, F.col("_found"), "placeholder", "from_right")
        .withColumn("slot", F.size("_found") - 1 - F.col("from_right"))
        .drop("_found")
    )


def decoded(found: DataFrame, placeholder: str = "placeholder") -> DataFrame:
    """Adds type, vocabulary path, up to four numeric arguments and an arity error."""
    text = F.col(placeholder)
    file_form = [F.regexp_extract(text, VOCABULARY_REGEX, i) for i in (1, 2, 3)]
    # In steps, so that each pattern is matched and each text split once.
    split_up = (
        found.withColumn("path", F.nullif(file_form[0], F.lit("")))
        .withColumn(
            "_plain",
            F.when(
                F.col("path").isNotNull(), F.concat_ws("/", F.lit("text"), *file_form[1:])
            ).otherwise(text),
        )
        .withColumn("_parts", F.split("_plain", "/"))
        .withColumn("_head", F.element_at("_parts", 1))
        .withColumn("_known", F.col("_head").isin(KNOWN_TYPES))
    )
    head, known, count = F.col("_head"), F.col("_known"), F.size("_parts")
    kind = F.when(~known, F.lit("exact")).when(head == "bigint", F.lit("int")).otherwise(head)
    wanted = (
        F.when(head.startswith("array"), F.lit(5))
        .when(head.isin("increment", "boolean"), count)
        .otherwise(F.lit(3))
    )
    args = [
        F.when(known, F.get("_parts", i + 1).try_cast("double")).alias(f"arg{i + 1}")
        for i in range(4)
    ]
    return split_up.select(
        *found.columns, kind.alias("kind"), "path", *args,
        (known & (count != wanted)).alias("bad_arity"),
    )


def quoted_literal(text: Column) -> Column:
    """A quoted literal with quotes and slashes escaped."""
    return F.concat(F.lit("'"), F.regexp_replace(text, r"(['\"\\])", r"\\$1"), F.lit("'"))


def is_batchable(sql: Column) -> Column:
    """Starts with insert or replace; not trimmed, any case."""
    return F.lower(sql).rlike(BATCHABLE_REGEX)


def statement_type(sql: Column) -> Column:
    """select, insert, replace, delete, update or other."""
    text = F.lower(F.trim(sql))
    choice = None
    for name in STATEMENT_TYPES:
        test = text.startswith(name)
        choice = F.when(test, F.lit(name)) if choice is None else choice.when(test, F.lit(name))
    return choice.otherwise(F.lit("other"))


def statement_set_type(types: Column) -> Column:
    """Type of several statements: insert wins, then the first that is not other."""
    writes = F.array_contains(types, "insert") | F.array_contains(types, "replace")
    named = F.try_element_at(F.array_except(types, F.array(F.lit("other"))), F.lit(1))
    return F.when(writes, F.lit("insert")).otherwise(F.coalesce(named, F.lit("other")))


def target_table(sql: Column) -> Column:
    """Lower-case table name, or an empty text."""
    text = F.lower(sql)
    found = [F.nullif(F.regexp_extract(text, r, 1), F.lit("")) for r in TABLE_REGEXES]
    return F.coalesce(*found, F.lit(""))


def first_target_table(statements: Column) -> Column:
    """The first non-empty table name of an array of statements."""
    names = F.filter(F.transform(statements, target_table), lambda t: t != "")
    return F.coalesce(F.try_element_at(names, F.lit(1)), F.lit(""))


def loose_table(sql: Column) -> Column:
    """Table name with its case kept, from any ``from`` or ``into``."""
    return F.regexp_extract(sql, LOOSE_TABLE_REGEX, 1)


def script_parts(script: Column) -> Column:
    """Statements of a script: split at ``;`` outside quotes, trimmed, empties dropped."""
    parts = F.regexp_extract_all(script, F.lit(SCRIPT_PART_REGEX), F.lit(1))
    return F.filter(
        F.transform(parts, lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != ""
    )


def weights_error(weights: Column, count: Column) -> Column:
    """What is wrong with a comma-separated weight list; null if nothing is.

    Compared as decimals, with a tolerance of 1e-6 on the sum.
    """
    parts = F.transform(F.split(weights, ","), F.trim)
    values = F.transform(parts, lambda p: p.try_cast("decimal(20,9)"))
    zero = F.lit(0).cast("decimal(30,9)")
    total = F.aggregate(
        values, zero, lambda a, v: (a + F.coalesce(v, zero)).cast("decimal(30,9)")
    )
    return (
        F.when(F.exists(values, lambda v: v.isNull()), F.lit("invalid value"))
        .when(F.size(values) != count, F.lit("wrong number of values"))
        .when(F.exists(values, lambda v: v < 0), F.lit("negative value"))
        .when(total > F.lit("1.000001").cast("decimal(20,9)"), F.lit("total above 1"))
        .when(total < F.lit("0.999999").cast("decimal(20,9)"), F.lit("total is not 1"))
    )


def parameters_error(
    load: Column, total: Column, iterations: Column, threads: Column, batch_sizes: Column
) -> Column:
    """What is wrong with run parameters held as text, first fault first; null if nothing is.

    The same checks, in the same order, as ``WorkloadSpec.validate`` makes of a single spec.
    """

    def positive(value: Column) -> Column:
        return F.coalesce(F.trim(value).try_cast("bigint") > 0, F.lit(False))

    def all_positive(values: Column) -> Column:
        return ~F.exists(F.split(values, ","), lambda v: ~positive(v))

    checks = [
        (F.coalesce(load, F.lit("")) != "", "load is required"),
        (positive(total), "total must be positive"),
        (positive(iterations), "iterations must be positive"),
        (F.coalesce(all_positive(threads), F.lit(False)), "threads must be positive"),
        (F.coalesce(all_positive(batch_sizes), F.lit(False)), "batch_sizes must be positive"),
    ]
    return F.coalesce(*[F.when(~passed, F.lit(message)) for passed, message in checks])
