"""Cumulative snapshots of chats: keeps the longest log of each conversation, then renders it.

A logger that writes the whole conversation after every turn leaves prefixes of the last log.
Each turn's rolling hash stands for all turns up to it: the exclusive or of hashes of (position,
role, text). A conversation goes if its last hash is the hash of an inner turn of another one;
of equal conversations the smallest conv_id stays. Everything is DataFrame code.

Turns are dealt out by ranges of (conv_id, turn), so one conversation may span many tasks; its
positions and hashes are made within a range and shifted by what the ranges before it hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftload.session import written_table

#: Turns in one rendered row: what a task has to join into one string.
PIECE_TURNS = 64
#: Characters of role and text by which turns of equal number are dealt out.
LOOKED_AT = 64


def rolling_hashes(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, position (from 1), n_turns, h1, h2."""
    columns = [F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string")]
    order = ["turn", "role", "text"]
    # Ranges follow the order of turns, ties included: texts that share what is looked at stay together.
    dealt = turns.select(*columns).repartitionByRange("conv_id", "turn", F.substring("role", 1, LOOKED_AT), F.substring("text", 1, LOOKED_AT))
    dealt = written_table(dealt.withColumn("part", F.spark_partition_id()), "turns")  # fixed, whatever is computed again
    sizes = dealt.groupBy("conv_id", "part").agg(F.count("*").alias("held"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("conv_id")
    sizes = sizes.select("conv_id", "part", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("base"), F.sum("held").over(whole).alias("n_turns"))
    local = Window.partitionBy("conv_id", "part").orderBy(*order)
    placed = dealt.withColumn("local", F.row_number().over(local))
    placed = null_safe(placed, sizes, ["conv_id"], ["part"]).withColumn("position", F.col("base") + F.col("local"))

    def digest(salt: int) -> Column:
        return F.xxhash64(F.lit(salt), "position", F.isnull("role"), "role", F.isnull("text"), "text")

    hashed = placed.withColumns({"own1": digest(1), "own2": digest(2)})
    blocks = hashed.groupBy("conv_id", "part").agg(F.bit_xor("own1").alias("b1"), F.bit_xor("own2").alias("b2"))
    blocks = blocks.select("conv_id", "part", *[F.coalesce(F.bit_xor(b).over(before), F.lit(0)).alias(b) for b in ("b1", "b2")])
    running = local.rowsBetween(Window.unboundedPreceding, 0)
    hashed = hashed.withColumns({"r1": F.bit_xor("own1").over(running), "r2": F.bit_xor("own2").over(running)})
    hashed = null_safe(hashed, blocks, ["conv_id"], ["part"])
    return hashed.select(
        "conv_id", "turn", "role", "text", "position", "n_turns",
        F.col("b1").bitwiseXOR(F.col("r1")).alias("h1"), F.col("b2").bitwiseXOR(F.col("r2")).alias("h2"),
    )


def null_safe(left: DataFrame, right: DataFrame, keys: list[str], plain: list[str], how: str = "inner") -> DataFrame:
    """Joins on keys that may be null, and on plain ones; keeps the left side's keys."""
    there = right.select(*[F.col(c).alias(f"_{c}") if c in keys + plain else F.col(c) for c in right.columns])
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys] + [F.col(k) == F.col(f"_{k}") for k in plain]
    joined = left.join(there, on, how)
    return joined if how == "left_semi" else joined.drop(*[f"_{k}" for k in keys + plain])


def maximal(hashed: DataFrame) -> DataFrame:
    """Conversations that are no prefix of a longer one: conv_id (the smallest of equal ones), copies, n_turns."""
    last = hashed.where("position = n_turns").groupBy("h1", "h2", "position").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("copies"))
    inner = hashed.where("position < n_turns").select("h1", "h2", "position").distinct()
    return last.join(inner, ["h1", "h2", "position"], "left_anti").select("conv_id", "copies")


def render(turns: DataFrame) -> DataFrame:
    """Rows of conversations (conv_id, turn, role, text) to rendered pieces of the maximal ones.

    Columns: conv_id, piece (from 0, PIECE_TURNS turns each), n_turns of the conversation, copies (logged
    conversations equal to it, itself included), rendered. Turns go by turn, then role, then text, nulls
    first; repeated turns stand as often as they are logged. A null role or text renders as empty, but is
    not equal to one. Rows with a null conv_id form one conversation, and a conversation with a number
    stays before it. Other columns are ignored; no rows give none.
    """
    hashed = written_table(rolling_hashes(turns), "hashed")
    kept = maximal(hashed)
    line = F.concat(F.lit("<|"), F.coalesce("role", F.lit("")), F.lit("|>\n"), F.coalesce("text", F.lit("")), F.lit("<|end|>\n"))
    pieces = null_safe(hashed, kept, ["conv_id"], []).select(
        "conv_id", F.floor((F.col("position") - 1) / PIECE_TURNS).cast("long").alias("piece"), "n_turns", "copies", F.struct("position", line.alias("line")).alias("part")
    )
    parts = F.array_sort(F.collect_list("part"))
    return pieces.groupBy("conv_id", "piece").agg(F.first("n_turns").alias("n_turns"), F.first("copies").alias("copies"), parts.alias("parts")).select(
        "conv_id", "piece", "n_turns", "copies", F.array_join(F.col("parts.line"), "").alias("rendered")
    )


RENDER_SQL = """
WITH t AS (
  SELECT conv_id, turn, role, text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS position,
         count(*) OVER (PARTITION BY conv_id) AS n_turns,
         '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS line
  FROM conversations),
p AS (
  SELECT conv_id, position, n_turns, line,
         string_agg(line, '') OVER (PARTITION BY conv_id ORDER BY position) AS so_far
  FROM t),
ends AS (SELECT so_far, position, min(conv_id) AS conv_id, count(*) AS copies FROM p WHERE position = n_turns GROUP BY ALL),
kept AS (
  SELECT conv_id, copies FROM ends e
  WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.position < p.n_turns AND p.position = e.position AND p.so_far = e.so_far))
SELECT conv_id, (position - 1) // 64 AS piece, max(n_turns) AS n_turns, max(copies) AS copies,
       string_agg(line, '' ORDER BY position) AS rendered
FROM p JOIN kept USING (conv_id) GROUP BY ALL
"""
