"""Mixing sources to target weights: random order, prefix sums, and a cut at each source's budget.

Each source gets a budget of tokens (here: words). Its documents are put in a random order that
follows from a hash, and taken in whole epochs as often as the budget allows; the rest of the budget
is cut from the front of the order, within a document if need be, so a source gives its budget exactly.

Orders are sorted range by range. Hash keys are uniform, so equal ranges of keys hold nearly
equal numbers of documents: a source has a range for every RANGE_ROWS of its rows, and a source
that holds most of the table has most of the ranges. Prefix sums are summed within a range and
shifted by what the ranges before it hold. Everything is DataFrame code.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftload.session import written_table

#: Weights of the sources in order, repeating.
WEIGHTS = (5, 2, 1)
#: A source gives each document at most this often.
MOST = 3
RANGE_ROWS = 1 << 12
WORD = r"[^\x20\x09-\x0D]+"
#: Hash keys are compared in full; ranges are made from their first 8 hex digits.
KEY_DIGITS, KEY_SPACE = 8, 1 << 32


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def numbered(names: DataFrame, name: str) -> DataFrame:
    """Distinct names, at most one of them null, with their place in ascending order, the null one last."""
    dealt = names.repartitionByRange(F.col(name).asc_nulls_last()).withColumn("part", F.spark_partition_id())
    dealt = written_table(dealt, "names")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    bases = dealt.groupBy("part").agg(F.count("*").alias("held")).select("part", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("base"))
    local = F.row_number().over(Window.partitionBy("part").orderBy(F.col(name).asc_nulls_last())) - 1
    return dealt.withColumn("local", local).join(bases, "part").withColumn("place", F.col("base") + F.col("local")).drop("part", "base", "local")


def budgets(sources: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Sources (source, source_size, n_rows) with weight, target and budget.

    Targets share the sum of all sizes by weight. None is above ``most`` times its source's size: what a source
    can't give is shared by the others, which may bring further ones to their limit. Each round looks at all
    sources at once and hands three sums to the driver; it ends when no further source reaches its limit.
    """
    place = F.pmod(F.col("place"), F.lit(len(weights))).cast("int")
    weight = F.element_at(F.array(*[F.lit(int(w)).cast("long") for w in weights]), place + 1)
    sources = written_table(numbered(sources, "source").withColumn("weight", weight), "sources")
    limit = F.col("source_size") * most
    whole = sources.agg(F.sum("source_size")).first()[0] or 0
    left, share = whole, sources.agg(F.sum("weight")).first()[0] or 1
    full = -1
    while True:
        # A source is full if its limit is at most its part of what is left.
        at_limit = limit.cast("decimal(38,0)") * F.lit(share).cast("decimal(38,0)") <= F.col("weight").cast("decimal(38,0)") * F.lit(left).cast("decimal(38,0)")
        n, given, freed = sources.where(at_limit).agg(F.count("*"), F.coalesce(F.sum(limit), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
        rest = sources.where(~at_limit).agg(F.sum("weight")).first()[0]
        if n == full or not rest:
            break
        full, left, share = n, whole - given, rest
    target = F.when(at_limit, limit.cast("double")).otherwise((F.col("weight") * F.lit(left)).cast("double") / F.lit(float(share)))
    return sources.withColumn("target", target).withColumn("budget", F.floor("target").cast("long"))


def mixed(rows: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Rows (doc_id, source, size, key) with source_size, target, epochs, before and taken.

    ``epochs`` is how often the whole source is taken, ``before`` the tokens before a document in its source's
    order, ``taken`` the document's tokens in the mix. Sources without tokens have a target of 0.
    """
    rows = written_table(rows.select("doc_id", "source", "size", "key"), "sized")
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows"))
    sources = budgets(sources, weights, most)
    ranges = F.ceil(F.col("n_rows") / RANGE_ROWS).cast("long")
    sources = sources.select(F.col("source").alias("_source"), "source_size", "target", "budget", ranges.alias("ranges"))
    sources = written_table(sources, "budgets")

    first = F.conv(F.substring("key", 1, KEY_DIGITS), 16, 10).cast("long")
    ranged = rows.join(sources, F.col("source").eqNullSafe(F.col("_source"))).withColumn("range", F.floor(first * F.col("ranges") / KEY_SPACE).cast("long"))
    local = Window.partitionBy("source", "range").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    ranged = ranged.withColumn("inner", F.coalesce(F.sum("size").over(local), F.lit(0)))
    totals = rows.join(sources, F.col("source").eqNullSafe(F.col("_source"))).groupBy("source", F.floor(first * F.col("ranges") / KEY_SPACE).cast("long").alias("range")).agg(F.sum("size").alias("held"))
    earlier = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(F.col("source").alias("_of"), F.col("range").alias("_range"), F.coalesce(F.sum("held").over(earlier), F.lit(0)).alias("base"))
    totals = written_table(totals, "ranges")
    placed = ranged.join(totals, F.col("source").eqNullSafe(F.col("_of")) & (F.col("range") == F.col("_range")))

    epochs = F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(F.lit(0)).cast("long")
    before = F.col("base") + F.col("inner")
    rest = F.col("budget") - F.col("epochs") * F.col("source_size")
    part = F.greatest(F.least(rest - F.col("before"), F.col("size")), F.lit(0))
    placed = placed.withColumn("epochs", epochs).withColumn("before", before)
    return placed.select("doc_id", "size", "source_size", "target", (F.col("epochs") * F.col("size") + part).alias("taken"), "source", "epochs", "before")


def mix_documents(docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Mixes documents (doc_id, source, text; other columns are ignored) by words.

    Null texts have no words, and null sources are one source, the last. The order of a source goes by the hash of
    doc_id and text: reruns agree, and repeated rows can change places only with each other. No rows give none.
    """
    text = F.col("text").cast("string")
    key = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(":"), F.coalesce(text, F.lit(""))))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(text).alias("size"), key.alias("key"))
    return mixed(rows, weights, most)


CHECK_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '-') || ':' || coalesce(text, '')) AS key
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::BIGINT AS weight
  FROM d GROUP BY source),
r AS (
  SELECT *, sum(source_size) OVER ()::BIGINT AS whole, sum(weight) OVER ()::BIGINT AS weights,
         coalesce(sum(3 * source_size) OVER w, 0)::BIGINT AS given, coalesce(sum(weight) OVER w, 0)::BIGINT AS freed
  FROM s WINDOW w AS (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
below AS (  -- the first source, by limit over weight, whose part of what is left is under its limit
  SELECT whole - given AS rest, weights - freed AS share, 3 * source_size / weight AS ratio FROM r
  WHERE 3 * source_size * (weights - freed) > weight * (whole - given) ORDER BY ratio, source NULLS LAST LIMIT 1),
t AS (
  SELECT source, source_size, CASE WHEN b.rest IS NULL OR 3 * source_size * b.share <= weight * b.rest THEN 3.0::DOUBLE * source_size ELSE (weight * b.rest)::DOUBLE / b.share END AS target
  FROM r LEFT JOIN below b ON true),
o AS (
  SELECT d.doc_id, d.source, d.size, t.source_size, t.target, floor(t.target)::BIGINT AS budget,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM o)
SELECT doc_id, size, source_size, target, epochs * size + greatest(least(budget - epochs * source_size - before, size), 0) AS taken, source, epochs, before FROM e
"""
