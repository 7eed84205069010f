"""Merkle manifest of a table: a leaf per row, a tree per language, a tree over the languages.

Every RUN consecutive nodes of a level become one node of the next, so RUN ** LEVELS consecutive
nodes, a superblock, reduce to one node without looking outside. The manifest takes two sweeps over
tables of nodes, each table holding a node for every superblock of the one below:

* Upwards, each superblock becomes a node of the next table, until a tree is a single node.
* Downwards, the nodes of a superblock are cogrouped with the outer nodes that their way to the root
  needs: at most RUN - 1 siblings a level. The cogroup reduces the superblock once more, joins inner and
  outer siblings to each node's proof, and for leaves folds the claimed digest up to the root.

A language may hold any share of the rows: it is spread over its superblocks, and a task sees one of them
and its list of outer siblings at a time.
"""

from __future__ import annotations

from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftload.session import written_table

RUN, LEVELS = 8, 4
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Nodes: place ``idx`` of ``n`` in a tree; ``name`` and ``claim`` are what a leaf brings along.
NODES = "tree string, idx long, n long, name string, claim string, digest string"
PATHS = "tree string, idx long, name string, digest string, lefts array<string>, rights array<string>, subroot string, root string"
PROOFS = "tree string, idx long, name string, leaf string, subroot string, root string, proof_sha256 string, folded_root string"


def field(value: Column) -> Column:
    """A value without ambiguity: ``-`` if null, else its UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(text: Column) -> Column:
    """The digest of a documents row that holds ``text``."""
    rest = [field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")]
    return F.sha2(F.concat(*rest, field(text)), 256)


def lowered(text: Column) -> Column:
    """What tampering makes of a text: only A-Z become a-z."""
    return F.translate(text, UPPER, LOWER)


def digest_of(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def levels_of(n: int, most: int = LEVELS) -> int:
    """Levels that a superblock of a tree of n nodes reduces: all of them, or fewer if the tree ends before."""
    levels = 0
    while n > 1 and levels < most:
        n, levels = -(-n // RUN), levels + 1
    return levels


def layers(digests: list[str], levels: int) -> list[list[str]]:
    """The nodes of a superblock, level by level; the last run of a level may be short."""
    out = [digests]
    for _ in range(levels):
        below = out[-1]
        out.append([digest_of("".join(below[i : i + RUN])) for i in range(0, len(below), RUN)])
    return out


def inner_path(layer: list[list[str]], i: int) -> tuple[list[str], list[str]]:
    """The siblings of node i within its superblock, left and right of it, one string a level."""
    lefts, rights = [], []
    for below in layer[:-1]:
        start = i // RUN * RUN
        lefts.append("".join(below[start:i]))
        rights.append("".join(below[i + 1 : start + RUN]))
        i //= RUN
    return lefts, rights


def block(levels: int) -> Column:
    return F.floor(F.col("idx") / RUN**levels).cast("long").alias("block")


def parents(nodes: DataFrame, levels: int) -> DataFrame:
    """One node per superblock."""

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("idx")
        n = int(group["n"].iloc[0])
        top = layers(group["digest"].tolist(), levels_of(n, levels))[-1][0]
        return pd.DataFrame([(key[0], key[1], -(-n // RUN**levels), "", "", top)], columns=[c.split()[0] for c in NODES.split(", ")])

    return nodes.select("tree", "idx", "n", "digest", block(levels)).groupBy("tree", "block").applyInPandas(run, NODES)


def tiers(nodes: DataFrame, levels: int) -> list[DataFrame]:
    """Tables of nodes from the leaves to the one where each tree is a single node."""
    out = [nodes]
    while (out[-1].agg(F.max("n")).first()[0] or 1) > 1:
        out.append(written_table(parents(out[-1], levels), "nodes"))
    return out


def cogrouped(nodes: DataFrame, outer: DataFrame, levels: int):
    """Nodes with the outer nodes of their superblock, which is node ``block`` of the table above."""
    above = outer.select("tree", F.col("idx").alias("block"), "lefts", "rights", "subroot", "root")
    return nodes.select("*", block(levels)).groupBy("tree", "block").cogroup(above.groupBy("tree", "block"))


def extended(nodes: DataFrame, outer: DataFrame, levels: int) -> DataFrame:
    """The ways of nodes to the root, from those of the nodes above."""

    def run(key: tuple, group: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        group, above = group.sort_values("idx"), above.iloc[0]
        layer = layers(group["digest"].tolist(), levels_of(int(group["n"].iloc[0]), levels))
        paths = [inner_path(layer, i) for i in range(len(group))]
        return pd.DataFrame({
            "tree": key[0], "idx": group["idx"].to_numpy(), "name": group["name"].to_numpy(), "digest": group["digest"].to_numpy(),
            "lefts": [[*left, *above["lefts"]] for left, _ in paths], "rights": [[*right, *above["rights"]] for _, right in paths],
            "subroot": above["subroot"], "root": above["root"],
        })

    return cogrouped(nodes, outer, levels).applyInPandas(run, PATHS)


def proved(leaves: DataFrame, outer: DataFrame, levels: int) -> DataFrame:
    """Proof of each leaf, and the root that its claimed digest folds to along it."""

    def run(key: tuple, group: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        group, above = group.sort_values("idx"), above.iloc[0]
        digests = group["digest"].tolist()
        layer = layers(digests, levels_of(int(group["n"].iloc[0]), levels))
        outer_path = list(zip(above["lefts"], above["rights"]))
        outer_text = "".join(left + right for left, right in outer_path)
        proofs, folded = [], []
        for i, claim in enumerate(group["claim"]):
            path = list(zip(*inner_path(layer, i)))
            proofs.append(digest_of("".join(left + right for left, right in path) + outer_text))
            for left, right in [*path, *outer_path]:
                claim = digest_of(left + claim + right)
            folded.append(claim)
        return pd.DataFrame({
            "tree": key[0], "idx": group["idx"].to_numpy(), "name": group["name"].to_numpy(), "leaf": digests,
            "subroot": above["subroot"], "root": above["root"], "proof_sha256": proofs, "folded_root": folded,
        })

    return cogrouped(leaves, outer, levels).applyInPandas(run, PROOFS)


def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """Rows (tree, name, claim, digest, order columns) with their place in their tree: a range sort, then what each range has before it."""
    dealt = rows.repartitionByRange("tree", *order).withColumn("part", F.spark_partition_id())
    dealt = written_table(dealt, "dealt")  # ranges stay as they are, whatever is computed again
    before = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    held = dealt.groupBy("tree", "part").agg(F.count("*").alias("held"))
    bases = held.select(
        F.col("tree").alias("_tree"), F.col("part").alias("_part"), F.coalesce(F.sum("held").over(before), F.lit(0)).alias("base"),
        F.sum("held").over(Window.partitionBy("tree")).alias("n"),
    )
    local = F.row_number().over(Window.partitionBy("tree", "part").orderBy(*order)) - 1
    numbered = dealt.withColumn("local", local).join(bases, (F.col("tree") == F.col("_tree")) & (F.col("part") == F.col("_part")))
    return written_table(numbered.select("tree", (F.col("base") + F.col("local")).alias("idx"), "n", "name", "claim", "digest"), "placed")


def manifest(rows: DataFrame, levels: int = LEVELS) -> DataFrame:
    """Rows (lang, doc_id, leaf, claim) to their proofs, written as a table.

    ``claim`` is the leaf that someone holds against the manifest; ``folded_root`` is the root it leads to
    with the original siblings, and ``verified`` says whether that is the root. Trees go by language, the
    null one first, then bytewise; rows of a tree by doc_id, the null one first, then by leaf. Repeated
    rows are leaves of their own. No rows give none.
    """
    tree = F.coalesce(F.concat(F.lit("+"), "lang"), F.lit(""))
    leaves = rows.select(tree.alias("tree"), F.col("doc_id").cast("string").alias("name"), "claim", F.col("leaf").alias("digest"), "doc_id")
    leaves = written_table(leaves.withColumn("row", F.monotonically_increasing_id()), "leaves")
    of_rows = tiers(placed(leaves, ["doc_id", "digest", "row"]), levels)
    tops = of_rows[-1].select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.lit("").alias("claim"), "digest")
    of_trees = tiers(placed(tops, ["name"]), levels)

    no_path = F.array().cast("array<string>")
    outer = of_trees[-1].select("tree", "idx", "name", "digest", no_path.alias("lefts"), no_path.alias("rights"), F.lit("").alias("subroot"), F.col("digest").alias("root"))
    for nodes in reversed(of_trees[:-1]):
        outer = written_table(extended(nodes, outer, levels), "paths")
    outer = outer.select(F.col("name").alias("tree"), F.lit(0).cast("long").alias("idx"), "lefts", "rights", F.col("digest").alias("subroot"), "root")
    for nodes in reversed(of_rows[1:-1]):
        outer = written_table(extended(nodes, outer, levels), "paths")
    proofs = proved(of_rows[0], outer, levels)
    return written_table(
        proofs.select(
            F.col("name").cast("long").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root",
            (F.col("folded_root") == F.col("root")).alias("verified"), F.expr("substr(nullif(tree, ''), 2)").alias("lang"), "idx",
        ),
        "manifest",
    )


def tampered_manifest(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """The manifest of documents (doc_id, source, lang, n_chars, text; other columns are ignored), held against a tampered copy.

    Rows whose doc_id has a CRC-32 that 3 divides hold a text with A-Z lower-cased in the copy; null texts, and
    rows without doc_id, stay as they are. A text without A-Z is the same after tampering and is verified.
    """
    text = F.col("text").cast("string")
    altered = (F.crc32(F.col("doc_id").cast("string")) % 3 == 0) & (lowered(text) != text)
    rows = docs.select(F.col("lang").cast("string").alias("lang"), F.col("doc_id").cast("long").alias("doc_id"), leaf(text).alias("leaf"), F.when(altered, leaf(lowered(text))).alias("claim"))
    return manifest(rows.withColumn("claim", F.coalesce("claim", "leaf")), levels)


CHECK_SQL = """
WITH RECURSIVE raw AS (
  SELECT doc_id, lang, coalesce('+' || lang, '') AS tree, text, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
         CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(doc_id::VARCHAR) || ':' || doc_id END
         || CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END
         || CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END
         || CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(n_chars::VARCHAR) || ':' || n_chars END AS head,
         list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
                     lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END) AS crc
  FROM documents),
leaves AS (
  SELECT doc_id, lang, tree, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
         CASE WHEN xor(crc, 4294967295) % 3 = 0 THEN sha256(head || coalesce(strlen(low) || ':' || low, '-')) ELSE sha256(head || coalesce(strlen(text) || ':' || text, '-')) END AS claim
  FROM raw),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY tree) AS n FROM leaves),
up AS (
  SELECT tree, 0 AS level, idx, n, leaf AS digest FROM numbered
  UNION ALL
  SELECT tree, level + 1, idx // 8, (n + 7) // 8, sha256(string_agg(digest, '' ORDER BY idx)) FROM up WHERE n > 1 GROUP BY tree, level, idx // 8, n),
subroots AS (SELECT tree, level, digest FROM up WHERE n = 1),
langs AS (SELECT tree, digest, row_number() OVER (ORDER BY tree) - 1 AS idx, count(*) OVER () AS n FROM subroots),
tops AS (
  SELECT 0 AS level, idx, n, digest FROM langs
  UNION ALL
  SELECT level + 1, idx // 8, (n + 7) // 8, sha256(string_agg(digest, '' ORDER BY idx)) FROM tops WHERE n > 1 GROUP BY level, idx // 8, n),
sides AS (
  SELECT tree, level, idx,
         coalesce(string_agg(digest, '') OVER (PARTITION BY tree, level, idx // 8 ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS lefts,
         coalesce(string_agg(digest, '') OVER (PARTITION BY tree, level, idx // 8 ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS rights
  FROM (SELECT tree, level, idx, n, digest FROM up UNION ALL SELECT NULL, level, idx, n, digest FROM tops) WHERE n > 1),
steps AS (
  SELECT r.tree, r.idx AS leaf_idx, s.level, s.lefts, s.rights
  FROM numbered r JOIN sides s ON s.tree = r.tree AND s.idx = r.idx // (8 ** s.level)::BIGINT
  UNION ALL
  SELECT r.tree, r.idx, t.level + s.level, s.lefts, s.rights
  FROM numbered r JOIN subroots t ON t.tree = r.tree JOIN langs l ON l.tree = r.tree JOIN sides s ON s.tree IS NULL AND s.idx = l.idx // (8 ** s.level)::BIGINT),
proofs AS (
  SELECT r.tree, r.idx, any_value(r.claim) AS claim, sha256(coalesce(string_agg(lefts || rights, '' ORDER BY level), '')) AS proof_sha256, list(lefts ORDER BY level) FILTER (level IS NOT NULL) AS lefts, list(rights ORDER BY level) FILTER (level IS NOT NULL) AS rights
  FROM numbered r LEFT JOIN steps s ON s.tree = r.tree AND s.leaf_idx = r.idx GROUP BY r.tree, r.idx),
fold AS (
  SELECT tree, idx, 0 AS depth, claim AS digest FROM proofs
  UNION ALL
  SELECT f.tree, f.idx, depth + 1, sha256(p.lefts[depth + 1] || f.digest || p.rights[depth + 1]) FROM fold f JOIN proofs p ON p.tree = f.tree AND p.idx = f.idx WHERE depth < coalesce(len(p.lefts), 0)),
folded AS (SELECT tree, idx, arg_max(digest, depth) AS folded_root FROM fold GROUP BY tree, idx)
SELECT r.doc_id, r.leaf, t.digest AS subroot, o.digest AS root, p.proof_sha256, f.folded_root, f.folded_root = o.digest AS verified, r.lang, r.idx
FROM numbered r JOIN subroots t ON t.tree = r.tree JOIN proofs p ON p.tree = r.tree AND p.idx = r.idx JOIN folded f ON f.tree = r.tree AND f.idx = r.idx
JOIN (SELECT digest FROM tops WHERE n = 1) o ON true
"""
