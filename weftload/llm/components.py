"""Connected components of a graph by alternating stars, and set filters of bounded size."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftload.session import written_table


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of the edges (a, b) reaches.

    Each round hangs every node's larger neighbours, then its smaller ones, onto the least of them. No
    neighbourhood is ever collected; minima are made before the shuffle, and the edges of a busy
    node are split by the skew join.
    """
    state = written_table(ordered(edges), "edges")
    mark = None
    while mark != (mark := state.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()):
        both = state.unionByName(state.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min(F.least("a", "b")).alias("m"))
        large = ordered(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        # every edge now leads from a node to a smaller one
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        down = large.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        state = written_table(ordered(down.unionByName(least.select("a", F.col("m").alias("b")))), "edges")
    roots = state.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(state.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def ordered(edges: DataFrame) -> DataFrame:
    """Each edge once, from the larger to the smaller node."""
    return edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


class Filter:
    """A bitmap that holds every added value and, by chance, some others. Its size is fixed, whatever it holds."""

    BITS = 1 << 26
    SLICE = 1 << 18

    def __init__(self, slices: dict[int, bytes]):
        self.bits = np.zeros(self.BITS // 8, np.uint8)
        for k, data in slices.items():
            self.bits[k * self.SLICE // 8 : (k + 1) * self.SLICE // 8] = np.frombuffer(data, np.uint8)

    @classmethod
    def place(cls, values: np.ndarray) -> np.ndarray:
        return (values.view(np.uint64) >> np.uint64(64 - 26)).astype(np.int64)

    def holds(self, values: np.ndarray) -> np.ndarray:
        at = self.place(values)
        return (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1

    @classmethod
    def slice_of(cls, values: np.ndarray) -> bytes:
        """The bits of values that lie in one slice."""
        out = np.zeros(cls.SLICE, bool)
        out[cls.place(values) % cls.SLICE] = True
        return np.packbits(out, bitorder="little").tobytes()

    @classmethod
    def of(cls, values: DataFrame, column: str) -> "Filter":
        """Of well mixed 64-bit values; slices are made by tasks."""

        def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
            return pa.table({"slice": pa.array([key[0].as_py()], pa.int64()), "bits": pa.array([cls.slice_of(table.column("v").to_numpy())], pa.binary())})

        place = F.shiftrightunsigned(column, 64 - 26)
        made = values.select(F.col(column).alias("v"), (place / cls.SLICE).cast("long").alias("slice")).distinct()
        return cls({r.slice: bytes(r.bits) for r in made.groupBy("slice").applyInArrow(run, "slice long, bits binary").collect()})
