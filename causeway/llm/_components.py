"""Connected components: by alternating large and small stars on DataFrames, and in one task once the edges are few."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.llm import _common as C
from causeway.llm._common import cut

#: Edges that one task joins at most, in a second or two and some 150 MB. A round of stars writes some ten shuffles, each with files
#: for every partition, which for few edges is far more disk and time than the edges need.
ONE_TASK = 1 << 20


class Forest:
    """Union-find over the numbers below n; a root is the least of its component."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: np.ndarray, b: np.ndarray) -> list[int]:
        """The numbers of those links that join two components."""
        kept = []
        for i, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
            x, y = self.root(x), self.root(y)
            if x != y:
                self.up[max(x, y)] = min(x, y)
                kept.append(i)
        return kept


def _sign(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, component) of all edges (u, v) at once."""
    t = C.gathered(batches, pa.schema([("u", pa.int64()), ("v", pa.int64())]))
    if len(t):
        own, at = np.unique(np.concatenate([C.array_of(t, "u"), C.array_of(t, "v")]), return_inverse=True)
        forest = Forest(len(own))
        forest.join(at[: len(t)], at[len(t) :])
        roots = np.fromiter((forest.root(x) for x in range(len(own))), np.int64, len(own))
        yield pa.RecordBatch.from_arrays([C.longs(own), C.longs(own[roots])], names=["node", "component"])


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge; component is the least node that it reaches.
    Up to ONE_TASK edges are joined in one task. More go through rounds of stars until they are so few, or don't change:
    minima are combined before each shuffle, so a node with very many edges is no single task's
    work; rounds grow with the logarithm of the longest path, and each is written to the shared
    checkpoint folder. Ends are long; edges with a null end, loops and repeats are ignored."""
    e = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    e = cut(e.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).distinct())
    before = None
    while before != (before := _sign(e)):
        if before[0] <= ONE_TASK:
            return e.coalesce(1).mapInArrow(C.lean(_joined), "node long, component long")
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = cut(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(small.union(least.select("u", F.col("m").alias("v"))).distinct())
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
