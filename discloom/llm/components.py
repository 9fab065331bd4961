"""Connected components of a distributed edge list."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from discloom.llm.support import cut

#: Edges that one task joins by itself before it passes a forest on.
FOREST_EDGES = 1_000_000
#: Edges of all forests that one task joins to the end; more are joined in distributed rounds.
LAST_EDGES = 1 << 18


class UnionFind:
    """Disjoint sets whose root is the smallest member."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        parent, root = self.parent, x
        while (up := parent.get(root, root)) != root:
            root = up
        while x != root:
            parent[x], x = root, parent.get(x, root)
        return root

    def union(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each node of the task's edges and its root: the same components, fewer edges."""

    def emit(sets: UnionFind) -> pa.RecordBatch:
        nodes = [x for x in list(sets.parent) if sets.find(x) != x]
        return pa.RecordBatch.from_arrays(
            [pa.array(nodes, pa.int64()), pa.array([sets.find(x) for x in nodes], pa.int64())], ["u", "v"]
        )

    sets, seen = UnionFind(), 0
    for b in batches:
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            sets.union(u, v)
        seen += b.num_rows
        if seen >= FOREST_EDGES:
            yield emit(sets)
            sets, seen = UnionFind(), 0
    yield emit(sets)


def _placed(stars: DataFrame) -> DataFrame:
    """``node, root`` of edges ``u, v`` that lead from each other node to its root."""
    return stars.select(F.col("u").alias("node"), F.col("v").alias("root")).union(stars.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def components(edges: DataFrame) -> DataFrame:
    """``node long, root long`` of every node of ``edges (u long, v long)``.

    ``root`` is the smallest node that can be reached.  Tasks first reduce their
    edges to forests by union-find.  Forests of ``LAST_EDGES`` edges or fewer are
    joined by one more task, in one job instead of some forty exchanges; larger
    ones by alternating large-star and small-star steps, which take a logarithmic
    number of rounds.
    Loops and repeated edges do no harm; no edges give no rows.  Least neighbours
    are written before they are joined: Spark can then split the many neighbours
    of one node.
    """
    edges = edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).filter("u <> v")
    edges = cut(edges.mapInArrow(_forest, "u long, v long").distinct())
    if edges.count() <= LAST_EDGES:
        return _placed(cut(edges.coalesce(1).mapInArrow(_forest, "u long, v long")))
    before = None
    while True:
        # Each node hands its larger neighbours over to the smallest one around it.
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = cut(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct())
        # Each node links its smaller neighbours, and itself, to the smallest of them.
        least = cut(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        edges = cut(small.union(least.select("u", F.col("m").alias("v"))).distinct())
        after = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if after == before:
            return _placed(edges)
        before = after
