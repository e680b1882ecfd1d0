"""Connected components of an edge table, by contraction."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage, unstage

#: Edges that one task may finish (16 bytes each); more are contracted in rounds first.
LAST_EDGES = 250_000
#: Nodes that a task holds before it tells their stars and starts anew.
HELD_NODES = 500_000


class Forest:
    """Union-find over arbitrary ids; the smaller root wins."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        root, parent = x, self.parent
        while (up := parent.get(root, root)) != root:
            root = up
        while x != root:
            parent[x], x = root, parent.get(x, x)
        return root

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def stars(self) -> tuple[np.ndarray, np.ndarray]:
        """(node, root) of every node that isn't a root."""
        nodes = list(self.parent)
        return np.array(nodes, np.int64), np.array([self.find(x) for x in nodes], np.int64)


def star_batches(batches: Iterable[pa.RecordBatch]):
    """The edges of a partition as stars: at most one edge for each node of HELD_NODES."""
    forest = Forest()

    def told() -> pa.RecordBatch:
        node, root = forest.stars()
        return pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], names=["a", "b"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            forest.join(a, b)
        if len(forest.parent) > HELD_NODES:
            yield told()
            forest = Forest()
    yield told()


def components(edges: DataFrame) -> DataFrame:
    """node, root of every node of ``edges`` (a long, b long) whose root is another node.

    A round replaces each partition's edges by stars, points every node at the least node
    near it, and keeps the edges between what remains; edges shrink until one task can
    finish them.  Each round is staged, so a lost executor costs one round at most.
    """
    levels: list[DataFrame] = []
    edges = stage(edges.select("a", "b").filter(F.col("a") != F.col("b")).mapInArrow(star_batches, "a long, b long").distinct(), "edges")
    while edges.count() > LAST_EDGES:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("up"))
        near = stage(near, "near")
        upper = near.select(F.col("node").alias("up"), F.col("up").alias("top"))
        level = stage(near.join(upper, "up").select("node", F.col("top").alias("root")).filter(F.col("node") != F.col("root")), "level")
        levels.append(level)
        at_a, at_b = (level.select(F.col("node").alias(c), F.col("root").alias(f"r{c}")) for c in "ab")
        moved = edges.join(at_a, "a", "left").join(at_b, "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
        smaller = stage(moved.filter(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
                        .mapInArrow(star_batches, "a long, b long").distinct(), "edges")
        unstage(edges, near)
        edges = smaller
    labels = edges.coalesce(1).mapInArrow(star_batches, "a long, b long").select(F.col("a").alias("node"), F.col("b").alias("root"))
    for level in reversed(levels):
        deeper = labels.select(F.col("node").alias("root"), F.col("root").alias("top"))
        lifted = level.join(deeper, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
        labels = lifted.unionByName(labels.join(level.select("node"), "node", "left_anti"))
    return stage(labels, "components")
