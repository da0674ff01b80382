"""Connected components of an edge table, without gathering a component anywhere."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.session import materialise


class Forest:
    """Union-find over any hashable keys; the smallest key of a tree is its root."""

    def __init__(self):
        self.parent: dict = {}

    def find(self, x):
        parent = self.parent
        root = parent.setdefault(x, x)
        while parent[root] != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    def join(self, a, b) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)


#: Edges that a task unites at a time; what it holds is bounded by this.
CHUNK = 500_000


def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace the edges of a task by a forest of the same components, chunk by chunk."""

    def emit(forest: Forest) -> pa.RecordBatch:
        nodes = [x for x in forest.parent if forest.find(x) != x]
        return pa.RecordBatch.from_arrays(
            [pa.array(nodes, pa.int64()), pa.array([forest.find(x) for x in nodes], pa.int64())], names=["u", "v"]
        )

    forest, seen = Forest(), 0
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            forest.join(a, b)
        seen += batch.num_rows
        if seen >= CHUNK:
            yield emit(forest)
            forest, seen = Forest(), 0
    yield emit(forest)


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): for each node of an edge the smallest node it is connected with.

    ``edges`` has two long columns; loops and repeated edges do no harm. Each
    round unites what meets in a task with union-find, then hangs every node
    on its smallest neighbour (large star, small star); the minimum of a node
    with very many edges is combined before it is shuffled, and the join that
    follows can be split by Spark. Ends when a round changes nothing.
    """
    a, b = edges.columns
    now = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    now = now.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v"))
    now = materialise(now.mapInArrow(unite, "u long, v long"))
    before = None
    while True:
        now = materialise(_small_star(_large_star(now)))
        state = now.agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.col("v").cast("decimal(38,0)")).alias("v"), F.expr("bit_xor(xxhash64(u, v))")
        ).first()
        if state == before or state.n == 0:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        before = state
