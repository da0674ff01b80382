"""Exact cosine range join of vectors: pivots cut the space into cells that are joined one by one.

On unit vectors a cosine of at least c is a Euclidean distance of at most
r = sqrt(2 - 2c). Every vector lives in the cell of its nearest pivot. If a
partner within r lives in the cell of pivot q, the line between them crosses
the plane midway between p and q, so the vector is at most r from that plane;
by the triangle inequality it is also within r of the ball that holds q's
vectors. Where both hold it is copied to q's cell; of the two cells of a pair
one is told off by their numbers, so each pair meets once.

Equal vectors are one row with a weight. A cell's home vectors are dealt into
blocks of bounded size, and a task holds one block while the cell's other
vectors stream past. It returns counts per vector and a forest of its links,
never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.llm.graph import Forest, components
from riskframe.session import materialise

#: Vectors per home block; pivots come from a bounded sample and are as many as make cells of about a block.
BLOCK, SAMPLE, PIVOTS = 4096, 8192, (16, 1024)
#: Single precision screens pairs; what comes this near the bound is computed in double precision.
MARGIN = 1e-4
TILE = 1024


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, safe for very large and very small values."""
    scaled = rows / np.abs(rows).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def choose_pivots(sample: np.ndarray, k: int) -> np.ndarray:
    """Farthest-first: each next pivot is the sample vector farthest from those chosen; equal ones are left out."""
    chosen = [0]
    nearest = np.full(len(sample), np.inf)
    while len(chosen) < min(k, len(sample)):
        nearest = np.minimum(nearest, 2 - 2 * (sample @ sample[chosen[-1]]))
        far = int(nearest.argmax())
        if nearest[far] < 1e-6:
            break
        chosen.append(far)
    return sample[chosen]


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (x @ pivots.T), 0))


def copies(d: np.ndarray, home: np.ndarray, between: np.ndarray, radius: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, cell) of the cells besides its own in which a vector has to meet the home vectors."""
    own = d[np.arange(len(d)), home][:, None]
    cells = np.arange(d.shape[1])[None, :]
    plane = (d * d - own * own) / (2 * np.maximum(between[home], 1e-9)) <= reach + 1e-6
    ball = d <= radius[None, :] + reach + 1e-6
    turn = np.where((home[:, None] + cells) % 2 == 1, cells < home[:, None], cells > home[:, None])
    return np.nonzero(plane & ball & turn)


class Block:
    """One block of home vectors, with what has been found for each."""

    def __init__(self, cosine: float):
        self.cosine = cosine
        self.parts: list[tuple] = []
        self.ids = None

    def add(self, ids: np.ndarray, weights: np.ndarray, x: np.ndarray) -> None:
        self.parts.append((ids, weights, x))

    def close(self) -> None:
        self.ids, self.weights, self.x = (np.concatenate(c) for c in zip(*self.parts))
        self.single = self.x.astype(np.float32)
        self.links = np.zeros(len(self.ids), np.int64)
        self.forest = Forest()
        self.root = self.ids.copy()
        self.meet(self.ids, self.weights, self.x, inner=True)

    def meet(self, ids: np.ndarray, weights: np.ndarray, x: np.ndarray, inner: bool = False) -> list[tuple[int, int, int]]:
        """Compare with the block; (id, links, root) of the comers that link. The block's own counts are raised.

        A comer is not kept: it is given out with one tree of the block that it
        links with, and the other trees it touches are united with that one.
        """
        found = np.zeros(len(ids), np.int64)
        tree: dict[int, int] = {}
        for a in range(0, len(ids), TILE):
            rows = x[a : a + TILE]
            near = rows.astype(np.float32) @ self.single.T >= self.cosine - MARGIN
            i, j = np.nonzero(near)
            if inner:
                keep = i + a < j
                i, j = i[keep], j[keep]
            hit = np.empty(len(i), bool)
            for s in range(0, len(i), 65_536):
                p, q = i[s : s + 65_536], j[s : s + 65_536]
                hit[s : s + 65_536] = np.einsum("nd,nd->n", rows[p], self.x[q]) >= self.cosine
            i, j = i[hit] + a, j[hit]
            np.add.at(found, i, self.weights[j])
            np.add.at(self.links, j, weights[i])
            self.unite(ids, i, j, None if inner else tree)
        if inner:
            self.links += found
        return [(int(ids[i]), int(found[i]), self.forest.find(tree[i])) for i in tree]

    def unite(self, ids: np.ndarray, i: np.ndarray, j: np.ndarray, tree: dict[int, int] | None) -> None:
        """Add links to the forest of the block's own vectors, each row once with each tree that it touches."""
        for s in range(0, len(i), 4096):
            pairs = np.unique(np.stack([i[s : s + 4096], self.root[j[s : s + 4096]]]), axis=1)
            for a, b in pairs.T.tolist():
                self.forest.join(int(ids[a]) if tree is None else tree.setdefault(a, b), b)
            touched = np.unique(j[s : s + 4096])
            self.root[touched] = [self.forest.find(int(v)) for v in self.root[touched]]

    def result(self) -> list[tuple[int, int, int]]:
        """(id, links, root); links 0 where only the root matters."""
        nodes = [x for x in self.forest.parent if self.forest.find(x) != x]
        linked = self.links > 0
        return [
            *((x, 0, self.forest.find(x)) for x in nodes),
            *((int(x), int(n), int(x)) for x, n in zip(self.ids[linked], self.links[linked])),
        ]


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _rows(columns: list[np.ndarray], x: np.ndarray) -> pa.RecordBatch:
    vectors = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
    return pa.RecordBatch.from_arrays([*map(pa.array, columns), vectors], names=["cell", "block", "role", "id", "weight", "x"])


def _homes(classes: DataFrame, pivots: np.ndarray) -> DataFrame:
    """(cell, home vectors, greatest distance from the pivot) of each cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, radius = np.zeros(len(pivots), np.int64), np.zeros(len(pivots))
        for b in batches:
            d = distances(unit(_matrix(b.column(0))), pivots)
            home = d.argmin(axis=1)
            n += np.bincount(home, minlength=len(pivots))
            np.maximum.at(radius, home, d[np.arange(len(d)), home])
        cells = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(n[cells]), pa.array(radius[cells])], names=["cell", "n", "radius"])

    return classes.select("x").mapInArrow(run, "cell long, n long, radius double").groupBy("cell").agg(F.sum("n").alias("n"), F.max("radius").alias("radius"))


def _links(classes: DataFrame, cosine: float) -> DataFrame:
    """(id, links, root) rows for classes (id, weight, x) of vectors of one dimension."""
    reach = float(np.sqrt(max(2 - 2 * cosine, 0)))
    total = classes.count()
    rows = classes.select("x").orderBy(F.xxhash64("x")).limit(SAMPLE).collect()
    k = int(np.clip(-(-total // BLOCK), *PIVOTS))
    pivots = choose_pivots(unit(np.array([r.x for r in rows], np.float64)), k)
    between = distances(pivots, pivots)
    radius, blocks = np.zeros(len(pivots)), np.ones(len(pivots), np.int64)
    for r in _homes(classes, pivots).collect():
        radius[r.cell], blocks[r.cell] = r.radius, -(-r.n // BLOCK)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, TILE):
                part = b.slice(s, TILE)
                ids, weights = part.column(0).to_numpy(), part.column(1).to_numpy()
                x = unit(_matrix(part.column(2)))
                d = distances(x, pivots)
                home = d.argmin(axis=1)
                block = (ids * 0x9E3779B1 >> 7) % blocks[home]
                yield _rows([home, block, np.zeros_like(home), ids, weights], x)
                row, cell = copies(d, home, between, radius, reach)
                # Home vectors of a later block also pass the earlier blocks of their cell.
                own = np.repeat(np.arange(len(ids)), block)
                own_block = np.concatenate([np.arange(n) for n in block]) if len(own) else own
                out = np.repeat(row, blocks[cell])
                out_block = np.concatenate([np.arange(n) for n in blocks[cell]]) if len(row) else row
                at = np.concatenate([own, out])
                cells = np.concatenate([home[own], np.repeat(cell, blocks[cell])])
                for t in range(0, len(at), 8 * TILE):
                    i = at[t : t + 8 * TILE]
                    block_ = np.concatenate([own_block, out_block])[t : t + 8 * TILE].astype(np.int64)
                    yield _rows([cells[t : t + 8 * TILE], block_, np.ones_like(i), ids[i], weights[i]], x[i])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def give(rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(3)], names=["id", "links", "root"])

        at, block = None, None
        for b in batches:
            cell, number, role, ids, weights = (b.column(i).to_numpy() for i in range(5))
            x = _matrix(b.column(5))
            edges = np.flatnonzero((np.diff(cell) != 0) | (np.diff(number) != 0) | (np.diff(role) != 0)) + 1
            for s, e in zip([0, *edges], [*edges, len(cell)]):
                if s == e:
                    continue
                if at != (cell[s], number[s]):
                    if block:
                        if block.ids is None:
                            block.close()
                        yield give(block.result())
                    at, block = (cell[s], number[s]), Block(cosine)
                part = ids[s:e], weights[s:e], x[s:e]
                if role[s] == 0:
                    block.add(*part)
                elif block.parts:
                    if block.ids is None:
                        block.close()
                    yield give(block.meet(*part))
        if block and block.parts:
            if block.ids is None:
                block.close()
            yield give(block.result())

    dealt = classes.select("id", "weight", "x").mapInArrow(deal, "cell long, block long, role long, id long, weight long, x array<double>")
    together = dealt.repartition("cell", "block").sortWithinPartitions("cell", "block", "role")
    return together.mapInArrow(join, "id long, links long, root long")


def range_join(vectors: DataFrame, cosine: float = 0.95, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors``.

    ``n_links`` counts the other vectors at a cosine of at least ``cosine``,
    ``component_id`` is the smallest id reachable over links. Vectors that are
    null, empty, zero or hold null or non-finite components link with nothing,
    nor do vectors of different dimensions; an empty table gives an empty
    result. Equal vectors under different ids are linked; a null id links with
    nothing.
    """
    x = F.col(vector).cast("array<double>")
    sound = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    plain = vectors.select(
        F.col(id_col).cast("long").alias("id"), F.when(sound & F.col(id_col).isNotNull(), x).alias("x")
    )
    classes = plain.where("x IS NOT NULL").groupBy("x").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("weight"))
    classes = materialise(classes.select(F.col("rep").alias("id"), "weight", "x"))
    sizes = [r[0] for r in classes.select(F.size("x")).distinct().collect()]
    found = None
    for n in sizes:
        rows = materialise(_links(classes.where(F.size("x") == n), cosine))
        found = rows if found is None else found.union(rows)
    if found is None:
        found = vectors.sparkSession.createDataFrame([], "id long, links long, root long")
    links = found.groupBy("id").agg(F.sum("links").alias("links")).withColumnRenamed("id", "rep")
    united = components(found.select("id", "root"))
    by_class = (
        classes.withColumnRenamed("id", "rep")
        .join(links, "rep", "left")
        .join(united.withColumnRenamed("node", "rep"), "rep", "left")
        .select("x", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n"), F.coalesce("component", "rep").alias("component"))
    )
    alone = plain.where("x IS NULL").select("id", F.lit(0).cast("long").alias("n"), F.col("id").alias("component"))
    whole = plain.where("x IS NOT NULL").join(by_class, "x").select("id", "n", "component").union(alone)
    return whole.select(
        F.col("id").alias("vec_id"),
        F.col("n").alias("n_links"),
        F.col("component").alias("component_id"),
        F.col("id").eqNullSafe(F.col("component")).alias("kept"),
    )
