"""A stored approximate vector index (RET7): coarse cells as partition folders, residual codes, exact rescoring.

Vectors are stored by the nearest of some coarse centres, each with a code of
one byte per component of what it differs from its centre. A query reads the
folders of its nearest cells only. Codes tell how far a cosine can be at most
from its estimate, so what a cell leaves to be scored exactly cannot miss a hit
of that cell; where codes do not part the vectors of a cell (near copies), the
query is scored exactly on the whole cell, block by block.

Centres, and the number of cells to probe, are fitted on bounded samples
(``SAMPLE`` vectors, ``TRIALS`` queries); every vector is indexed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskframe.functions.topk import SCORE_DIGITS, best, hit_schema, top_hits
from riskframe.functions.vectors import cosine
from riskframe.operators.dense import DENSE_TOP_K, MAX_BLOCK_VALUES, MAX_CELL_ROWS, dense_search, scored_blocks, unit_rows
from riskframe.session import materialise

#: Vectors and rounds for the centres, most cells, trial queries and the share of their hits that the probed cells must hold.
SAMPLE, ROUNDS, MAX_CELLS, TRIALS, COVERED = 20_000, 8, 4096, 200, 0.97
#: Rows of a file, and candidates per hit wanted that codes may leave in a block.
FILE_ROWS, OPEN = 200_000, 4
#: Room for the rounding of scores and of the arithmetic behind them.
SLACK = 1e-8


@dataclass(frozen=True)
class VectorIndex:
    """vectors (doc_id, vec, code, scale, cell) in folders by cell, centres by cell, rows by cell, cells to probe."""

    vectors: DataFrame
    centres: np.ndarray
    rows: dict[int, int]
    probes: int


def fitted_centres(sample: np.ndarray, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centres of unit length by spherical k-means; rows of ``sample`` have unit length and come in a fixed random order."""
    centres = sample[:: max(1, len(sample) // cells)][:cells].copy()
    if not len(sample):
        return centres
    for _ in range(rounds):
        nearest = (sample @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, sample)
        used = np.bincount(nearest, minlength=len(centres)) > 0
        centres[used] = unit_rows(sums[used])
    return centres


def _rows(column: pa.Array) -> np.ndarray:
    return unit_rows(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1))


def write_vector_index(corpus: DataFrame, path: str, cells: int | None = None, k: int = DENSE_TOP_K) -> None:
    """Store all vectors of ``corpus`` (doc_id, vec) under ``path``; rows without a vector are left out."""
    base = corpus.select("doc_id", "vec").where("vec IS NOT NULL")
    total = base.count()
    mixed = base.orderBy(F.xxhash64("doc_id"), "doc_id")
    sample = mixed.limit(SAMPLE).toArrow()
    matrix = _rows(sample.column("vec").combine_chunks()) if sample.num_rows else np.zeros((0, 1))
    cells = cells or max(1, min(MAX_CELLS, round(math.sqrt(total))))
    centres = fitted_centres(matrix, min(cells, max(1, len(matrix))))
    schema = T.StructType([*base.schema.fields, T.StructField("code", T.BinaryType()), T.StructField("scale", T.DoubleType()), T.StructField("cell", T.IntegerType())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit = _rows(batch.column(1))
            cell = (unit @ centres.T).argmax(axis=1)
            rest = unit - centres[cell]
            scale = np.maximum(np.abs(rest).max(axis=1), 1e-12) / 127
            code = np.round(rest / scale[:, None]).astype(np.int8)
            columns = [*batch.columns, pa.array([c.tobytes() for c in code], pa.binary()), pa.array(scale), pa.array(cell.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    placed = materialise(base.mapInArrow(place, schema))
    counts = {r["cell"]: r["n"] for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    spark = corpus.sparkSession
    if not counts:  # a file that tells the columns
        placed.coalesce(1).write.mode("overwrite").parquet(f"{path}/vectors")
        spark.createDataFrame([], "cell int, n long, centre array<double>, probes int").write.mode("overwrite").parquet(f"{path}/cells")
        return
    files = spark.createDataFrame([(c, -(-n // FILE_ROWS)) for c, n in counts.items()], "cell int, files int")
    dealt = placed.join(F.broadcast(files), "cell").withColumn("file", F.pmod(F.xxhash64("doc_id"), F.col("files")))
    dealt.repartition("cell", "file").drop("files", "file").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/vectors")

    trials = mixed.limit(TRIALS).select(F.col("doc_id").alias("query_id"), "vec")
    probes = _probes(trials, base, placed, centres, k)
    rows = [(c, counts.get(c, 0), x.tolist(), probes) for c, x in enumerate(centres)]
    spark.createDataFrame(rows, "cell int, n long, centre array<double>, probes int").write.mode("overwrite").parquet(f"{path}/cells")


def _probes(trials: DataFrame, base: DataFrame, placed: DataFrame, centres: np.ndarray, k: int) -> int:
    """The number of nearest cells that hold the share ``COVERED`` of the trial queries' exact hits."""
    trials = materialise(trials)
    hits = dense_search(trials, base, k).join(placed.select("doc_id", "cell"), "doc_id").select("query_id", "cell").toArrow()
    asked = trials.toArrow()
    order = np.argsort(-(_rows(asked.column("vec").combine_chunks()) @ centres.T), axis=1, kind="stable")
    place = np.argsort(order, axis=1)
    row = {q: i for i, q in enumerate(asked.column("query_id").to_pylist())}
    depth = np.sort([place[row[q], c] for q, c in zip(hits.column("query_id").to_pylist(), hits.column("cell").to_pylist())])
    return int(depth[max(0, math.ceil(COVERED * len(depth)) - 1)]) + 1 if len(depth) else 1


def read_vector_index(spark: SparkSession, path: str) -> VectorIndex:
    cells = sorted(spark.read.parquet(f"{path}/cells").collect(), key=lambda r: r["cell"])  # at most ``MAX_CELLS`` rows
    vectors = spark.read.parquet(f"{path}/vectors")
    return VectorIndex(vectors, np.array([r["centre"] for r in cells]), {r["cell"]: r["n"] for r in cells}, cells[0]["probes"] if cells else 1)


def probed(queries: DataFrame, index: VectorIndex, probes: int | None = None) -> DataFrame:
    """(query_id, q, cell): each query (query_id, vec) with its nearest cells; ``q`` has unit length."""
    centres, n = index.centres, min(probes or index.probes, len(index.centres))
    held = np.array([index.rows.get(c, 0) > 0 for c in range(len(centres))])
    schema = T.StructType([queries.schema["query_id"], T.StructField("q", T.ArrayType(T.DoubleType())), T.StructField("cell", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                part = part.filter(part.column(1).is_valid())
                if not part.num_rows:
                    continue
                q = _rows(part.column(1))
                near = np.argsort(np.where(held, -(q @ centres.T), np.inf), axis=1, kind="stable")[:, :n]
                row = pa.array(np.repeat(np.arange(len(q)), near.shape[1]))
                lists = pa.array(list(q), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([part.column(0).take(row), lists.take(row), pa.array(near.ravel().astype(np.int32))], names=schema.names)

    return queries.select("query_id", "vec").mapInArrow(run, schema)


def in_cells(index: VectorIndex, cells: list[int]) -> DataFrame:
    """The stored vectors of some cells; other folders are not read."""
    return index.vectors.where(F.col("cell").isin(cells))


def _grid(asked: DataFrame, docs: DataFrame, index: VectorIndex, score, schema: T.StructType) -> DataFrame:
    """Cell by cell, blocks of queries x blocks of vectors, dealt by hash, each pair one bounded group for ``score``."""
    dim, spark = index.centres.shape[1], docs.sparkSession
    n = {r["cell"]: r["n"] for r in asked.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    blocks = [(c, -(-2 * m * dim // MAX_BLOCK_VALUES), max(1, -(-2 * index.rows.get(c, 0) // MAX_CELL_ROWS))) for c, m in n.items()]
    sizes = F.broadcast(spark.createDataFrame(blocks, "cell int, qbs long, dbs long"))
    each = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    left = asked.join(sizes, "cell").select("query_id", "q", "cell", F.pmod(F.xxhash64("query_id"), F.col("qbs")).alias("qb"), each("dbs").alias("db"))
    right = docs.join(sizes, "cell").select(*docs.columns, F.pmod(F.xxhash64("doc_id"), F.col("dbs")).alias("db"), each("qbs").alias("qb"))
    return left.groupBy("cell", "qb", "db").cogroup(right.groupBy("cell", "qb", "db")).applyInPandas(score, schema)


def vector_search(queries: DataFrame, index: VectorIndex, k: int = DENSE_TOP_K, probes: int | None = None) -> DataFrame:
    """RET7: top ``k`` by cosine among the vectors of each query's nearest cells, as (query_id, doc_id, score, rank).

    Any number of queries (query_id, vec). Within the probed cells the hits are
    the exact ones.
    """
    if not len(index.centres):
        kinds = hit_schema(queries.schema["query_id"].dataType, index.vectors.schema["doc_id"].dataType)
        return top_hits(queries.sparkSession.createDataFrame([], kinds), k)
    asked = materialise(probed(queries, index, probes))
    cells = [r["cell"] for r in asked.select("cell").distinct().collect()]  # at most ``MAX_CELLS``
    docs = in_cells(index, cells)
    kinds = (queries.schema["query_id"].dataType, docs.schema["doc_id"].dataType)
    hits = hit_schema(*kinds)
    found = materialise(_candidates(asked, docs, index, k, hits))
    # a row without document says that the codes of a block leave too many
    open_cells = found.where("doc_id IS NULL").select("query_id", "cell").distinct()
    named = found.where("doc_id IS NOT NULL").join(open_cells, ["query_id", "cell"], "left_anti")
    low = top_hits(found.where("doc_id IS NOT NULL").select("query_id", "doc_id", F.col("score").alias("score")), k)
    least = low.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("least"))
    near = named.join(least, "query_id", "left").where("least IS NULL OR most >= least").select("query_id", "cell", "doc_id")
    pairs = near.join(docs.select("cell", "doc_id", "vec"), ["cell", "doc_id"]).join(asked.select("query_id", "cell", "q"), ["query_id", "cell"])
    exact = pairs.select("query_id", "doc_id", F.round(cosine("q", "vec"), SCORE_DIGITS).alias("score"))
    crowded = materialise(asked.join(open_cells, ["query_id", "cell"], "left_semi"))
    if not crowded.isEmpty():
        full = [r["cell"] for r in crowded.select("cell").distinct().collect()]
        exact = exact.unionByName(_grid(crowded, in_cells(index, full).select("doc_id", "cell", "vec"), index, _exactly(k, hits), hits))
    return top_hits(exact, k)


def _exactly(k: int, schema: T.StructType):
    import pandas as pd

    def score(left, right):
        if left.empty or right.empty:
            return pd.DataFrame({n: [] for n in schema.names})
        q, d = np.stack(left["q"].to_list()), unit_rows(np.stack(right["vec"].to_list()).astype(np.float64))
        return best(pd.concat(scored_blocks(left["query_id"].to_numpy(), q, right["doc_id"].to_numpy(), d, k)), k)

    return score


def _candidates(asked: DataFrame, docs: DataFrame, index: VectorIndex, k: int, hits: T.StructType) -> DataFrame:
    """(query_id, doc_id, score, most, cell): vectors that can be hits, with the least and the greatest cosine their codes allow."""
    import pandas as pd

    centres, dim = index.centres, index.centres.shape[1]
    schema = T.StructType([*hits.fields, T.StructField("most", T.DoubleType()), T.StructField("cell", T.IntegerType())])

    def score(left, right):
        none = pd.DataFrame({n: [] for n in schema.names})
        if left.empty or right.empty:
            return none
        cell, ids, qids = int(left["cell"].iloc[0]), right["doc_id"].to_numpy(), left["query_id"].to_numpy()
        scale = right["scale"].to_numpy()
        code = np.frombuffer(b"".join(right["code"]), np.int8).reshape(len(right), dim).astype(np.float64) * scale[:, None]
        error, out = 0.5 * math.sqrt(dim) * scale + SLACK, []
        q = np.stack(left["q"].to_list())
        step = max(1, 2_000_000 // len(ids))
        for a in range(0, len(q), step):
            part = q[a : a + step]
            estimate = (part @ centres[cell])[:, None] + part @ code.T
            lowest, most = estimate - error, estimate + error
            m = min(k, len(ids))
            bound = np.partition(lowest, len(ids) - m, axis=1)[:, len(ids) - m]
            keep = most >= bound[:, None]
            crowd = keep.sum(axis=1) > OPEN * k
            row, col = np.nonzero(keep & ~crowd[:, None])
            out.append(pd.DataFrame({"query_id": qids[a : a + step][row], "doc_id": ids[col], "score": lowest[row, col], "most": most[row, col]}))
            if crowd.any():
                out.append(pd.DataFrame({"query_id": qids[a : a + step][crowd], "doc_id": None, "score": None, "most": None}))
        found = pd.concat(out, ignore_index=True).astype({"score": "float64", "most": "float64"})
        found["cell"] = cell
        if found["doc_id"].dtype == object and pd.api.types.is_integer_dtype(right["doc_id"].dtype):
            found["doc_id"] = found["doc_id"].astype("Int64")
        return found[schema.names]

    return _grid(asked, docs.select("doc_id", "cell", "code", "scale"), index, score, schema)
