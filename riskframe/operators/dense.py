"""Vector search (RET5-RET8, RET17): exact top-k, top-k by sketches, cache lookup.

Exact search has to score every query against every document; what can be
avoided is shuffling or emitting those pairs. A query set of checked size
travels to the corpus partitions as one matrix: each partition multiplies its
Arrow batches with it and emits at most k rows per query, and the corpus itself
is not shuffled. Beyond that size queries and corpus meet in a grid of bounded
blocks. Both roads return the same hits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskframe.functions.topk import SCORE_DIGITS, best, block_hits, hit_schema, keep_best, top_hits
from riskframe.functions.vectors import cosine

# Default number of hits, cache threshold and cache size.
DENSE_TOP_K, CACHE_THRESHOLD, CACHE_MAX_ITEMS = 20, 0.92, 500

# Vectors sent to every task stay within this size (8 MB as float64), and with them the hits a task keeps.
MAX_BLOCK_VALUES = 1_000_000
# Documents of one grid cell, held by one task at a time.
MAX_CELL_ROWS = 20_000
# Scores a task holds at a time (16 MB as float64).
MAX_SCORES, QUERY_ROWS = 2_000_000, 1024


def scored_blocks(qids: np.ndarray, q: np.ndarray, ids: np.ndarray, d: np.ndarray, k: int) -> Iterator[pd.DataFrame]:
    """Best hits of every stretch of queries x documents; no more than ``MAX_SCORES`` scores exist at once."""
    for a in range(0, len(qids), QUERY_ROWS):
        part = q[a : a + QUERY_ROWS]
        step = max(1, MAX_SCORES // len(part))
        for b in range(0, len(ids), step):
            yield block_hits(qids[a : a + QUERY_ROWS], ids[b : b + step], part @ d[b : b + step].T, k)


def metadata_filter(corpus: DataFrame, where: Mapping[str, Any] | None) -> DataFrame:
    """RET8: equality predicates on metadata columns or struct fields, applied before any search."""
    for name, value in (where or {}).items():
        corpus = corpus.filter(F.col(name) == F.lit(value))
    return corpus


def unit_rows(matrix: np.ndarray) -> np.ndarray:
    length = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
    return matrix / np.where(length > 0, length, 1.0)


def _matrix(vectors: pa.Array | pa.ChunkedArray) -> np.ndarray:
    values = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return unit_rows(values.reshape(len(vectors), -1))


def _hit_schema(queries: DataFrame, corpus: DataFrame) -> T.StructType:
    return hit_schema(queries.schema["query_id"].dataType, corpus.schema["doc_id"].dataType)


def dense_search(
    queries: DataFrame,
    corpus: DataFrame,
    k: int = DENSE_TOP_K,
    where: Mapping[str, Any] | None = None,
    max_block_values: int = MAX_BLOCK_VALUES,
    max_cell_rows: int = MAX_CELL_ROWS,
) -> DataFrame:
    """RET6: exact top ``k`` by cosine as (query_id, doc_id, score, rank).

    ``queries`` has (query_id, vec), ``corpus`` (doc_id, vec, ...). Vectors
    need not have unit length; a zero vector scores 0.
    """
    # missing vectors are dropped inside the tasks: a filter here would compute vectors twice
    docs = metadata_filter(corpus, where).select("doc_id", "vec")
    asked = queries.select("query_id", "vec")
    first = asked.select(F.size("vec")).first()
    schema = _hit_schema(asked, docs)
    if first is None:
        return top_hits(queries.sparkSession.createDataFrame([], schema), k)
    max_queries = max(1, max_block_values // max(first[0], 1))
    block = asked.limit(max_queries + 1).toArrow()
    if block.num_rows <= max_queries:
        block = block.filter(block.column("vec").is_valid())
        return top_hits(_against_block(block, docs, k, schema), k)
    return top_hits(_grid(asked, docs, k, schema, max_queries, max_cell_rows), k)


def _against_block(block: pa.Table, docs: DataFrame, k: int, schema: T.StructType) -> DataFrame:
    qids = block.column("query_id").to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast((qids, _matrix(block.column("vec").combine_chunks())))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = shared.value

        def hits(batch: pa.RecordBatch) -> Iterator[pd.DataFrame]:
            batch = batch.filter(batch.column(1).is_valid())
            if batch.num_rows and len(ids):
                doc_ids = batch.column(0).to_numpy(zero_copy_only=False)
                yield from scored_blocks(ids, q, doc_ids, _matrix(batch.column(1)), k)

        return keep_best(batches, hits, len(ids), k)

    return docs.mapInArrow(score, schema)


def _grid(
    queries: DataFrame, docs: DataFrame, k: int, schema: T.StructType, max_queries: int, max_cell_rows: int
) -> DataFrame:
    """Query blocks x document cells; each pair of blocks is one bounded group.

    Rows are dealt to blocks by the hash of their id, so no source, label or
    set of copies can fill one block. Hashing is uneven by a little, hence the
    factor two of room.
    """
    blocks = math.ceil(2 * queries.count() / max_queries)
    cells = max(1, math.ceil(2 * docs.count() / max_cell_rows))
    asked = queries.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).withColumn(
        "cell", F.explode(F.sequence(F.lit(0), F.lit(cells - 1)))
    )
    placed = docs.withColumn("cell", F.pmod(F.xxhash64("doc_id"), F.lit(cells)).cast("int")).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    )

    def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left, right = left[left["vec"].notna()], right[right["vec"].notna()]
        if left.empty or right.empty:
            return pd.DataFrame({name: [] for name in schema.names})
        q = unit_rows(np.stack(left["vec"].to_list()).astype(np.float64))
        d = unit_rows(np.stack(right["vec"].to_list()).astype(np.float64))
        return best(pd.concat(scored_blocks(left["query_id"].to_numpy(), q, right["doc_id"].to_numpy(), d, k)), k)

    return asked.groupBy("block", "cell").cogroup(placed.groupBy("block", "cell")).applyInPandas(score, schema)


# Hits of the sketch that are scored exactly to find the bound every hit has to reach, per hit wanted.
OVERSAMPLE = 1.25
# Room for the rounding of scores and of the arithmetic behind them.
SLACK = 1e-8


def sketched(corpus: DataFrame) -> DataFrame:
    """``corpus`` with ``sketch``: the vector in one byte per component, scaled to its own largest; to be stored with it."""
    top = F.array_max(F.transform("vec", lambda x: F.abs(x.cast("double"))))
    sketch = F.transform("vec", lambda x: F.when(top > 0, F.round(x.cast("double") / top * 127)).otherwise(0).cast("tinyint"))
    return corpus.withColumn("sketch", sketch)


def sketch_errors(sketches: np.ndarray) -> np.ndarray:
    """Per sketch (a row of whole numbers) how far the cosine with it can be from the cosine with its vector.

    A component is off by half a step at most, so the scaled vector lies within
    half a root of the dimension from its sketch; the chord between the two
    directions bounds the difference of cosines with any unit vector.
    """
    off = 0.5 * math.sqrt(sketches.shape[1])
    sine = np.minimum(off / np.maximum(np.sqrt((sketches * sketches).sum(axis=1)), 1e-300), 1.0)
    chord = np.where(sine < 1, 2 * np.sin(np.arcsin(sine) / 2), 2.0)
    return np.where(sketches.any(axis=1), chord, 0.0) + SLACK


def dense_search_ann(
    queries: DataFrame,
    corpus: DataFrame,
    k: int = DENSE_TOP_K,
    where: Mapping[str, Any] | None = None,
    oversample: float = OVERSAMPLE,
) -> DataFrame:
    """RET7: top ``k`` by one-byte sketches, then exact cosines of the documents they leave.

    The exact cosines of the first ``oversample`` * ``k`` by sketch give a
    score that the k-th hit reaches at least. Every document whose sketch comes
    within its error of that score for any query is kept, near copies and equal
    sketches included, and goes through `dense_search`. Only the sketches are
    read for the whole corpus (a quarter of the bytes of single-precision
    vectors when ``corpus`` has the column ``sketch`` stored). Query sets
    beyond one block are searched without sketches.
    """
    docs = metadata_filter(corpus, where)
    asked = queries.select("query_id", "vec")
    first = asked.select(F.size("vec")).first()
    if first is None or asked.limit((most := max(1, MAX_BLOCK_VALUES // max(first[0], 1))) + 1).count() > most:
        return dense_search(asked, docs, k)
    short = (docs if "sketch" in docs.columns else sketched(docs)).select("doc_id", F.col("sketch").alias("vec"))
    near = dense_search(asked, short, math.ceil(oversample * k))
    exact = docs.where("vec IS NOT NULL").select("doc_id", F.col("vec").alias("dv"))
    pairs = near.select("query_id", "doc_id").join(exact, "doc_id").join(asked.where("vec IS NOT NULL").withColumnRenamed("vec", "qv"), "query_id")
    scored = top_hits(pairs.select("query_id", "doc_id", F.round(cosine("qv", "dv"), SCORE_DIGITS).alias("score")), k)
    # fewer than k hits bound nothing
    bounds = scored.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("bound"))
    block = asked.where("vec IS NOT NULL").join(bounds, "query_id", "left").select("vec", F.coalesce("bound", F.lit(-2.0)).alias("bound")).toArrow()
    return dense_search(asked, docs.join(_within(block, short).distinct(), "doc_id", "left_semi"), k)


def _within(block: pa.Table, short: DataFrame) -> DataFrame:
    """(doc_id) of the documents whose sketch comes within its error of the bound of a query of ``block`` (vec, bound)."""
    if not block.num_rows:
        return short.select("doc_id").limit(0)
    shared = short.sparkSession.sparkContext.broadcast((_matrix(block.column("vec").combine_chunks()), block.column("bound").to_numpy()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, bound = shared.value
        for batch in batches:
            batch = batch.filter(batch.column(1).is_valid())
            if not batch.num_rows:
                continue
            raw = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
            d, error = unit_rows(raw), sketch_errors(raw)
            keep = np.zeros(len(d), bool)
            for a in range(0, len(q), QUERY_ROWS):
                step = max(1, MAX_SCORES // len(q[a : a + QUERY_ROWS]))
                for b in range(0, len(d), step):
                    least = q[a : a + QUERY_ROWS] @ d[b : b + step].T + error[b : b + step] - bound[a : a + QUERY_ROWS, None]
                    keep[b : b + step] |= (least >= 0).any(axis=0)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep))], names=["doc_id"])

    return short.mapInArrow(run, T.StructType([short.schema["doc_id"]]))


def cache_lookup(
    queries: DataFrame,
    cache: DataFrame,
    threshold: float = CACHE_THRESHOLD,
    max_items: int = CACHE_MAX_ITEMS,
) -> DataFrame:
    """RET17: the best cached entry of each query with cosine >= ``threshold``.

    ``cache`` has (entry_id, vec, payload); the entry with the lowest id wins
    ties. Returns (query_id, entry_id, similarity, payload). A cache holds at
    most ``max_items`` entries (`cache_retain`), which bounds what is sent to
    the tasks: queries are matched where they are, without a shuffle. A larger
    table goes through `dense_search`.
    """
    asked = queries.select("query_id", "vec")
    entries = cache.select("entry_id", "vec")
    block = entries.limit(max_items + 1).toArrow()
    if block.num_rows > max_items:
        hits = dense_search(asked, entries.withColumnRenamed("entry_id", "doc_id"), 1)
        found = hits.select("query_id", F.col("doc_id").alias("entry_id"), F.col("score").alias("similarity"))
    else:
        found = _best_entry(asked, block, entries.schema["entry_id"].dataType)
    found = found.filter((F.col("similarity") >= threshold) & (F.col("similarity") > 0))
    return found.join(cache.select("entry_id", "payload"), "entry_id")


def _best_entry(queries: DataFrame, block: pa.Table, id_type: T.DataType) -> DataFrame:
    block = block.filter(block.column("vec").is_valid()).sort_by("entry_id")
    ids = block.column("entry_id").to_numpy()
    matrix = _matrix(block.column("vec").combine_chunks()) if len(ids) else np.zeros((0, 0))
    shared = queries.sparkSession.sparkContext.broadcast((ids, matrix))
    schema = T.StructType(
        [
            queries.schema["query_id"],
            T.StructField("entry_id", id_type),
            T.StructField("similarity", T.DoubleType()),
        ]
    )

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entry_ids, entries = shared.value
        for batch in batches:
            batch = batch.filter(batch.column(1).is_valid())
            if batch.num_rows == 0 or len(entry_ids) == 0:
                continue
            scores = np.round(_matrix(batch.column(1)) @ entries.T, SCORE_DIGITS) + 0.0
            at = scores.argmax(axis=1)  # first of equal scores
            out = pd.DataFrame(
                {
                    "query_id": batch.column(0).to_numpy(zero_copy_only=False),
                    "entry_id": entry_ids[at],
                    "similarity": scores[np.arange(len(at)), at],
                }
            )
            yield pa.RecordBatch.from_pandas(out, preserve_index=False)

    return queries.mapInArrow(match, schema)


def pair_cosines(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """RET5 on a table of vector pairs: adds ``cosine``."""
    return pairs.withColumn("cosine", cosine(a, b))
