"""Top-k per query inside a task: helpers for operators that score blocks of documents.

A task sees its documents in Arrow batches, scores each batch against all
queries at once and keeps at most k rows per query, so what leaves a task does
not grow with its documents.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

# Scores are compared after rounding, so the order of summation cannot reorder hits.
SCORE_DIGITS = 9


def top_hits(scored: DataFrame, k: int, by: str = "score") -> DataFrame:
    """Best ``k`` per query by score, then document id, with ``rank`` from 1."""
    w = Window.partitionBy("query_id").orderBy(F.desc(by), "doc_id")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def hit_schema(query_type: T.DataType, doc_type: T.DataType) -> T.StructType:
    return T.StructType(
        [
            T.StructField("query_id", query_type),
            T.StructField("doc_id", doc_type),
            T.StructField("score", T.DoubleType()),
        ]
    )


def best(hits: pd.DataFrame, k: int) -> pd.DataFrame:
    ordered = hits.sort_values(["query_id", "score", "doc_id"], ascending=[True, False, True], kind="stable")
    return ordered.groupby("query_id", sort=False).head(k)


def block_hits(qids: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> pd.DataFrame:
    """Rows of one document block that can be in the top ``k`` of a query; ``scores`` is queries x documents.

    All rows at or above the k-th score are taken, then cut to k by document
    id, so equal scores are settled the same way everywhere.
    """
    scores = np.round(scores, SCORE_DIGITS) + 0.0
    m = scores.shape[1]
    if m <= k:
        rows, cols = np.nonzero(np.ones_like(scores, dtype=bool))
        return pd.DataFrame({"query_id": qids[rows], "doc_id": ids[cols], "score": scores[rows, cols]})
    kth = np.partition(scores, m - k, axis=1)[:, m - k]
    rows, cols = np.nonzero(scores >= kth[:, None])
    return best(pd.DataFrame({"query_id": qids[rows], "doc_id": ids[cols], "score": scores[rows, cols]}), k)


def keep_best(
    batches: Iterator[pa.RecordBatch], score: Callable[[pa.RecordBatch], Iterator[pd.DataFrame]], queries: int, k: int
) -> Iterator[pa.RecordBatch]:
    """Hits of all batches of a task, cut to k per query whenever enough have gathered."""
    kept: list[pd.DataFrame] = []
    rows, room = 0, 16 * queries * k
    for batch in batches:
        for hits in score(batch):
            kept.append(hits)
            rows += len(hits)
            if rows > room:
                kept = [best(pd.concat(kept), k)]
                rows = len(kept[0])
    if kept:
        yield pa.RecordBatch.from_pandas(best(pd.concat(kept), k), preserve_index=False)
