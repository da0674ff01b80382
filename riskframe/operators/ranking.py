"""Fusing, reranking and rendering hit lists (RET9-RET15, RET18, RET19).

Hit lists carry ids, ranks and scores only; texts and metadata are joined to
the few rows that survive.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskframe.functions.topk import SCORE_DIGITS
from riskframe.functions.vectors import cosine, hashed_vector

# Fusion constant, hits kept after reranking, relevance threshold.
RRF_K, RERANK_TOP_K, RELEVANCE_THRESHOLD = 60, 5, 0.6
# Specialists, in fan-out order.
SPECIALISTS = ("supplier_risk", "shipment_analysis", "inventory_intelligence")
ANSWER_DOCS = 5


def rrf(rankings: Sequence[DataFrame], k: int = RRF_K) -> DataFrame:
    """RET9: reciprocal rank fusion of hit lists, given in order of precedence.

    Score is the sum of 1 / (k + rank). Base score and source come from the
    first list that has the document; equal fused scores keep the order in
    which documents were first seen.
    """
    tagged = [
        r.select("query_id", "doc_id", "rank", "score", F.lit(i).alias("list")) for i, r in enumerate(rankings)
    ]
    union = tagged[0]
    for other in tagged[1:]:
        union = union.unionByName(other)
    fused = union.groupBy("query_id", "doc_id").agg(
        F.round(F.sum(1.0 / (k + F.col("rank"))), 12).alias("rrf_score"),
        F.min(F.struct("list", F.col("rank").alias("list_rank"), "score")).alias("first"),
    )
    w = Window.partitionBy("query_id").orderBy(F.desc("rrf_score"), "list", "list_rank")
    return (
        fused.select("query_id", "doc_id", "rrf_score", "first.list", "first.list_rank", "first.score")
        .withColumn("rank", F.row_number().over(w))
        .drop("list_rank")
    )


def rerank(
    candidates: DataFrame,
    query_vecs: DataFrame,
    doc_vecs: DataFrame | None = None,
    texts: DataFrame | None = None,
    k: int = RERANK_TOP_K,
    dim: int = 64,
    known: Column | None = None,
) -> DataFrame:
    """RET10: top ``k`` candidates by cosine with the query vector; keeps the base score.

    Stored vectors come from ``doc_vecs`` (doc_id, vec). Where a candidate has
    none, the hashed vector of its text (``texts``: doc_id, text) stands in,
    computed once per document; for that the candidates are read twice. Where
    ``known`` holds, the base score already is the cosine and is taken over.
    Equal scores keep the candidates' order.
    """
    df = candidates.join(query_vecs.select("query_id", F.col("vec").alias("_qv")), "query_id")
    vec: Column = F.lit(None).cast("array<double>")
    if doc_vecs is not None:
        df = df.join(doc_vecs.select("doc_id", F.col("vec").cast("array<double>").alias("_dv")), "doc_id", "left")
        vec = F.col("_dv")
    if texts is not None:
        needed = texts.join(candidates.select("doc_id").distinct(), "doc_id", "left_semi")
        df = df.join(needed.select("doc_id", hashed_vector("text", dim).alias("_hv")), "doc_id", "left")
        vec = F.coalesce(vec, F.col("_hv"))
    score = F.round(cosine("_qv", vec), SCORE_DIGITS)
    if known is not None:
        score = F.when(known, F.col("score")).otherwise(score)
    df = df.withColumn("rerank_score", F.coalesce(score, F.lit(0.0)))
    w = Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), "rank")
    return (
        df.drop("_qv", "_dv", "_hv")
        .withColumn("_new", F.row_number().over(w))
        .filter(F.col("_new") <= k)
        .withColumn("rank", F.col("_new"))
        .drop("_new")
    )


def max_scores(hits: DataFrame, queries: DataFrame, score: str = "rerank_score") -> DataFrame:
    """RET11: best score per query; 0 for a query without hits."""
    best = hits.groupBy("query_id").agg(F.max(score).alias("max_score"))
    return queries.select("query_id").join(best, "query_id", "left").fillna(0.0, ["max_score"])


def retry_gate(maxima: DataFrame, threshold: float = RELEVANCE_THRESHOLD) -> DataFrame:
    """RET12: the queries whose best score is below the threshold."""
    return maxima.filter(F.col("max_score") < threshold)


def best_of_two(
    first: DataFrame, second: DataFrame, queries: DataFrame, score: str = "rerank_score"
) -> DataFrame:
    """RET13: per query the hits of the attempt with the better best score.

    ``queries`` has (query_id, text, rewritten). The second attempt wins only
    if strictly better and if the rewritten text is not empty and differs
    otherwise than in case. Adds ``max_score`` and ``reformulated_from``.
    """
    m1 = max_scores(first, queries, score).withColumnRenamed("max_score", "m1")
    m2 = max_scores(second, queries, score).withColumnRenamed("max_score", "m2")
    usable = F.col("rewritten").isNotNull() & (F.col("rewritten") != "")
    changed = usable & (F.lower("rewritten") != F.lower("text"))
    choice = (
        queries.join(m1, "query_id")
        .join(m2, "query_id")
        .select("query_id", "text", "m1", "m2", (F.coalesce(changed, F.lit(False)) & (F.col("m2") > F.col("m1"))).alias("swap"))
    )
    columns = first.columns

    def chosen(hits: DataFrame, swap: bool) -> DataFrame:
        picked = choice.filter(F.col("swap") == swap)
        return hits.join(picked, "query_id").select(
            *columns,
            F.when(F.col("swap"), F.col("m2")).otherwise(F.col("m1")).alias("max_score"),
            F.when(F.col("swap"), F.col("text")).alias("reformulated_from"),
        )

    return chosen(first, False).unionByName(chosen(second.select(*columns), True))


def response_docs(hits: DataFrame, k: int = ANSWER_DOCS, order: str = "rank") -> DataFrame:
    """RET14: first occurrence of each document per query, in order, at most ``k``.

    Score is the rerank score where there is one, else the base score, else 0.
    """
    scores = [F.col(c) for c in ("rerank_score", "score") if c in hits.columns]
    firsts = hits.groupBy("query_id", "doc_id").agg(
        F.min(F.struct(F.col(order).alias("o"), F.coalesce(*scores, F.lit(0.0)).alias("score"))).alias("f")
    )
    w = Window.partitionBy("query_id").orderBy("f.o", "doc_id")
    return (
        firsts.withColumn("position", F.row_number().over(w))
        .filter(F.col("position") <= k)
        .select("query_id", "doc_id", "position", "f.score")
    )


def format_context(hits: DataFrame, k: int = ANSWER_DOCS) -> DataFrame:
    """RET15: one prompt block per query from its first ``k`` hits.

    ``hits`` has (query_id, rank, doc_id, text) and, where known, severity and
    source; at most ``k`` rows per query are gathered.
    """

    def shown(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit("?")) if name in hits.columns else F.lit("?")

    w = Window.partitionBy("query_id").orderBy("rank")
    block = F.concat(
        F.lit("[Doc "), F.col("_pos").cast("string"),
        F.lit(" | id="), F.col("doc_id").cast("string"),
        F.lit(" | severity="), shown("severity"),
        F.lit(" | source="), shown("source"),
        F.lit("]\n"), F.coalesce(F.col("text"), F.lit("")),
    )
    return (
        hits.withColumn("_pos", F.row_number().over(w))
        .filter(F.col("_pos") <= k)
        .groupBy("query_id")
        .agg(F.array_sort(F.collect_list(F.struct("_pos", block.alias("_block")))).alias("_blocks"))
        .select("query_id", F.array_join(F.col("_blocks._block"), "\n\n").alias("context"))
    )


def cache_retain(entries: DataFrame, max_items: int = 500) -> DataFrame:
    """RET18: the cache after all stores and hits: newest ``max_items`` by last use.

    ``entries`` has (query, payload, store_ts, hit_ts). One row per query text:
    the payload stored last, at the position of its first store or last hit,
    whichever is later (storing again does not move an entry).
    """
    return (
        entries.groupBy("query")
        .agg(
            F.max_by("payload", "store_ts").alias("payload"),
            F.greatest(F.min("store_ts"), F.max("hit_ts")).alias("position"),
        )
        .orderBy(F.desc("position"), "query")
        .limit(max_items)
    )


def cache_folds() -> list[Column]:
    """Aggregates over some of a query's stores and hits that merge to those of all (RET18)."""
    stored = F.when(F.col("store_ts").isNotNull(), F.struct("store_ts", "payload"))
    return [F.max(stored).alias("stored"), F.min("store_ts").alias("first_store"), F.max("hit_ts").alias("last_hit")]


def cache_of_folds(parts: DataFrame, max_items: int = 500) -> DataFrame:
    """RET18 (`cache_retain`) from the folds of its entries' parts."""
    position = F.greatest(F.min("first_store"), F.max("last_hit"))
    return (
        parts.groupBy("query")
        .agg(F.max("stored").alias("stored"), position.alias("position"))
        .select("query", F.col("stored.payload").alias("payload"), "position")
        .orderBy(F.desc("position"), "query")
        .limit(max_items)
    )


def route_specialists(df: DataFrame, intent: str = "intent") -> DataFrame:
    """RET19: one row per specialist to run; general, unknown and missing intents go to all."""
    return df.withColumn("specialist", F.explode(routed(F.col(intent))))


def routed(intent: Column) -> Column:
    name = F.lower(intent)
    everyone = F.array(*[F.lit(s) for s in SPECIALISTS])
    return F.when(name.isin(*SPECIALISTS), F.array(name)).otherwise(everyone)
