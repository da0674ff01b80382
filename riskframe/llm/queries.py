"""The operators' registered queries: each over its whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.llm import (
    decontaminate,
    importance,
    licenses,
    metric_join,
    minhash,
    packing,
    passages,
    quality,
    ring,
    sentence_pieces,
    surrogates,
    token_pairs,
    token_tree,
)
from riskframe.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SHARDS = 8


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their personal data replaced."""
    return surrogates.pseudonymised(table(spark, sf_dir, "documents"))


@query
def op2_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 8 shards by a ring keyed by the text, row counts at most one apart."""
    placed = ring.shard_rows(ring.sized(table(spark, sf_dir, "documents")), SHARDS, key="digest")
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


@query
def op3_metric_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors linked at a cosine of 0.95 or more."""
    return metric_join.range_join(table(spark, sf_dir, "embeddings"))


@query
def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all windows of 10 words of the benchmark."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.report(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@query
def op5_edited_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents before and after three edits each."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    trees, tree = token_tree.built(docs.withColumn("edits", token_tree.revisions(F.col("text"), F.col("source"))))
    done, names = token_tree.edited(trees, tree, "edits")
    return done.select("doc_id", F.size("edits").alias("n_edits"), F.length("text").alias("chars_after"), *names)


@query
def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' tokens in sequences of at most 2048."""
    return packing.pack(packing.pieces(table(spark, sf_dir, "documents")))


def site(docs: DataFrame) -> dict:
    """Documents name their source as host; a source's pages of one language are a path."""
    return {"host": F.col("source"), "path": F.concat_ws("/", "source", "lang")}


@query
def op7_hierarchical_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents: text evidence combined with the record of source and language."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    found = quality.judged(docs, table(spark, sf_dir, "labels"), **site(docs))
    return found.drop("text", "source", "lang")


@query
def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of all documents; a document is the file source/lang/doc_id.txt."""
    path = F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return licenses.scan(table(spark, sf_dir, "documents"), path)


@query
def op9_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without passages that an earlier one has, with the offsets of what stays and goes."""
    return passages.without_repeats(table(spark, sf_dir, "documents"))


@query
def op10_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents, 5-word shingles, similarity 0.85 or more."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents weighed towards the benchmark's words, a tenth of them drawn."""
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links between the byte-level and the SentencePiece tokens of all documents."""
    return token_pairs.alignment(table(spark, sf_dir, "documents"))


@query
def op13_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SentencePiece ids of all documents, and what they decode to."""
    return sentence_pieces.digests(table(spark, sf_dir, "documents"))
