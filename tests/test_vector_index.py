"""The stored vector index: recall against brute force, near copies, pruned folders."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskframe.operators import vector_index as vi
from riskframe.operators.dense import dense_search


def vectors(spark, matrix):
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(matrix)]
    return spark.createDataFrame(rows, "doc_id long, vec array<float>")


def pairs(df):
    return {(r.query_id, r.doc_id) for r in df.collect()}


def asked(corpus):
    return corpus.where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), "vec")


def recall(queries, corpus, index, k=20):
    want = pairs(dense_search(queries, corpus, k))
    return len(want & pairs(vi.vector_search(queries, index, k))) / len(want)


def test_recall_on_the_whole_table(spark, tmp_path):
    corpus = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vec"))
    vi.write_vector_index(corpus, f"{tmp_path}/i")
    index = vi.read_vector_index(spark, f"{tmp_path}/i")
    assert index.vectors.count() == corpus.count() and recall(asked(corpus), corpus, index) >= 0.9


@pytest.mark.parametrize("spread", [1e-3, 1e-5, 0.0])
def test_recall_inside_a_group_of_near_copies(spark, tmp_path, spread):
    rng = np.random.default_rng(1)
    centre = rng.normal(size=32)
    matrix = np.concatenate([rng.normal(size=(2000, 32)), centre + spread * rng.normal(size=(1000, 32))])
    corpus = vectors(spark, matrix)
    vi.write_vector_index(corpus, f"{tmp_path}/i", cells=24)
    index = vi.read_vector_index(spark, f"{tmp_path}/i")
    copies = corpus.where("doc_id >= 2000 AND doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), "vec")
    assert recall(copies, corpus, index) >= 0.9 and recall(asked(corpus), corpus, index) >= 0.9


def test_all_cells_probed_give_the_exact_hits(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(2)
    corpus = vectors(spark, rng.normal(size=(900, 16))).union(spark.createDataFrame([(9001, [0.0] * 16), (9002, None)], "doc_id long, vec array<float>"))
    monkeypatch.setattr(vi, "MAX_CELL_ROWS", 50)
    monkeypatch.setattr(vi, "MAX_BLOCK_VALUES", 64)
    vi.write_vector_index(corpus, f"{tmp_path}/i", cells=9)
    index = vi.read_vector_index(spark, f"{tmp_path}/i")
    got = vi.vector_search(asked(corpus), index, 7, probes=9).collect()
    want = dense_search(asked(corpus), corpus, 7).collect()
    key = lambda rows: sorted((r.query_id, r["rank"], r.doc_id, round(r.score, 6)) for r in rows)
    assert key(got) == key(want)


def test_only_folders_of_the_probed_cells_are_read(spark, tmp_path):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 16))
    corpus = vectors(spark, np.repeat(centres, 100, axis=0) + 0.1 * rng.normal(size=(2000, 16)))
    vi.write_vector_index(corpus, f"{tmp_path}/i", cells=20)
    index = vi.read_vector_index(spark, f"{tmp_path}/i")
    queries = corpus.where("doc_id < 3").select(F.col("doc_id").alias("query_id"), "vec")
    cells = [r.cell for r in vi.probed(queries, index).select("cell").distinct().collect()]
    some = vi.in_cells(index, cells)
    read = lambda df: df.select(F.input_file_name()).distinct().count()
    assert read(some) < 0.5 * read(index.vectors) and recall(queries, corpus, index, 10) >= 0.9
    assert "PartitionFilters: [cell" in some._jdf.queryExecution().executedPlan().toString()


def test_an_empty_table(spark, tmp_path):
    corpus = spark.createDataFrame([], "doc_id long, vec array<float>")
    queries = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, vec array<float>")
    vi.write_vector_index(corpus, f"{tmp_path}/i")
    assert vi.vector_search(queries, vi.read_vector_index(spark, f"{tmp_path}/i")).count() == 0
