"""The metric range join against all pairs."""

import numpy as np
from helpers import roots

from riskframe.llm import metric_join
from riskframe.llm.queries import QUERIES

FIELDS = "vec_id long, embedding array<float>"


def brute(rows, cosine=0.95):
    sound = {}
    for i, v in rows:
        if v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, np.float32).astype(np.float64)
            sound[i] = x / np.sqrt((x * x).sum())
    pairs = [
        (a, b) for a in sound for b in sound if a < b and len(sound[a]) == len(sound[b]) and sound[a] @ sound[b] >= cosine
    ]
    root = roots([i for i, _ in rows], pairs)
    links = {i: 0 for i, _ in rows}
    for a, b in pairs:
        links[a] += 1
        links[b] += 1
    return {i: (links[i], root[i], root[i] == i) for i, _ in rows}


def joined(df, **options):
    return {r.vec_id: (r.n_links, r.component_id, r.kept) for r in metric_join.range_join(df, **options).collect()}


def clusters(n, spread, seed=3, dim=12):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // 10, dim))
    return [(i, (centres[i % len(centres)] + spread * rng.normal(size=dim)).astype(np.float32).tolist()) for i in range(n)]


def test_clusters(spark):
    for spread in (0.05, 0.22, 0.3):
        rows = clusters(600, spread)
        assert joined(spark.createDataFrame(rows, FIELDS)) == brute(rows)


def test_many_cells_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(metric_join, "BLOCK", 16)
    monkeypatch.setattr(metric_join, "TILE", 8)
    rows = clusters(500, 0.25, dim=3)
    assert joined(spark.createDataFrame(rows, FIELDS)) == brute(rows)


def test_a_block_holds_its_own_vectors_only():
    rng = np.random.default_rng(5)
    unit = lambda x: x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    own = unit(np.repeat(rng.normal(size=(4, 8)), 5, axis=0) + 0.01 * rng.normal(size=(20, 8)))
    block = metric_join.Block(0.95)
    block.add(np.arange(20), np.ones(20, np.int64), own)
    block.close()
    out = []
    for k in range(50):  # comers between two of the clusters join them
        comers = unit(np.repeat(own[:1], 100, axis=0) + 0.01 * rng.normal(size=(100, 8)))
        out += block.meet(1000 + 100 * k + np.arange(100), np.ones(100, np.int64), comers)
    assert len(out) == 5000 and len(block.forest.parent) <= 20 and {r for _, _, r in out} == {0}
    assert all(n == 5 for _, n, _ in out)


def test_equal_vectors_count_each_other(spark):
    rows = [(i, [1.0, 2.0]) for i in range(5)] + [(10, [2.0, 4.0]), (11, [-1.0, 2.0])]
    got = joined(spark.createDataFrame(rows, FIELDS))
    assert got == {**{i: (5, 0, i == 0) for i in range(5)}, 10: (5, 0, False), 11: (0, 11, True)}


def test_unsound_vectors_and_dimensions(spark):
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0])]
    rows += [(7, [1.0, 0.0]), (8, [1.0, 0.0, 0.0]), (9, [1e-30, 0.0]), (12, [1e30, 0.0])]
    got = joined(spark.createDataFrame(rows, FIELDS))
    assert got == {**{i: (0, i, True) for i in (1, 2, 3, 4, 5, 6, 8)}, 7: (2, 7, True), 9: (2, 7, False), 12: (2, 7, False)}


def test_empty_null_id_and_clashing_columns(spark):
    assert metric_join.range_join(spark.createDataFrame([], FIELDS)).count() == 0
    df = spark.createDataFrame([(None, [1.0, 0.0], 3), (4, [1.0, 0.0], 3)], f"{FIELDS}, n_links int")
    assert joined(df) == {None: (0, None, True), 4: (0, 4, True)}


def test_query(spark, sf):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in QUERIES["op3_metric_range_join"](spark, sf).collect()}
    assert got == brute(rows)
