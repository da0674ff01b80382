"""Importance resampling against a plain version; checksums against zlib."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from helpers import docs_of, low, no_docs
from pyspark.sql import functions as F

from riskframe.llm import flat, importance
from riskframe.llm.queries import QUERIES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain(docs, target, grams=1, buckets=10_000, percent=10, least=20):
    """{id: (n_features, weight, score, rank)}; ids differ."""

    def found(text):
        w = WORD.findall(low(text or ""))
        grown = [" ".join(w[k : k + n]) for n in range(1, grams + 1) for k in range(len(w) - n + 1)]
        return len(w), [zlib.crc32(g.encode()) % buckets for g in grown]

    own = {i: found(t) for i, t in docs}
    s, t = Counter(b for _, f in own.values() for b in f), Counter(b for x in target for b in found(x)[1])
    n_s, n_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (n_s + buckets) / ((s[b] + 1) * (n_t + buckets)))) for b in range(buckets)}
    rows = {}
    for i, (_, f) in own.items():
        h = int(hashlib.sha256(f"2024:{i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        rows[i] = [len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None]
    able = sorted((i for i in rows if own[i][0] >= least), key=lambda i: (-rows[i][2], i))
    for place, i in enumerate(able[: len(able) * percent // 100]):
        rows[i][3] = place + 1
    return {i: tuple(r) for i, r in rows.items()}


def got(df):
    return {r.doc_id: (r.n_features, r.weight, r.score, r["rank"]) for r in df.collect()}


def test_checksums_are_those_of_zlib():
    rng = np.random.default_rng(1)
    words = [rng.integers(0, 256, n, dtype=np.uint8).tobytes() for n in rng.choice([0, 1, 2, 3, 7, 40, 256, 257, 3000], 2000)]
    assert importance.checksums(pa.array(words, pa.large_binary())).tolist() == [zlib.crc32(w) for w in words]


@pytest.mark.parametrize("grams", [1, 2, 3])
def test_runs_of_words_of_either_kind(grams):
    texts = ["Ab c,é x 12-3", "", "...", "a b" * 3, None, "日本 x", "one"]
    buckets, rows = importance.features(*flat.flat(pa.array(texts)), grams, 100)
    want = []
    for i, t in enumerate(texts):
        w = WORD.findall(low(t or ""))
        want += [(i, zlib.crc32(" ".join(w[k : k + n]).encode()) % 100) for n in range(1, grams + 1) for k in range(len(w) - n + 1)]
    assert sorted(zip(rows.tolist(), buckets.tolist())) == sorted(want)


def test_query_is_that_of_the_plain_version(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert got(QUERIES["op11_importance_resampling"](spark, sf)) == plain(docs, target)


@pytest.mark.parametrize("grams", [1, 2])
def test_a_hot_text_nulls_and_a_very_long_text(spark, grams):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(500)]
    long = " ".join(rng.choice(words, 400_000))
    texts = ["same words " * 12] * 120 + [None, "", "  ", "Ünï çode " * 11, long, long + " " + "x" * 3_000_000] + [" ".join(rng.choice(words, 25)) for _ in range(150)]
    target = [" ".join(rng.choice(words[:50], 30)) for _ in range(20)] + [None, ""]
    df = docs_of(spark, texts)
    aimed = spark.createDataFrame([(t,) for t in target], "text string")
    want = plain(list(enumerate(texts)), target, grams)
    assert got(importance.resample(df, aimed, grams=grams)) == want
    assert sum(r[3] is not None for r in want.values()) == 27


def test_ties_repeated_rows_empty_tables_and_clashes(spark):
    texts = ["the same twenty words " * 5] * 60
    df = docs_of(spark, texts).withColumn("doc_id", F.lit(None).cast("long"))
    for name in ("rank", "weight", "score", "n_features", "may", "at", "part", "before"):
        df = df.withColumn(name, F.lit("x"))
    empty = no_docs(spark)
    rows = importance.resample(df, empty).collect()
    assert sorted(r["rank"] for r in rows if r["rank"]) == [1, 2, 3, 4, 5, 6] and len({r.score for r in rows}) == 1 and len(rows) == 60
    assert importance.resample(empty, df).count() == 0
    assert importance.resample(empty, empty).columns == ["doc_id", "n_features", "weight", "score", "rank"]
