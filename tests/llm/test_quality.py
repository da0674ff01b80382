"""Held-out accuracy, shrinkage, and degenerate tables."""

import math

import numpy as np
import pytest
from helpers import docs_of, no_docs
from pyspark.sql import functions as F

from riskframe.llm import quality as Q
from riskframe.llm.queries import QUERIES, site

LABELS = "doc_id long, quality int, toxic int"


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0
    found = Q.judged(docs, labels.where(~fold), **site(docs))
    rows = found.join(labels.where(fold).select("doc_id", "quality"), "doc_id").select("keep", "quality").collect()
    good = [r.keep for r in rows if r.quality == 1]
    bad = [r.keep for r in rows if r.quality == 0]
    assert len(rows) > 600 and np.mean(good) > 0.99 and np.mean(bad) < 0.1


def test_fit_rows_separates_and_survives_one_class():
    rng = np.random.default_rng(0)
    x = np.abs(rng.normal(size=(400, Q.FEATURES)))
    x[:, 0] = 1
    y = (x[:, 3] > 0.7).astype(float)
    model = Q.fit_rows(x, y)
    assert ((model.evidence(x) + np.log(model.rate / (1 - model.rate)) > 0) == (y > 0)).mean() > 0.9
    for y in (np.ones(400), np.zeros(400), np.zeros(0)):
        model = Q.fit_rows(x[: len(y)], y)
        assert abs(model.evidence(x)).max() < 1e-6


def test_sites_shrink_toward_the_rate_above(spark):
    rows = [("a", "a/1", 0.9)] * 400 + [("b", "b/1", 0.1)] * 400 + [("c", "c/1", 0.1)] + [("a", "a/2", 0.1)]
    record, prior = Q.sites(spark.createDataFrame(rows, "host string, path string, p double"))
    assert record.count() == 4 and 0.45 < prior.rate < 0.55
    assert prior.host < 10
    _, flat = Q.sites(spark.createDataFrame([(h, h, 0.5) for h in "abcdef" for _ in range(50)], "host string, path string, p double"))
    assert flat.host > 100


def test_site_record_moves_undecided_documents(spark):
    good, bad = "plain words that read well and say things. " * 6, "%%% $$$ ### &&& *** " * 12
    texts = [good] * 60 + [bad] * 60 + [None, None, ""]
    docs = docs_of(spark, texts).withColumn("source", F.when(F.col("doc_id") < 60, "fine.example").when(F.col("doc_id") < 120, "junk.example").when(F.col("doc_id") == 120, "fine.example").otherwise("junk.example"))
    labels = spark.createDataFrame([(i, int(i < 60), 0) for i in range(0, 120, 2)] + [(3, None, 0), (None, 1, 0)], LABELS)
    rows = {r.doc_id: r for r in Q.judged(docs, labels, **site(docs)).collect()}
    assert all(rows[i].keep for i in range(60)) and not any(rows[i].keep for i in range(60, 120))
    assert rows[120].keep and not rows[121].keep and not rows[122].keep
    assert rows[0].host_rate > 0.8 > 0.2 > rows[60].host_rate


@pytest.mark.parametrize("labelled", [[], [(0, 1, 0)]])
def test_few_or_no_labels_clashes_and_repeats(spark, labelled):
    docs = docs_of(spark, ["some text here", "some text here", "x" * 300_000]).withColumn("keep", F.lit(3)).withColumn("host", F.lit("h"))
    rows = Q.judged(docs, spark.createDataFrame(labelled, LABELS), **site(docs)).collect()
    assert len(rows) == 3 and all(r.keep == 3 and r.host == "h" and r.keep_ and 0 < r.p_quality < 1 for r in rows)


def test_empty_and_null_sites(spark):
    labels = spark.createDataFrame([(0, 1, 0)], LABELS)
    assert Q.judged(no_docs(spark), labels, **site(no_docs(spark))).count() == 0
    docs = docs_of(spark, ["a text", "b text"]).withColumn("source", F.lit(None).cast("string")).withColumn("lang", F.lit(None).cast("string"))
    assert {(r.host, r.path) for r in Q.judged(docs, labels, **site(docs)).collect()} == {("", "")}


def test_query(spark, sf):
    rows = QUERIES["op7_hierarchical_quality"](spark, sf).collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert np.mean([r.keep == bool(labels[r.doc_id]) for r in rows if r.doc_id in labels]) > 0.95


def plain(rows, model):
    """{id: (p_doc, host_rate, path_rate, p_quality)} of (id, text, host, path) in plain loops."""
    clip = lambda x: min(max(x, 1e-6), 1 - 1e-6)
    logit = lambda p: math.log(p / (1 - p))
    chance = lambda o: 1 / (1 + math.exp(-o))
    z = {}
    for i, text, _, _ in rows:
        x = Q.features(text.encode())
        total = sum((a - m) / s * w for a, m, s, w in zip(x, model.mean, model.scale, model.weights))
        z[i] = min(max(total - logit(clip(model.rate)), -12), 12) if text.split() else 0.0
    p = {i: chance(z[i] + logit(clip(model.rate))) for i in z}
    hosts, paths = {}, {}
    for i, _, host, path in rows:
        for table, key in ((hosts, host), (paths, (host, path))):
            n, s, w = table.get(key, (0, 0.0, 0.0))
            table[key] = (n + 1, s + p[i], w + p[i] * (1 - p[i]))
    rate = clip(sum(s for _, s, _ in hosts.values()) / len(rows))

    def strength(groups):
        spread = sum(n * ((s / n - mean) ** 2 - w / n**2) for (n, s, w), mean in groups) / len(rows)
        return min(max(rate * (1 - rate) / max(spread, 1e-6) - 1, 1.0), 1e4) if len(groups) > 1 else 1.0

    of_host = strength([(g, rate) for g in hosts.values()])
    of_path = strength([(g, hosts[h][1] / hosts[h][0]) for (h, _), g in paths.items()])
    out = {}
    for i, _, host, path in rows:
        (hn, hs, _), (n, s, _) = hosts[host], paths[host, path]
        site = lambda less, one: (of_path * (of_host * rate + hs - less) / (of_host + hn - one) + s - less) / (of_path + n - one)
        own = site(p[i], 1)
        odds = math.log(max(own, 1e-6) / max(1 - own, 1e-6))
        out[i] = (p[i], (of_host * rate + hs) / (of_host + hn), site(0.0, 0), chance(z[i] + odds))
    return out


def test_query_against_plain_loops(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = [(r.doc_id, r.text, r.source, f"{r.source}/{r.lang}") for r in docs.collect()]
    want = plain(rows, Q.fit(docs, labels))
    got = {r.doc_id: r for r in QUERIES["op7_hierarchical_quality"](spark, sf).collect()}
    assert set(got) == set(want)
    for i, values in want.items():
        r = got[i]
        assert np.allclose((r.p_doc, r.host_rate, r.path_rate, r.p_quality), values, rtol=1e-6, atol=1e-9) and r.keep == (r.p_quality >= 0.5)


def test_a_very_long_text(spark):
    docs = docs_of(spark, ["plain words that read well. " * 200_000, "%%% $$$ " * 300_000, "short text"])
    rows = Q.judged(docs, spark.createDataFrame([(0, 1, 0), (1, 0, 0)], LABELS), **site(docs)).collect()
    assert len(rows) == 3 and all(0 < r.p_quality < 1 for r in rows)
