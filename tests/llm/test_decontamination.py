"""Benchmark windows in documents, against a scan of all windows."""

import hashlib
import re

import pytest
from helpers import docs_of, low, no_docs
from pyspark.sql import functions as F

from riskframe.llm import decontaminate
from riskframe.llm.queries import QUERIES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(texts: dict, items: list, width=10):
    grams = {}
    for i, t in items:
        w = WORD.findall(low(t or ""))
        n = min(width, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            grams.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    out = {}
    for d, t in texts.items():
        w = WORD.findall(low(t or ""))
        hit, found = set(), set()
        for n in {len(g) for g in grams}:
            for k in range(len(w) - n + 1):
                g = tuple(w[k : k + n])
                if g in grams:
                    hit.update(range(k, k + n))
                    found |= grams[g]
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out[d] = (len(w), len(hit), len(found), sha, bool(hit))
    return out


def reported(df):
    return {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in df.collect()}


PASSAGE = "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu"
ITEMS = [(1, PASSAGE), (2, "Short ITEM é"), (3, None), (4, ""), (5, PASSAGE + " xi"), (12, "!!! ..."), (1, "seven and eight")]
TEXTS = [
    f"before {PASSAGE.lower()}, after it all",
    "x " + PASSAGE.replace(" ", "--\n") + " y " + PASSAGE,
    "alpha beta gamma delta epsilon zeta eta theta iota no",
    "a short, item É and short item é!",
    None,
    "",
    "short item é" * 3,
    "Seven and eight and seven-and-eight",
    "kappa " * 50,
]


@pytest.mark.parametrize("slice_size", [500_000, 3])
def test_hits_items_and_slices(spark, slice_size):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = reported(decontaminate.report(docs_of(spark, TEXTS), bench, slice_size=slice_size))
    assert got == brute(dict(enumerate(TEXTS)), ITEMS)
    assert got[0][4] and not got[2][4] and got[3][1] == 3


def test_spans_are_cut_and_documents_dropped(spark):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = docs_of(spark, TEXTS)
    kept = decontaminate.clean(docs, bench)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {2, 4, 5, 6, 8}
    cut = {r.doc_id: r.text for r in decontaminate.clean(docs, bench, drop_share=1.0).collect()}
    assert cut[0] == "before  , after it all" and len(cut) == len(TEXTS)
    assert cut[1] == "x   y  " and cut[4] is None and cut[2] == TEXTS[2]


def test_empty_tables_and_clashing_columns(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    docs = docs_of(spark, TEXTS[:3]).withColumn("decontamination", F.lit(1)).withColumn("n_hit", F.lit(5))
    rows = decontaminate.report(docs, bench).collect()
    assert all(r.n_hit == 5 and r.n_hit_ == 0 and not r.contaminated for r in rows) and len(rows) == 3
    full = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontaminate.report(no_docs(spark), full).count() == 0


def test_long_text_and_repeated_rows(spark):
    long = "word " * 300_000 + PASSAGE
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    rows = decontaminate.report(docs_of(spark, [long, long]), bench).collect()
    assert [(r.n_words, r.n_hit) for r in rows] == [(300_013, 13)] * 2


def test_query(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert reported(QUERIES["op4_decontamination"](spark, sf)) == brute(texts, items)
