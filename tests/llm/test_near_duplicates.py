"""SuperMinHash groups against a brute-force join of all pairs."""

import random

import numpy as np
from helpers import docs_of, near_components, no_docs, shingles

from riskframe.llm import minhash
from riskframe.llm.common import WordHashes, mix
from riskframe.llm.graph import components
from riskframe.llm.queries import QUERIES


def groups(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in df.collect()}


def check(spark, rows):
    got = groups(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")))
    want = near_components(rows)
    sets = {i: shingles(t) for i, t in rows}
    assert got == {i: (len(sets[i]), want[i], want[i] == i) for i, _ in rows}


def test_signature_estimates_similarity():
    rng = np.random.default_rng(1)
    for n, shared in ((60, 30), (400, 360), (20_000, 10_000)):
        x = mix(rng.integers(0, 2**63, 2 * n - shared).astype(np.uint64))
        a, b = x[:n], x[n - shared :]
        same = (minhash.superminhash(a, 192) == minhash.superminhash(b, 192)).mean()
        assert abs(same - shared / (2 * n - shared)) < 0.12


def test_signature_is_that_of_the_plain_algorithm():
    """Element by element, with a whole permutation each."""
    x = mix(np.arange(1, 40, dtype=np.uint64))
    places = 16
    held = [2**64 - 1] * places
    for e in x.tolist():
        order = list(range(places))
        for j in range(places):
            d = int(mix(np.uint64([(e + (j + 1) * 0x9E3779B97F4A7C15) % 2**64]))[0])
            k = j + ((d & 0xFFFFFFFF) * (places - j) >> 32)
            order[j], order[k] = order[k], order[j]
            held[order[j]] = min(held[order[j]], (j << 32) | (d >> 32))
    assert minhash.superminhash(x, places).tolist() == held


def test_edited_copies(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for family in range(6):
        base = [rng.choice(words) for _ in range(rng.choice([6, 40, 200]))]
        for _ in range(14):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 18))):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((len(rows) * 3 + 1, " ".join(copy)))
    check(spark, rows)


def test_chain_through_members_that_do_not_link_with_the_centre(spark):
    words = [f"x{i}" for i in range(140)]
    rows = [(i, " ".join(words[3 * i : 3 * i + 100])) for i in range(12)]
    check(spark, rows)


def test_blanks_ties_and_short_texts(spark):
    rows = [(9, None), (8, ""), (7, " \n\t "), (6, "a b"), (5, "A  B"), (4, "a b c"), (3, "same words here for all of us"), (2, "SAME words\nhere for all of us")]
    check(spark, rows)


def test_repeated_rows_null_ids_and_clashing_columns(spark):
    df = spark.createDataFrame(
        [(1, "one two three four five six", 0, True), (1, "one two three four five six", 0, True), (None, "one two three four five six", 0, False)],
        "doc_id long, text string, component_id int, kept boolean",
    )
    got = sorted((r.doc_id or -1, r.component_id or -1) for r in minhash.near_duplicates(df).collect())
    assert got == [(-1, 1), (1, 1), (1, 1)] or got == [(-1, -1), (1, 1), (1, 1)]


def test_empty_table(spark):
    assert minhash.near_duplicates(no_docs(spark)).count() == 0


def test_long_text(spark):
    long = " ".join(f"t{i}" for i in range(60_000))
    got = groups(minhash.near_duplicates(docs_of(spark, [long, long + " end", "other words are in this text"])))
    assert got[0] == (59_996, 0, True) and got[1] == (59_997, 0, False) and got[2][1] == 2


def test_blocks_find_all_links():
    rng = random.Random(2)
    hashes = WordHashes()
    base = [f"w{i}" for i in range(60)]
    held = []
    for i in range(40):
        copy = list(base)
        copy[rng.randrange(60)] = "other"
        held.append((i, i % 2, minhash.shingle_set(" ".join(copy).encode(), hashes)))
    want = {
        (a[0], b[0])
        for a in held
        for b in held
        if a[0] < b[0] and 100 * len(np.intersect1d(a[2], b[2])) >= 85 * len(np.union1d(a[2], b[2]))
    }
    left, right = held[::2], held[1::2]
    got = {tuple(sorted(p)) for p in minhash.block_links(left, right, False, 85)}
    got |= set(minhash.block_links(left, left, True, 85)) | set(minhash.block_links(right, right, True, 85))
    assert got == want


def test_components_of_long_paths(spark):
    edges = [(i, i + 1) for i in range(100, 300)] + [(7, 7), (5, 900), (900, 5), (901, 900)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 301)}, 5: 5, 900: 5, 901: 5}


def test_query(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = near_components(rows)
    assert {r.doc_id: r.component_id for r in QUERIES["op10_superminhash"](spark, sf).collect()} == want


def test_blocks_and_components_do_not_share_a_task(spark, monkeypatch):
    """Two chained steps in Python would hold two workers for each task."""
    plans = []
    monkeypatch.setattr(minhash, "components", lambda edges: plans.append(edges._jdf.queryExecution().executedPlan().toString()) or components(edges))
    words = [f"x{i}" for i in range(140)]
    rows = [(i, " ".join(words[3 * i : 3 * i + 100])) for i in range(12)]
    check(spark, rows)
    assert len(plans) == 2 and not any("MapInArrow" in p for p in plans)
