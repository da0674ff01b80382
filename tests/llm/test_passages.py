"""Repeated lines, paragraphs and passages: what is cut, what stays, and offsets."""

import random
import re

import numpy as np
import pytest
from helpers import docs_of, low, no_docs
from pyspark.sql import functions as F

from riskframe.llm import passages as P
from riskframe.llm.queries import QUERIES

rng = random.Random(4)


def prose(n, tag):
    return " ".join(f"{rng.choice('abcdefgh')}{tag}{rng.randint(0, 10**6)}" + ("." if rng.random() < 0.1 else "") for _ in range(n))


def rows_of(spark, texts, **options):
    return {r.doc_id: r for r in P.without_repeats(docs_of(spark, texts), **options).collect()}


def rebuilt(text, row):
    return "".join(text[a:b] for a, b in row.kept)


def words(text):
    """(word, start, end) between ASCII blanks."""
    return [(low(m.group()), *m.span()) for m in re.finditer(r"[^\t-\r ]+", text)]


@pytest.mark.parametrize("many", [1_000_000, 0])
def test_passages_in_the_middle_of_lines_go_with_their_edges(spark, monkeypatch, many):
    monkeypatch.setattr(P, "MANY", many)
    texts, planted = [], []
    for i in range(300):
        passage = prose(rng.randrange(31, 80), f"p{i}x")
        for copy in range(2):
            head, tail = prose(rng.randrange(1, 40), f"h{i}y{copy}y"), prose(rng.randrange(1, 40), f"t{i}z{copy}z")
            texts.append(f"{head} {passage} {tail}")
            planted.append((len(head) + 1, len(head) + 1 + len(passage)))
    rows = rows_of(spark, texts)
    for i, r in rows.items():
        assert r.text == rebuilt(texts[i], r)
        if i % 2 == 0:
            assert r.text == texts[i] and r.removed == []
        else:
            assert [tuple(x) for x in r.removed] == [planted[i]]


@pytest.mark.parametrize("least", [10, 12, P.MIN_LINE])
def test_lines_and_paragraphs_of_the_least_size_go_and_shorter_ones_stay(spark, least):
    line, short = prose(least, "l"), prose(least - 1, "short")
    stanza = "\n".join(prose(least // 2, f"s{k}") for k in range(2))
    texts = [f"{prose(30, i)}\n{line}\n{prose(6, 50 + i)}\n{short}\n{prose(6, 80 + i)}\n\n{stanza}\n\n{prose(25, 100 + i)}" for i in range(6)]
    rows = rows_of(spark, texts, min_line=least)
    assert rows[0].text == texts[0]
    for i in range(1, 6):
        gone = [texts[i][a:b] for a, b in rows[i].removed]
        assert gone == [line, stanza] and short in rows[i].text


def test_windows_are_chosen_in_every_stretch_and_alike_everywhere():
    words = [f"w{rng.randrange(10**6)}" for _ in range(600)]
    of = lambda text: P.units(P.words_of(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())])))
    digest, _, place = of(" ".join(words))
    windows = np.sort(place[place < P.LINE])
    assert windows[0] < P.SPREAD and windows[-1] > 600 - P.WINDOW - P.SPREAD and np.diff(windows).max() <= P.SPREAD
    assert len(windows) < 0.2 * 600
    inner = set(of(" ".join(words[100:400]))[0].tolist())
    again = set(of("\n".join(["x y z", *(" ".join(words[a : a + 50]) for a in range(100, 400, 50))]))[0].tolist())
    assert len(inner & again) >= 0.9 * sum(100 <= w <= 400 - P.WINDOW for w in windows)
    for n in (0, 1, 15, 16, 17, 31, 32):
        digest, _, place = of(" ".join(words[:n]))
        assert ((place < P.LINE).sum() > 0) == (n >= P.WINDOW)


def test_exact_copies_and_a_passage_repeated_inside_a_text(spark):
    passage = prose(60, "in")
    texts = ["é " + prose(50, "copy")] * 5 + [f"ü {passage}\n{prose(20, 'x')}\n{passage} end"]
    rows = rows_of(spark, texts)
    assert rows[0].text == texts[0] and all(rows[i].text.strip() == "" for i in range(1, 5))
    (a, b), = rows[5].removed
    assert a > len(passage) and texts[5][a:b] == passage and rows[5].text == rebuilt(texts[5], rows[5])


def test_case_and_spacing_do_not_matter(spark):
    passage = prose(60, "c")
    rows = rows_of(spark, [passage, passage.upper().replace(" ", "  ")])
    assert rows[0].removed == [] and rows[1].text.strip() == ""


def test_a_passage_in_thousands_of_documents(spark):
    passage = prose(40, "hot")
    texts = [f"{prose(5, i)} {passage} {prose(5, i)}" for i in range(2000)]
    rows = rows_of(spark, texts)
    assert sum(len(r.removed) for r in rows.values()) == 1999 and all(texts[i][r.removed[0][0] : r.removed[0][1]] == passage for i, r in rows.items() if i)


def test_empty_clashing_null_ids_and_long(spark):
    assert P.without_repeats(no_docs(spark)).count() == 0
    long = prose(120_000, "l")
    twice = prose(50, "t")
    df = docs_of(spark, [long, long]).withColumn("kept", F.lit(1)).withColumn("at", F.lit(3)).withColumn("digest", F.lit("d"))
    df = df.union(docs_of(spark, [f"{twice} x {twice}", None, ""]).selectExpr("NULL", "text", "lang", "source", "n_chars", "2", "3", "'d'"))
    rows = sorted(P.without_repeats(df).collect(), key=lambda r: (r.doc_id is None, r.doc_id, r.text is None, -len(r.text or "")))
    assert rows[0].text == long and rows[1].text.strip() == "" and rows[0].kept == 1 and rows[1].kept_ is not None
    assert len(rows) == 5 and 0.4 * len(twice) < len(rows[2].text) < 1.7 * len(twice) and rows[3].text == "" and rows[4].text is None
    ids = docs_of(spark, [twice, f"{twice} {prose(30, 'z')}"]).withColumn("doc_id", F.lit(5).cast("long"))
    assert all(r.removed == [] for r in P.without_repeats(ids).collect())


def test_query_against_all_grams_of_all_texts(spark, sf):
    """What must go: the middle of 31 words that an earlier text has. What may go: 16 such words, or such a line or paragraph."""
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    long, short, blocks = {}, {}, {}
    split = {i: words(t) for i, t in texts.items()}

    def stretches(i):
        w, n = [x for x, _, _ in split[i]], 0
        for paragraph in re.split(r"\n[\t-\r ]*\n", texts[i]):
            start = n
            for line in paragraph.split("\n"):
                k = len(words(line))
                yield n, n + k
                n += k
            yield start, n
        assert n == len(w)

    for i in sorted(texts):
        w = [x for x, _, _ in split[i]]
        for table, k in ((long, 31), (short, 16)):
            for a in range(len(w) - k + 1):
                table.setdefault(tuple(w[a : a + k]), (i, a))
        for a, b in stretches(i):
            if b - a >= P.MIN_LINE:
                blocks.setdefault(tuple(w[a:b]), (i, a))
    rows = {r.doc_id: r for r in QUERIES["op9_repeated_passages"](spark, sf).collect()}
    assert set(rows) == set(texts) and sum(bool(r.removed) for r in rows.values()) > 3
    for i, r in rows.items():
        assert r.text == rebuilt(texts[i], r)
        w = [x for x, _, _ in split[i]]
        gone = np.zeros(len(w), bool)
        for a, b in r.removed:
            gone |= np.array([a <= s < b for _, s, _ in split[i]], bool)
        may = np.zeros(len(w), bool)
        for a in range(len(w) - 30):
            if long[tuple(w[a : a + 31])][0] < i:
                assert gone[a + 15]
        for a in range(len(w) - 15):
            if short[tuple(w[a : a + 16])] < (i, a):
                may[a : a + 16] = True
        for a, b in stretches(i):
            if b - a >= P.MIN_LINE and blocks[tuple(w[a:b])] < (i, a):
                may[a:b] = True
        assert not (gone & ~may).any()
