"""Licence lines, scores and inheritance."""

import math
import random
import re
from collections import Counter

import pytest
from helpers import docs_of, no_docs
from pyspark.sql import functions as F

from riskframe.llm import licenses as L
from riskframe.llm.queries import QUERIES

APACHE, MIT = "Licensed under the Apache License, Version 2.0.", "Released under the MIT License."


def words(text):
    return [t for t in re.split(r"[\W_]+", text.lower()) if t]


EVERY = [(name, text) for name, texts in L.TEMPLATES.items() for text in texts]


class Definition:
    """Licence lines in a corpus of ``texts``, by the definition."""

    def __init__(self, texts=()):
        self.df = Counter(t for _, text in EVERY for t in set(words(text)))
        held = Counter(t for x in texts for t in set(words(x)))
        self.share = {t: held[t] / (len(texts) + 1) for t in self.df}
        self.templates = [(name, self.vector(text)) for name, text in EVERY]

    def vector(self, text):
        idf = lambda t: math.log(1 + len(EVERY) / self.df[t]) * (1 - self.share[t]) if t in self.df else math.log(1 + len(EVERY))
        return {t: n * idf(t) for t, n in Counter(words(text)).items()}

    def best(self, line):
        x = self.vector(line)
        found = []
        for name, y in self.templates:
            square = sum(v * v for v in y.values())
            score = round(sum(v * y.get(t, 0) for t, v in x.items()) / (math.sqrt(sum(v * v for v in x.values()) * square) or 1), 6)
            if score >= L.COSINE and round(sum(v * v for t, v in y.items() if t in x) / square, 6) >= L.COVER:
                found.append((-score, name))
        return min(found, default=None)


def scanned(df):
    return {r.doc_id: r for r in L.scan(df, F.col("file")).collect()}


@pytest.fixture(scope="module")
def tree(spark):
    files = [
        ("LICENSE", APACHE),
        ("src/a.py", "code without any notice"),
        ("src/lib/LICENSE.txt", MIT + "\n" + "more text of the licence " * 20),
        ("src/lib/deep/down/b.py", "nothing said"),
        ("src/lib/c.py", "code\n" + "This program is licensed under the GNU General Public License, version 2\ncode" + " word" * 80),
        ("other/d.py", None),
        (None, ""),
        ("src/lib/e.py", "copyright holders of nothing in particular, whoever they may have been in those days"),
        ("odd//f.py", "All rights reserved. Unauthorized copying of this file is strictly prohibited"),
        ("odd/g.py", "x"),
    ]
    df = docs_of(spark, [t for _, t in files])
    names = spark.createDataFrame([(i, f) for i, (f, _) in enumerate(files)], "doc_id long, file string")
    return df.join(names, "doc_id").withColumn("license", F.lit("mine"))


def test_own_and_inherited(tree):
    rows = scanned(tree)
    assert {i: (r.license, r.licensed_by) for i, r in rows.items()} == {
        0: ("Apache-2.0", "LICENSE"),
        1: ("Apache-2.0", ""),
        2: ("MIT", "src/lib/LICENSE.txt"),
        3: ("MIT", "src/lib"),
        4: ("GPL-2.0", "src/lib/c.py"),
        5: ("Apache-2.0", ""),
        6: ("Apache-2.0", ""),
        7: ("MIT", "src/lib"),
        8: ("Proprietary", "odd//f.py"),
        9: ("Apache-2.0", ""),
    }
    assert [i for i in rows if rows[i].is_license_file] and not rows[4].is_license_file


def test_lines_match_by_the_definition(spark):
    rng = random.Random(6)
    lines = {APACHE, MIT, "This work is licensed under CC BY-NC 4.0", "License granted to nobody", "license license", "all rights reserved", "..."}
    while len(lines) < 600:
        text = words(rng.choice(EVERY)[1])
        lines.add(" ".join(rng.sample(text, rng.randint(1, len(text))) + rng.choices(["word", "the", "Text", "of"], k=rng.randint(0, 6))))
    texts = ["the work of the day is in the text", "and with this the work", "license of nobody"] * 5
    share = L.shares(docs_of(spark, [*texts, None]))
    weight = L.weights(share)
    found = {r.digest: r for r in L.matched(spark.createDataFrame([(x, x) for x in lines], "digest string, line string"), weight).collect()}
    pattern = re.compile(L.needed(weight).replace("[^\\p{L}\\p{N}]", r"[\W_]"))
    definition = Definition(texts)
    for line in lines:
        want = definition.best(line)
        assert (line in found) == bool(want), line
        if want:
            assert (found[line].license, round(found[line].score, 5)) == (want[1], round(-want[0], 5))
            assert pattern.search(line.lower())
    assert 100 < len(found) < 500 and not pattern.search("the text of the of")


def test_few_words_in_common_are_no_licence(spark):
    probes = ["Are with and.", "and in or are with and", "of the software, to this copy any person", "free of charge to any person", "in source and forms"]
    prose = ["The work is in the hands of a person with a copy of the software, and to any of this they are free."] * 30
    rows = L.scan(docs_of(spark, probes + prose), F.lit("a/b")).collect()
    assert all(r.own_license is None and r.license is None for r in rows)


def test_every_template_is_found_by_its_own_text(spark):
    every = EVERY
    prose = "some prose about nothing at all\n" * 40
    rows = {r.doc_id: r for r in L.scan(docs_of(spark, [f"{prose}{x.upper() if i % 2 else x}\n{prose}" for i, (_, x) in enumerate(every)]), F.lit("a/b")).collect()}
    assert [rows[i].own_license for i in range(len(every))] == [name for name, _ in every]
    assert all(abs(rows[i].score - 1) < 1e-6 for i in rows)


def test_guards_stand_in_every_text_near_a_licence():
    texts = L.whole_texts()
    guards = set(L.guards(texts))
    assert len(guards) < sum(map(len, texts.values())) / 2
    for own in texts.values():
        square = sum(w * w for w in own.values())
        assert sum(w * w for t, w in own.items() if t not in guards) < (L.WHOLE - 1e-6) ** 2 * square


def test_whole_licence_texts_speak_for_their_directory(spark):
    names = sorted(p.stem for p in L.TEXTS.glob("*.txt"))
    text = {n: (L.TEXTS / f"{n}.txt").read_text() for n in names}
    docs = [(n, f"Copyright (c) 2021 Some Body\n\n{text[n]}") for n in names] + [("flat", " ".join(text["MIT"].split()))] * 2
    docs += [("half", text["MIT"][:400] + "\n" + "some prose about nothing at all " * 60)]
    rows = [(2 * i, t, f"{n}/{i}.txt") for i, (n, t) in enumerate(docs)] + [(2 * i + 1, "no notice", f"{n}/deep/{i}.txt") for i, (n, _) in enumerate(docs)]
    df = spark.createDataFrame(rows, "doc_id long, text string, file string")
    got = scanned(df)
    want = [*names, "MIT", "MIT"]
    assert [got[2 * i].own_license for i in range(len(want))] == want and all(got[2 * i].is_license_file for i in range(len(want)))
    assert [got[2 * i + 1].license for i in range(len(want))] == want
    assert not got[2 * len(want)].is_license_file and got[2 * len(want) + 1].license is None


def test_a_line_of_a_third_of_all_rows_beyond_the_broadcast(spark, tree, monkeypatch):
    df = docs_of(spark, [MIT] * 200 + [f"text {i}" for i in range(300)] + [f"{APACHE} {i % 3}" for i in range(100)])
    want = sorted(tuple(r) for r in L.scan(df, F.lit("x/y")).collect())
    monkeypatch.setattr(L, "MANY", 0)
    assert sorted(tuple(r) for r in L.scan(df, F.lit("x/y")).collect()) == want
    assert sum(r[4] == "MIT" for r in want) == 200


def test_empty_repeated_and_long(spark):
    assert L.scan(no_docs(spark), F.lit("x")).count() == 0
    df = docs_of(spark, [("word " * 100_000) + "\n" + MIT] * 2).withColumn("doc_id", F.lit(1))
    rows = L.scan(df, F.lit("p/q")).collect()
    assert [(r.license, r.is_license_file) for r in rows] == [("MIT", False)] * 2


def test_no_python_in_the_plan(spark, sf):
    plan = QUERIES["op8_license_scan"](spark, sf)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_query(spark, sf):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = {r.doc_id: r for r in QUERIES["op8_license_scan"](spark, sf).collect()}
    assert set(rows) == set(docs)
    definition = Definition([d.text for d in docs.values()])
    said = {x: definition.best(x) for x in {x for d in docs.values() for x in d.text.split("\n")}}
    for i, d in docs.items():
        want = min((said[x] for x in d.text.split("\n") if said[x]), default=None)
        assert rows[i].own_license == (want and want[1]) and rows[i].license == rows[i].own_license
    assert sum(r.own_license is not None for r in rows.values()) > 1


def test_join_on_terms_makes_a_row_for_each_term_of_a_text(spark):
    """Near copies of a licence: no row for each of the licences that have a term."""
    gpl = (L.TEXTS / "GPL-3.0.txt").read_text()
    lines = spark.createDataFrame([(f"{i}", f"{gpl} copy{i}".replace("\n", " ")) for i in range(20)], "digest string, line string")
    weight = L.weights({})
    for found in (L.matched(lines, weight, cosine=0.0, cover=0.0), L.whole_licenses(lines.select(F.col("line").alias("text")))):
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Join ") == plan.count("Join LeftOuter") == 1
        assert found.count() == 20
    assert {r.license for r in found.collect()} == {"GPL-3.0"}
