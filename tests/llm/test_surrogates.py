"""Surrogates: types, forms, coreference, distinctness."""

import re
import subprocess
import sys
from pathlib import Path

import pytest
from helpers import docs_of, no_docs
from pyspark.sql import functions as F

from riskframe.llm import surrogates as S
from riskframe.llm.queries import QUERIES

KEY = b"test"


def kinds(text):
    return [(text[a:b], k) for a, b, k, _ in S.detect(text)]


@pytest.mark.parametrize(
    "text, found",
    [
        ("write to und.34@mail7.example.com.", [("und.34@mail7.example.com", "email")]),
        ("é.è.9@mail.example.org", [("é.è.9@mail.example.org", "email")]),
        ("call +1 (017) 555-7713 now", [("+1 (017) 555-7713", "phone")]),
        ("+4915112345678", [("+4915112345678", "phone")]),
        ("4845168114407329 97.51.17.173", [("4845168114407329", "card"), ("97.51.17.173", "ip")]),
        ("4111-1111-1111-1111", [("4111-1111-1111-1111", "card")]),
        ("123-45-6789", [("123-45-6789", "ssn")]),
        ("٥٥٥-١٢-٣٤٥٦", [("٥٥٥-١٢-٣٤٥٦", "ssn")]),
        ("999.1.1.1 and 1.2.3.4.5", []),
        ('token = "04dbebab91ab85687d33"', [("04dbebab91ab85687d33", "secret")]),
        ("DE89 3704 0044 0532 0130 00", [("DE89 3704 0044 0532 0130 00", "iban")]),
        ("Dear Mrs. Anna Smith and Mr Jones", [("Anna", "given-f:latin"), ("Smith", "surname:latin"), ("Jones", "surname:latin")]),
        ("г-жа Анна Иванова", [("Анна", "given-f:cyrillic"), ("Иванова", "surname:cyrillic")]),
        ("nothing here, in 2024: 12 of 345", []),
    ],
)
def test_detection(text, found):
    assert kinds(text) == found


@pytest.mark.parametrize(
    "text",
    ["und.34@mail7.example.com", "+1 (017) 555-7713", "4845168114407329", "97.51.17.173", "123-45-6789", "٥٥٥-١٢-٣٤٥٦", "DE89 3704 0044 0532 0130 00", "10.0.0.7"],
)
def test_a_surrogate_is_of_the_same_type_and_form(text):
    new, [kind] = S.replace(text, KEY, {})
    assert new != text and [k for _, k in kinds(new)] == [kind]
    shape = lambda t: re.sub(r"\d+" if kind == "ip" else r"\d", "0", re.sub("[^\\W\\d_]", "a", t))
    assert shape(new) == shape(text)


def test_checksums_and_private_ranges_stay():
    digits = lambda t: [int(c) for c in t]
    assert S.luhn(digits(S.surrogate(KEY, "card", "4111111111111111")))
    iban = S.surrogate(KEY, "iban", "DE89370400440532013000")
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1
    assert S.surrogate(KEY, "ip", "192.168.1.9").startswith("192.168.")


def test_names_corefer_and_match_gender_and_script():
    text = "Mr. John Smith met Mrs. Anna Smith; SMITH and Smith left. г-жа Анна Иванова"
    new, _ = S.replace(text, KEY, {})
    john, smith = re.match(r"Mr\. (\w+) (\w+) met", new).groups()
    anna, again = re.search(r"Mrs\. (\w+) (\w+);", new).groups()
    assert again == smith and f" and {smith} left" in new
    assert anna.endswith("a") and not john.endswith("a")
    assert all("а" <= c.lower() <= "я" for c in "".join(new.rsplit(" ", 2)[1:]))


def test_a_number_in_two_forms_has_one_surrogate():
    new, _ = S.replace("4111-1111-1111-1111 and 4111111111111111", KEY, {})
    a, b = new.split(" and ")
    assert a.replace("-", "") == b


def settled(spark, rows, times=None):
    found = spark.createDataFrame([(*r, (times or {}).get(r, 1)) for r in rows], "kind string, entity string, n long")
    return {(r.kind, r.entity): r.draw for r in S.settle(found, KEY).collect()}


def test_names_of_all_kinds_are_told_apart(spark):
    words = [f"name{i}" for i in range(3000)]
    rows = [(k, w) for k in ("given-m:latin", "surname:latin") for w in words]
    # some surrogates are made originals of another kind
    rows += [("given-f:latin", S.surrogate(KEY, "surname:latin", w)) for w in words[:50]]
    draws = settled(spark, rows)
    new = [S.surrogate(KEY, k, e, draws.get((k, e), 0)) for k, e in rows]
    assert len(set(new)) == len(rows) and not set(new) & {e for _, e in rows} and len(draws) >= 50


def test_a_given_name_has_one_gender_in_the_corpus(spark):
    texts = ["Dr Alexis Roy and Ms Alexis Roy", "Mrs Alexis Roy", "Mr Alexis Roy. Mr Marek Roy"]
    rows = [r.text for r in S.pseudonymised(docs_of(spark, texts), key=KEY).collect()]
    names = {re.search(rf"{t} (\w+) ", x).group(1) for t, x in (("Dr", rows[0]), ("Ms", rows[0]), ("Mrs", rows[1]), ("Mr", rows[2]))}
    assert len(names) == 1 and names.pop().endswith("a")
    assert not re.search(r"\. Mr (\w+) ", rows[2]).group(1).endswith("a")


@pytest.mark.parametrize("text, first, last", [("Frau 王芳", "一", "龥"), ("Mr أحمد", "ا", "ي"), ("Dr 김철수", "가", "힣"), ("Mrs मीरा", "ऀ", "ॿ")])
def test_names_of_other_scripts_keep_them(text, first, last):
    new, [kind] = S.replace(text, KEY, {})
    assert kind == "surname" and new != text and all(first <= c <= last for c in new.split(" ")[1])


@pytest.mark.parametrize("text", ["κ. και το", "M Street", "Sr. Developer", "the Sr Engineer said", "κ Street", "Mr łukasz"])
def test_what_is_no_name_is_left_alone(text):
    assert kinds(text) == []


def test_numbers_of_many_draws_use_all_digits():
    assert any(not S.surrogate(KEY, "ssn", f"{i}", S.WIDER).startswith("9") for i in range(20))
    assert all(S.surrogate(KEY, "ssn", f"{i}").startswith("9") for i in range(20))


def test_collisions_draw_again_until_all_differ(spark):
    # Phones of two free digits: a hundred surrogates for sixty entities collide for certain.
    rows = [("phone", f"{i:02d}") for i in range(45)]
    draws = settled(spark, rows)
    new = [S.surrogate(KEY, k, e, draws.get((k, e), 0)) for k, e in rows]
    assert draws and len(set(new)) == len(rows) and not set(new) & {e for _, e in rows}


@pytest.mark.parametrize("blank", ["Password: ________", "secret:\n--------", "mail: ____@____.com", "token = ....____"])
def test_a_blank_to_be_filled_in_is_no_entity(blank):
    assert kinds(blank) == [] and S.replace(blank, KEY, {}) == (blank, [])


def test_a_corpus_with_blank_forms_settles(spark):
    texts = ["Password: ________", "secret:\n--------", "__@ab.example.com and __@cd.example.com", "password: ½½½½½½½½", "mail a@b.example.com"]
    rows = {r.doc_id: r for r in S.pseudonymised(docs_of(spark, texts), key=KEY).collect()}
    assert [rows[i].text for i in (0, 1)] == texts[:2] and [rows[i].pii_kinds for i in range(5)] == [[], [], ["email"] * 2, ["secret"], ["email"]]
    assert "__@" not in rows[2].text and "½" not in rows[3].text


def test_entities_with_all_values_of_their_form_settle(spark):
    # All ten of one form, and addresses whose domains take all 26 values, leave no free value of the same form.
    rows = [("secret", f"-------{i}") for i in range(10)] + [("email", f"{a}@b.com") for a in "abcdefghijklmnopqrstuvwxyz"]
    rows += [("email", f"__@{a}.com") for a in "abcdefghijklmnopqrstuvwxyz"]
    draws = settled(spark, rows)
    new = [(k, S.surrogate(KEY, k, e, draws.get((k, e), 0))) for k, e in rows]
    assert len(set(new)) == len(rows) and not set(new) & set(rows)
    assert S.surrogate(KEY, "ip", "192.168.1.9", S.WIDER).startswith("10.")


@pytest.mark.parametrize("limit", [1000, 0])
def test_both_ways_of_telling_draws_agree(spark, limit, monkeypatch):
    texts = [f"call +1 (017) 555-{i:04d} or mail u{i}@a.example.com" for i in range(30)] + [None, "", "plain"]
    real = S.surrogate
    fake = lambda key, kind, e, draw=0: "10000000000" if kind == "phone" and not draw and e.endswith("3") else real(key, kind, e, draw)
    monkeypatch.setattr(S, "surrogate", fake)
    rows = {r.doc_id: r for r in S.pseudonymised(docs_of(spark, texts), key=KEY, limit=limit).collect()}
    assert len(rows) == 33 and rows[30].text is None and rows[31].text == "" and rows[32].text == "plain"
    assert len({rows[i].text for i in range(30)}) == 30
    assert not any(re.search(r"555-00\d\d", rows[i].text) and "(017)" in rows[i].text for i in range(30))
    assert rows[3].pii_kinds == ["phone", "email"] and rows[30].pii_kinds == []


@pytest.mark.parametrize("limit", [1000, 0])
def test_rows_without_an_id_learn_of_draws(spark, limit, monkeypatch):
    real = S.surrogate
    fake = lambda key, kind, e, draw=0: "10000000000" if kind == "phone" and not draw else real(key, kind, e, draw)
    monkeypatch.setattr(S, "surrogate", fake)
    texts = [f"call +1 (017) 555-{i:04d}" for i in range(12)]
    df = docs_of(spark, texts).withColumn("doc_id", F.when(F.col("doc_id") % 3 > 0, F.col("doc_id")))
    out = S.pseudonymised(df, key=KEY, limit=limit)
    rows = out.collect()
    assert out.columns == [*df.columns, "pii_kinds"] and len(rows) == len({r.text for r in rows}) == 12
    assert sum(r.doc_id is None for r in rows) == 4


def test_empty_clashing_long_and_repeated(spark):
    assert S.pseudonymised(no_docs(spark)).count() == 0
    df = docs_of(spark, ["x " * 200_000 + "a@b.example.com"] * 2).withColumn("pii_kinds", F.lit("mine"))
    rows = S.pseudonymised(df).collect()
    assert rows[0].text == rows[1].text and "a@b.example.com" not in rows[0].text
    assert rows[0].pii_kinds == "mine" and rows[0].pii_kinds_ == ["email"]


def test_query_leaves_no_original_and_touches_nothing_else(spark, sf):
    before = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    after = {r.doc_id: r for r in QUERIES["op1_surrogates"](spark, sf).collect()}
    assert set(before) == set(after)
    originals, mapped = {}, {}
    for i, text in before.items():
        found, new = S.detect(text), S.detect(after[i].text)
        assert [k.partition(":")[0] for *_, k, _ in found] == after[i].pii_kinds
        assert len(found) == len(new)
        if not found:
            assert after[i].text == text
        for (*_, kind, e), (*_, e2) in zip(found, new):
            assert mapped.setdefault((kind, e), e2) == e2
            originals.setdefault(kind, set()).add(e)
    assert len(set(mapped.items())) == len({(k, v) for (k, _), v in mapped.items()})
    assert not any(v in originals[k] for (k, _), v in mapped.items())
    # names of all kinds over the whole corpus: as many surrogates as entities, none of them an original
    role = lambda k: f"{k.partition('-')[0]}:{k.partition(':')[2]}" if k.startswith("given") else k
    names = {(role(k), e): v for (k, e), v in mapped.items() if ":" in k}
    words = {e for _, e in names}
    assert len(set(names.values())) == len(names) and not words & set(names.values())


def test_workers_need_no_pandas():
    """Each Python worker of the stage would hold it as long as it lives."""
    code = "import sys, riskframe.llm.surrogates; sys.exit('pandas' in sys.modules)"
    assert subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parents[2]).returncode == 0
