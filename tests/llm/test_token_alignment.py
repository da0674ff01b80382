"""Token alignment against the two libraries and plain loops; the perfect hash function on its own."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from helpers import docs_of, no_docs
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from riskframe.llm import perfect_hash, token_pairs
from riskframe.llm.queries import QUERIES

ODD = [None, "", " ", "word", "it's 12 3's", "a▁b", "▁", "é世界 😀\n\tx", "<|endoftext|><s></s><0x0A>", "a" * 3000, " " * 70 + "x" + "\n" * 5, "don't  stop now", "\x00\x01 z"]


def byte_letters():
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(others)}


def brute(texts):
    """Rows per text by overlapping byte ranges, pair by pair."""
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    letters = byte_letters()

    def bytes_b(i):
        piece = b.id_to_piece(i)
        return bytes([int(piece[3:-1], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()

    def spans(ids, surface):
        out, at = [], 0
        for i in ids:
            n = len(surface(i))
            out.append((at, at + n, i))
            at += n
        return out

    rows = []
    for t in texts:
        x = spans(a.encode(" " + t, add_special_tokens=False).ids, lambda i: bytes(letters[c] for c in a.id_to_token(i))) if t else []
        y = spans(b.encode(t), bytes_b) if t else []
        joined = b"".join(bytes_b(i) for *_, i in y)
        if t and joined != (" " + t).encode():
            x, y = [], []
        links, k = [], 0
        for s, e, i in x:
            while k < len(y) and y[k][1] <= s:
                k += 1
            j = k
            while j < len(y) and y[j][0] < e:
                links.append((i, y[j][2]))
                j += 1
        ends = sorted({e for _, e, _ in x} & {e for _, e, _ in y})
        groups, lo = [], 0
        for hi in ends:
            groups.append((",".join(str(i) for s, e, i in x if lo <= s < hi), ",".join(str(i) for s, e, i in y if lo <= s < hi)) if len(ends) < 400 else None)
            lo = hi
        if len(ends) >= 400:
            at_x = at_y = 0
            groups = []
            for hi in ends:
                own_x, own_y = [], []
                while at_x < len(x) and x[at_x][0] < hi:
                    own_x.append(str(x[at_x][2]))
                    at_x += 1
                while at_y < len(y) and y[at_y][0] < hi:
                    own_y.append(str(y[at_y][2]))
                    at_y += 1
                groups.append((",".join(own_x), ",".join(own_y)))
        rows.append((len(x), len(y), links, ";".join("|".join(g) for g in groups), len(groups)))
    count = Counter(link for r in rows for link in r[2])
    most = {}
    for (_, j), n in count.items():
        most[j] = max(most.get(j, 0), n)
    return [
        (n_a, n_b, n_groups, len(links), sum(count[p] == most[p[1]] for p in links), sum(count[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if text else "")
        for n_a, n_b, links, text, n_groups in rows
    ]


def values(rows):
    return {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in rows}


def test_hash_functions_are_minimal_and_perfect():
    rng = np.random.default_rng(2)
    keys = np.unique(rng.integers(0, 2**63, 50_000, dtype=np.uint64))
    part = ((keys >> np.uint64(1)) % np.uint64(5)).astype(int)
    hashes = [perfect_hash.build(keys[part == p]) for p in range(5)]
    assert sorted(perfect_hash.Directory(hashes).index(keys, part).tolist()) == list(range(len(keys)))
    assert sum(w.nbytes for w, _ in hashes) * 8 < 4 * len(keys)
    assert perfect_hash.Directory([perfect_hash.build(keys[:0])]).index(keys[:3]).tolist() == [-1] * 3


def test_pairs_are_kept_by_their_keys():
    a, b = np.array([0, 1, 50256, 7]), np.array([0, 31999, 5, 7])
    x, y = token_pairs.unmixed(token_pairs.pair_keys(a, b))
    assert x.tolist() == a.tolist() and y.tolist() == b.tolist()


@pytest.fixture(scope="module")
def texts(spark, sf):
    own = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    return ODD + own[:120] + [own[0]] * 60


def test_against_plain_loops(spark, texts):
    want = dict(enumerate(brute(texts)))
    assert values(token_pairs.alignment(docs_of(spark, texts)).collect()) == want


def test_joined_instead_of_broadcast_in_many_slices_and_leaves(spark, texts, monkeypatch):
    want = dict(enumerate(brute(texts)))
    docs = docs_of(spark, texts).repartition(6)
    assert values(token_pairs.alignment(docs, limit=0, size=300).collect()) == want
    assert values(token_pairs.alignment(docs, size=300).collect()) == want


def test_counts_added_up_in_a_tree(spark, texts):
    partial = token_pairs.pair_counts(docs_of(spark, texts).repartition(7))
    table, parts, total = token_pairs.counted(partial, size=500, leaf=100, fan=2)
    got = {}
    for r in table.collect():
        got.update(zip(np.frombuffer(r["keys"], "<i8").tolist(), np.frombuffer(r["counts"], "<i8").tolist()))
    want = {r.key: r.n for r in partial.groupBy("key").agg(F.sum("n").alias("n")).collect()}
    assert got == want and total == len(want) and parts > 3


def test_a_very_long_text_is_worked_off_in_parts(spark, texts):
    long = " ".join(t for t in texts if t and "▁" not in t) * 12
    assert len(long) > 3_000_000
    cases = [long, "word " * 300_000, " " * 1_500_000 + "x", "long" * 700_000]
    got = values(token_pairs.alignment(docs_of(spark, cases)).collect())
    assert got == dict(enumerate(brute(cases)))


def test_query_over_the_whole_table(spark, sf):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert values(QUERIES["op12_token_alignment"](spark, sf).collect()) == dict(zip(rows, brute(rows.values())))


def test_empty_tables_repeated_ids_and_clashes(spark):
    assert token_pairs.alignment(no_docs(spark)).count() == 0
    df = docs_of(spark, ["some text", "some text", None]).withColumn("doc_id", F.lit(None).cast("long"))
    for name in ("n_a", "key", "keys", "part", "leaf", "rid", "counts"):
        df = df.withColumn(name, F.lit(1))
    for limit in (0, 10):
        rows = token_pairs.alignment(df, limit=limit).collect()
        assert sorted((r.n_a, r.count_sum) for r in rows) == [(0, 0), (2, 4), (2, 4)]


def test_segments_end_where_kinds_of_characters_do(spark):
    texts = ["one, two. one, two (one) 12,5 one", "déjà one, déjà two", "one\u00a0 two", "it's"]
    got = {bytes(r.segment).decode(): r.n for r in token_pairs.distinct_segments(docs_of(spark, texts)).collect()}
    want = {" one": 4, ",": 4, " two": 3, ".": 1, " (": 1, "one": 1, ")": 1, " 12": 1, "5": 1, " déjà": 2, " one\u00a0 two": 1, " it": 1, "'s": 1}
    assert got == want


def test_random_texts_of_all_kinds_of_characters_against_plain_loops(spark):
    rng = np.random.default_rng(5)
    kinds = ["a", "Z", "s", "t", "ll", "the", "7", "42", "'", "'s", "'RE", ".", ",", "--", "(", "_", " ", " ", "  ", "\n", "\t", "\r", ".\r", "\x0b", "\x1c", "\x85", "\u00a0", "\u2003", "\u3000", "\u2019", "é", "ß", "Ж", "世", "가", "😀", "\u0301", "×", "٣", "\x7f"]
    texts = ["".join(rng.choice(kinds, rng.integers(1, 40))) for _ in range(1500)]
    assert values(token_pairs.alignment(docs_of(spark, texts)).collect()) == dict(enumerate(brute(texts)))
