"""SentencePiece encoding, spans and decoding against the library itself."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from helpers import docs_of, no_docs
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from riskframe.llm import sentence_pieces
from riskframe.llm.queries import QUERIES

LETTERS = [*"ab  é▁😀\n\t\0世ﬁ㍿́ 　​..<s>½Å", "<0x0A>", "▁▁", "ÅÅ", "が"]


def charsmap(rule="nmt_nfkc") -> bytes:
    """A compiled map that comes with the library."""
    model = sentencepiece_model_pb2.ModelProto()
    model.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto())
    return model.normalizer_spec.precompiled_charsmap


def proto(rule, prefix, squeeze) -> bytes:
    model = sentencepiece_model_pb2.ModelProto()
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        model.ParseFromString(f.read())
    spec = model.normalizer_spec
    spec.precompiled_charsmap = charsmap(rule) if rule else b""
    spec.add_dummy_prefix, spec.remove_extra_whitespaces = prefix, squeeze
    return model.SerializeToString()


@pytest.mark.parametrize("rule", [None, "nmt_nfkc", "nfkc_cf"])
@pytest.mark.parametrize("prefix", [True, False])
@pytest.mark.parametrize("squeeze", [True, False])
def test_ids_spans_and_texts_of_any_normaliser(rule, prefix, squeeze):
    raw = proto(rule, prefix, squeeze)
    library, own = sentencepiece.SentencePieceProcessor(model_proto=raw), sentence_pieces.Pieces(proto=raw)
    rng = random.Random(7)
    texts = ["".join(rng.choice(LETTERS) for _ in range(rng.randint(0, 14))) for _ in range(1500)]
    ids, edges, begin, end, *_ = own.encoded([t.encode() for t in texts])
    for k, t in enumerate(texts):
        mine = slice(edges[k], edges[k + 1])
        pieces = library.encode(t, return_type="proto").pieces
        assert ids[mine].tolist() == [p.id for p in pieces], t
        assert list(zip(begin[mine].tolist(), end[mine].tolist())) == [(p.begin, p.end) for p in pieces], t
        assert own.decoded(ids[mine]).decode() == library.decode(ids[mine].tolist()), t


def test_lists_of_any_ids_decode_alike():
    rng = random.Random(5)
    for prefix in (True, False):
        for squeeze in (True, False):
            raw = proto(None, prefix, squeeze)
            library, own = sentencepiece.SentencePieceProcessor(model_proto=raw), sentence_pieces.Pieces(proto=raw)
            for _ in range(1500):
                some = [rng.choice([0, 1, 2, 259, 260, 261, rng.randint(3, 258), rng.randint(3, 258), rng.randint(0, 31999)]) for _ in range(rng.randint(0, 7))]
                assert own.decoded(np.array(some, np.int64)).decode() == library.decode(some)


def test_longest_key_of_the_compiled_map():
    found = sentence_pieces.CharMap(charsmap())
    text = "ﬁ x㍿ｶﾞ".encode()
    starts = np.array([0, 3, 4, 5, 8, 11])
    length, value = found.longest(np.frombuffer(text, np.uint8), starts)
    strings = found.strings.tobytes()
    given = [strings[v : strings.index(b"\0", v)].decode() if n else None for n, v in zip(length.tolist(), value.tolist())]
    assert given == ["fi", None, None, "株式会社", "ガ", "゙"] and length.tolist() == [3, 0, 0, 3, 6, 3]


def expected(texts: dict):
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    out = {}
    for i, t in texts.items():
        ids = library.encode(t or "")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out[i] = (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)), len((t or "").encode()))
    return out


def values(df):
    return {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256, r.source_bytes) for r in df.collect()}


def test_query_over_the_whole_table(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert values(QUERIES["op13_sentence_pieces"](spark, sf)) == expected(texts)


def test_odd_and_very_long_texts(spark):
    texts = [None, "", " ", "▁", "  two  blanks ", "<s>x</s><0x41>", "é世界😀\r\n", "word " * 500_000, "x" * 2_000_000, " " * 1_500_000, "▁a " * 500_000, "ab c " * 400_000 + "▁"]
    assert values(sentence_pieces.digests(docs_of(spark, texts))) == expected(dict(enumerate(texts)))


def test_spans_are_bytes_of_the_text(spark):
    text = "Grüße, 世界 and 😀 friends"
    rows, (ids, begins, ends) = sentence_pieces.encode(docs_of(spark, [text]))
    (r,) = rows.collect()
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert list(zip(r[ids], r[begins], r[ends])) == [(p.id, p.begin, p.end) for p in library.encode(text, return_type="proto").pieces]


def test_empty_tables_repeated_rows_and_clashes(spark):
    assert sentence_pieces.digests(no_docs(spark)).count() == 0
    df = docs_of(spark, ["same"] * 5 + [None]).withColumn("doc_id", F.lit(None).cast("long")).withColumn("ids", F.lit("x")).withColumn("decoded", F.lit(2))
    rows, names = sentence_pieces.encode(df)
    back, decoded = sentence_pieces.decode(rows, names[0])
    assert names == ["ids_", "begins", "ends"] and decoded == "decoded_"
    got = back.collect()
    assert [r.decoded_ for r in got] == ["same"] * 5 + [""] and {r.ids for r in got} == {"x"}
    assert sentence_pieces.digests(df).where("n_tokens = 0").count() == 1
