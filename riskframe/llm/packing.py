"""Packing of tokenised documents into sequences of a fixed length by exact complements, then best fit.

Lengths are small integers, so the whole plan is made on the histogram of
lengths (at most as many rows as a sequence has tokens, whatever the corpus):
the longest length left is opened together with the single, pair or triple of
available lengths that fills its gap exactly; where there is none, the best
fitting length is taken and the search repeated on the smaller gap. A pattern
found once is used as often as the counts allow. The rows then take their
places by their rank among the pieces of their length.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskframe.llm import flat
from riskframe.llm.common import LOWER, fresh
from riskframe.llm.ranks import ranked
from riskframe.session import materialise

LENGTH = 2048
VOCABULARY = "word_bpe_49k.json"
#: Words remembered by a task.
WORDS = 150_000
#: ASCII punctuation that may follow a word of letters; the tokenizer parts the two.
_TAIL = b".,!?;:|#$%&*()-+=/"
_LOWER = np.frombuffer(LOWER, np.uint8)
_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


class LetterWords:
    """A tokenizer with word ends as merges of bytes: a word's end is a line feed after it, joined to its last byte first.

    For lower-case words of letters below U+0180, which the tokenizer leaves as they are.
    """

    def __init__(self, spec: dict):
        import tiktoken

        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in set(plain)]
        letter = {b: chr(b) for b in plain} | {b: chr(256 + n) for n, b in enumerate(others)}
        byte, vocabulary = {c: b for b, c in letter.items()}, spec["model"]["vocab"]
        raw = lambda token: bytes(byte[c] for c in token.removesuffix("</w>")) + b"\n" * token.endswith("</w>")
        merged = (a + b for a, b in (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]))
        tokens = [*(letter[b] for b in range(256)), *(f"{c}</w>" for b, c in letter.items() if b != 10), *merged]
        ranks = {bytes([b]): b for b in range(256)}
        for token in tokens[256:]:
            ranks[raw(token)] = len(ranks)
        if len(ranks) != len(tokens):
            raise ValueError("two tokens of the same bytes")
        self.ids = np.array([vocabulary[t] for t in tokens], "<u4")
        self.merger = tiktoken.Encoding("words", pat_str=r"[^\n]+\n", mergeable_ranks=ranks, special_tokens={})

    @staticmethod
    def known(spec: dict) -> bool:
        """Whether a tokenizer is of the kind that is read here."""
        model, parts = spec["model"], (spec.get("pre_tokenizer") or {}).get("pretokenizers") or []
        return model["type"] == "BPE" and model.get("end_of_word_suffix") == "</w>" and bool(parts) and parts[-1]["type"] == "ByteLevel"

    def of(self, words: list[str]) -> np.ndarray:
        """The ids of all words one after another."""
        return self.ids[self.merger.encode_to_numpy("\n".join(words) + "\n", disallowed_special=())]


class WordIds:
    """Token ids of texts, each distinct word of a slice of texts looked up once.

    White space is dropped by the tokenizer and no token spans it, so the ids
    of a text are those of its words one after the other; likewise those of a
    word of letters and the punctuation after it. Words are remembered as
    packed ids (little-endian unsigned 32 bit) as long as a task lasts.
    """

    def __init__(self, tokenizer: str):
        from tokenizers import Tokenizer

        self.encoder = Tokenizer.from_file(tokenizer)
        vocabulary = self.encoder.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.known = flat.Remembered(self._made, WORDS)
        with open(tokenizer, encoding="utf-8") as f:
            spec = json.load(f)
        self.words = LetterWords(spec) if LetterWords.known(spec) else None

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.encoder.encode(text, add_special_tokens=False).ids, "<u4")

    def _letters(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Words of letters only: each is one run of tokens, the last of which ends a word."""
        texts = [w.decode() for w in words]
        if self.words is None:
            return self._split(words, self._ids(" ".join(texts)))
        plain = [k for k, t in enumerate(texts) if max(t) < "\u0180"]
        done = self._split([words[k] for k in plain], self.words.of([texts[k].lower() for k in plain])) if plain else {}
        rest = [w for w in words if w not in done]
        return done | self._split(rest, self._ids(" ".join(w.decode() for w in rest))) if rest else done

    def _split(self, words: list[bytes], ids: np.ndarray) -> dict[bytes, bytes]:
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != len(words):  # a letter whose lower case is more than letters
            return {w: self._ids(w.decode()).tobytes() for w in words}
        raw, ends = ids.tobytes(), (4 * ends).tolist()
        return {w: raw[a:b] for w, a, b in zip(words, [0, *ends], ends)}

    def _made(self, words: list[bytes]) -> list[bytes]:
        stems = [w.rstrip(_TAIL) for w in words]
        own = [bool(s) and _of_letters(s.decode()) for s in stems]
        letters = self._letters(list(dict.fromkeys(s for s, whole in zip(stems, own) if whole)))
        rest = {w[len(s) :] if whole else w for w, s, whole in zip(words, stems, own)}
        others = {w: self._ids(w.decode()).tobytes() if w else b"" for w in rest}
        return [letters[s] + others[w[len(s) :]] if whole else others[w] for w, s, whole in zip(words, stems, own)]

    def of(self, data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the texts between ``edges``, and the edges of the texts among them."""
        data, plain = _LOWER[data], data
        marks = np.flatnonzero((plain[:-1] == 60) & (plain[1:] == 124))
        for k in np.unique(np.searchsorted(edges, marks, side="right") - 1).tolist():  # "<|" may begin a special token
            data[edges[k] : edges[k + 1]] = plain[edges[k] : edges[k + 1]]
        blank = _BLANK[data]
        stop = np.zeros(0, np.int64)
        if len(data) > 2:  # a full stop or comma between a letter and a blank is a token of its own
            letter = (data[:-2] >= 97) & (data[:-2] <= 122)
            stop = np.flatnonzero(letter & ((data[1:-1] == 46) | (data[1:-1] == 44)) & blank[2:]) + 1
        starts, ends = flat.runs(~blank, np.concatenate([edges, stop]))
        ids, counts = self.known.tokens(data, starts, ends)
        return ids, np.concatenate([[0], np.cumsum(counts)])[np.searchsorted(starts, edges)]


def _of_letters(word: str) -> bool:
    """Letters only, also in lower case (a capital may come apart into a letter and a mark)."""
    return word.isalpha() and word.lower().isalpha()


def tokenizer_path(path: str | None) -> str:
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def pieces(docs: DataFrame, length: int = LENGTH, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids and a closing 0, cut only if longer than ``length``.

    A null text counts as empty: one piece of length 1.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordIds(tokenizer_path(tokenizer))
        for batch in flat.slices(batches, 1):
            data, edges = flat.flat(batch.column(1))
            if batch.num_rows == 1 and len(data) > flat.STRETCH:
                parts = (np.frombuffer(part, np.uint8) for part in flat.chunks(data.tobytes()))
                ids = np.concatenate([words.of(part, np.array([0, len(part)]))[0] for part in parts])
                edges = np.array([0, len(ids)])
            else:
                ids, edges = words.of(data, edges)
            raw, ends = ids.astype("<u4").tobytes(), (4 * edges).tolist()
            out: tuple[list, ...] = ([], [], [], [], [])
            for i, (begin, end) in enumerate(zip(ends, ends[1:])):
                own = raw[begin:end] + b"\0\0\0\0"
                for piece, start in enumerate(range(0, len(own), 4 * length)):
                    part = own[start : start + 4 * length]
                    for column, value in zip(out, (i, piece, start // 4, len(part) // 4, zlib.crc32(part))):
                        column.append(value)
            rows = batch.column(0).take(pa.array(out[0], pa.int64()))
            rest = [pa.array(c, t) for c, t in zip(out[1:], (pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([rows, *rest], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long"
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(cut, schema)


class Lengths:
    """Available counts per length, with searches for what sums to a gap exactly."""

    def __init__(self, counts: dict[int, int], length: int):
        self.n = np.zeros(length + 1, np.int64)
        for k, v in counts.items():
            self.n[k] = v

    def pair(self, gap: int, least: int = 1) -> tuple[int, ...] | None:
        """The pair of sum ``gap`` whose larger part is largest; the hash of a sum is the sum itself."""
        low = np.arange(least, gap // 2 + 1)
        fits = (self.n[low] > 0) & (self.n[gap - low] > 0) & ((2 * low != gap) | (self.n[low] > 1))
        at = int(fits.argmax()) if len(fits) else 0
        return (gap - int(low[at]), int(low[at])) if len(fits) and fits[at] else None

    def triple(self, gap: int) -> tuple[int, ...] | None:
        for small in np.flatnonzero(self.n[: gap // 3 + 1]):
            small = int(small)
            if small == 0:
                continue
            self.n[small] -= 1
            pair = self.pair(gap - small, small)
            self.n[small] += 1
            if pair:
                return (*pair, small)
        return None

    def exact(self, gap: int) -> tuple[int, ...] | None:
        """A single length, a pair or a triple that fills ``gap``."""
        return (gap,) if self.n[gap] else self.pair(gap) or self.triple(gap)

    def below(self, gap: int) -> int:
        """The largest available length that fits, or 0."""
        found = np.flatnonzero(self.n[1 : gap + 1])
        return int(found[-1]) + 1 if len(found) else 0


def plan(counts: dict[int, int], length: int = LENGTH) -> list[tuple[tuple[int, ...], int]]:
    """(pattern of lengths, how often): uses every piece exactly once."""
    left = Lengths(counts, length)
    out = []
    while top := left.below(length):
        pattern = [top]
        left.n[top] -= 1
        while gap := length - sum(pattern):
            found = left.exact(gap) or ((best,) if (best := left.below(gap)) else None)
            if not found:
                break
            for x in found:
                left.n[x] -= 1
                pattern.append(x)
        need = {x: pattern.count(x) for x in pattern}
        more = min(int(left.n[x]) // k for x, k in need.items())
        for x, k in need.items():
            left.n[x] -= more * k
        out.append((tuple(pattern), more + 1))
    return out


def places(patterns: list[tuple[tuple[int, ...], int]], length: int = LENGTH) -> dict[int, tuple[np.ndarray, ...]]:
    """Per length: first rank, first sequence and offset of each run of equally placed pieces."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    used = [0] * (length + 1)
    sequence = 0
    for pattern, times in patterns:
        offset = 0
        for x in pattern:
            runs.setdefault(x, []).append((used[x], sequence, offset))
            used[x] += times
            offset += x
        sequence += times
    return {x: tuple(np.array(c, np.int64) for c in zip(*r)) for x, r in runs.items()}


def pack(cut: DataFrame, length: int = LENGTH, id_cols: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """``cut`` (any rows with a ``length`` of 1 to ``length``) with ``sequence_id`` and ``offset``.

    An empty table gives an empty result; pieces of one length are dealt in an
    order fixed by their ids, and those of equal ids as they come. Clashing
    names get new columns with ``_`` appended.
    """
    (pri,) = fresh(cut, "priority")
    sequence_c, offset_c = fresh(cut, "sequence_id", "offset")
    priority = F.xxhash64(*[F.col(c).cast("string") for c in id_cols], F.lit("pack"))
    kept = materialise(cut.withColumn(pri, priority))
    counts = {r[0]: r[1] for r in kept.groupBy("length").count().collect()}
    runs = places(plan(counts, length), length)
    columns = cut.columns
    rows, rank = ranked(kept, "length", pri, counts)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, at = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("length", rank))
            sequence, offset = np.zeros_like(at), np.zeros_like(at)
            for x in np.unique(size):
                own = np.flatnonzero(size == x)
                first, seq, off = runs[int(x)]
                run = np.searchsorted(first, at[own], side="right") - 1
                sequence[own] = seq[run] + at[own] - first[run]
                offset[own] = off[run]
            keep = [b.column(b.schema.get_field_index(c)) for c in columns]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(sequence), pa.array(offset)], names=[*columns, sequence_c, offset_c])

    schema = T.StructType([*cut.schema.fields, T.StructField(sequence_c, T.LongType()), T.StructField(offset_c, T.LongType())])
    return rows.mapInArrow(place, schema)
