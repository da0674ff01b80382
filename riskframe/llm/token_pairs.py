"""Alignment of two tokenizers' tokens over a corpus, with corpus-wide counts of linked token pairs.

Two tokens link where their bytes overlap. Texts are cut where both tokenizers
cut, which the bytes on either side tell: between kinds of characters, if no
piece of the second tokenizer holds these bytes together. The first pass counts
the distinct segments of the corpus and aligns each of them once, which gives the
pairs and how many links hold them, added up inside each task. The distinct pairs are cut into slices by hash,
each with a minimal perfect hash function; the tasks' counts become dense
vectors indexed by that function, which are added up in a tree. The second
pass aligns the documents again and looks every link up, the pair stored at
its index being compared with it.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.llm import flat, perfect_hash
from riskframe.llm.common import mix, utf8
from riskframe.llm.sentence_pieces import BLANK, Pieces
from riskframe.session import materialise

MODEL_A = "byte_bpe_50k.json"
#: Fixed value: how byte-level tokenizers of this kind part a text before merging.
PARTS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Distinct pairs that a task holds, pairs of a slice, rows that make a vector, vectors added at a time.
HELD, SLICE, LEAF, FAN = 400_000, 4096, 500_000, 32
#: Pairs up to which the functions, pairs and counts (17 bytes a pair) are broadcast; beyond it links are joined with them.
BROADCAST = 4_000_000
#: Bytes of texts whose segments are numbered together, and segments that a task adds up at a time.
TEXTS, SEEN = 4 << 20, 300_000
#: Segments that are aligned at a time, and of these in one text for the second tokenizer.
STEP, ROW = 5_000, 16
_LOW32 = np.int64(0xFFFFFFFF)
_LETTER, _DIGIT, _OTHER, _BLANK = 1, 2, 3, 4
#: What ``PARTS`` takes a byte for; 0: more than this byte decides, or it doesn't matter.
_KIND = np.zeros(256, np.int64)
_KIND[33:127] = _OTHER
_KIND[48:58] = _DIGIT
_KIND[65:91] = _KIND[97:123] = _LETTER
_KIND[[*b" \t\n\r"]] = _BLANK
#: The UTF-8 bytes, as numbers, of blanks beyond ASCII.
_WIDE = np.array([int.from_bytes(chr(c).encode()) for c in (0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)])


class ByteLevel:
    """A byte-level BPE tokenizer read from its JSON file; special tokens are plain text."""

    def __init__(self, path: str):
        import tiktoken

        self.path, self.exact = path, None
        spec = json.loads(open(path, encoding="utf-8").read())
        if spec["model"]["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["normalizer"]:
            raise ValueError("a byte-level BPE tokenizer without normaliser is needed")
        special = {t["id"] for t in spec["added_tokens"]}
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in set(plain)]
        byte = {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(others)}
        vocabulary = {bytes(byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if i not in special}
        self.surface = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.surface[i] = token
        self.width = np.array([len(t) for t in self.surface], np.int64)
        self.pool = np.frombuffer(b"".join(self.surface), np.uint8)
        self.start = np.cumsum(self.width) - self.width
        self.fast = tiktoken.Encoding("byte level", pat_str=PARTS, mergeable_ranks=vocabulary, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        try:
            return self.fast.encode_to_numpy(text, disallowed_special=()).astype(np.int64)
        except ValueError:  # its pattern gives up on very long runs of blanks
            if self.exact is None:
                from tokenizers import Tokenizer

                self.exact = Tokenizer.from_file(self.path)
                self.exact.encode_special_tokens = True
            return np.array(self.exact.encode(text, add_special_tokens=False).ids, np.int64)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of all ids one after another."""
        return self.pool[flat.indices(self.start[ids], self.width[ids])]


def pair_keys(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Well-mixed 64-bit keys of pairs of ids; no two pairs share one."""
    return mix(((a.astype(np.int64) << 32) | b.astype(np.int64)).view(np.uint64))


def unmixed(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of ids with these keys."""
    x = keys ^ (keys >> np.uint64(31)) ^ (keys >> np.uint64(62))
    x = x * np.uint64(pow(0x94D049BB133111EB, -1, 1 << 64))
    x = x ^ (x >> np.uint64(27)) ^ (x >> np.uint64(54))
    x = x * np.uint64(pow(0xBF58476D1CE4E5B9, -1, 1 << 64))
    x = (x ^ (x >> np.uint64(30)) ^ (x >> np.uint64(60))).view(np.int64)
    return x >> 32, x & _LOW32


#: Of segments, stretches of text that both tokenizers read apart from what stands around them: the numbers of first and second
#: tokens, groups and links (a row each), the keys of the links of all, the groups of each as text (a1,a2|b1;a3|b2).
Segments = tuple[np.ndarray, np.ndarray, list[str]]


def breaks(pieces: Pieces) -> np.ndarray:
    """Whether a text may be cut between two bytes, by the first and the second: no token of either tokenizer reaches over.

    The first tokenizer parts where one kind of characters ends; blanks are
    left with what follows, letters with an apostrophe. After a byte beyond
    ASCII only blanks are told, and `cut` sees to blanks beyond ASCII.
    """
    before, after = _KIND[:, None], _KIND[None, :]
    out = (before != after) & (before > 0) & (after > 0) & (before != _BLANK)
    out[ord("'"), _KIND == _LETTER] = False
    out[128:, _KIND == _BLANK] = True
    inside = np.ones(len(pieces.pool), bool)
    inside[pieces.start[pieces.width > 0]] = False
    inside = np.flatnonzero(inside)
    out[pieces.pool[inside - 1], pieces.pool[inside]] = False
    return out


class Aligner:
    """Both tokenizers, and the alignment of the segments of texts."""

    def __init__(self, path_a: str | None = None, path_b: str | None = None):
        if path_a is None:
            import public_tokenizers

            path_a = public_tokenizers.path(MODEL_A)
        self.a, self.b = ByteLevel(path_a), Pieces(path_b)
        if self.b.map is not None or self.b.squeeze or not self.b.prefix:
            raise ValueError("the second tokenizer must keep every byte and put a blank before a text")
        self.breaks = breaks(self.b)
        fronts = bytes(c for c in b" \t\n\r" if self.breaks[33:127, c].all() and self.breaks[128:192, c].all())
        # a segment that may stand beside others of the kind without a token reaching over: from a blank to a character that is none
        last = rb"(?:[!-~]|[\xc3-\xdf].|[\xe0\xe4-\xef]..)"
        self.beside = re.compile(rb"[" + re.escape(fronts) + rb"](?=[!-~\x80-\xff]).*" + last + rb"\Z" if fronts else rb"(?!)", re.DOTALL)
        # every id in decimal, as it stands inside a group and as its last
        listed = lambda n, end: np.array([f"{i}{c}" for i in range(n) for c in (",", end)], object)
        self.text_a, self.text_b = listed(len(self.a.surface), "|"), listed(len(self.b.surface), ";")

    def segments(self, texts: list[bytes], first: bool = True) -> tuple[np.ndarray, np.ndarray, Segments]:
        """(number of each segment among the distinct ones, edges of the texts among the segments, the distinct segments aligned)."""
        codes, edges, words = cut(texts, self.breaks, first)
        return codes, edges, self.aligned(words.to_pylist())

    def aligned(self, segments: list[bytes], said: bool = True) -> Segments:
        """The alignment of some distinct segments; without ``said`` their groups are not written out."""
        done = [self._aligned(segments[at : at + STEP], said) for at in range(0, len(segments), STEP)]
        sizes = np.concatenate([np.zeros((4, 0), np.int64), *(s for s, _, _ in done)], axis=1)
        return sizes, np.concatenate([np.zeros(0, np.uint64), *(k for _, k, _ in done)]), [*chain.from_iterable(t for *_, t in done)]

    def _aligned(self, segments: list[bytes], said: bool) -> Segments:
        match, n = self.beside.match, len(segments)
        order = [k for k, s in enumerate(segments) if not match(s)]
        apart, texts = len(order), segments
        if apart:
            alone = set(order)
            order += [k for k in range(n) if k not in alone]
            texts = [segments[k] for k in order]
        single = [t.decode() for t in texts[:apart]]
        rows = [b"".join(texts[at : at + ROW]).decode() for at in range(apart, n, ROW)]
        a = np.concatenate([*map(self.a.ids, single), self.a.ids("".join(rows))])
        b = np.fromiter(chain.from_iterable(self.b.merger.encode(single + rows, num_threads=1)), np.int64)
        whole = b"".join(texts)
        if self.a.joined(a).tobytes() != whole or self.b.joined(b).tobytes() != whole:
            raise ValueError("tokens that do not join to their text")
        of_a, of_b = np.zeros(len(whole) + 1, bool), np.zeros(len(whole) + 1, bool)
        of_a[np.cumsum(self.a.width[a])] = of_b[np.cumsum(self.b.width[b])] = True
        cuts = np.flatnonzero(of_a | of_b)  # a stretch between cuts lies in one token of either
        of_a, of_b = of_a[cuts], of_b[cuts]
        both = of_a & of_b
        upto = np.array([np.cumsum(of_a), np.cumsum(of_b), np.cumsum(both)])
        keys = pair_keys(a[upto[0] - of_a], b[upto[1] - of_b])
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, n))
        closes = np.searchsorted(cuts, ends)
        if not (both[closes] & (cuts[closes] == ends)).all():
            raise ValueError("a token that reaches over a segment's end")
        sizes = np.diff(np.vstack([upto[:, closes], closes + 1]), prepend=0)
        listed = [""] * n
        if said:
            group = upto[2] - both
            listed = self._listed(a, b, group[of_a], group[of_b], int(upto[2, -1]), sizes[0] + sizes[1])
        if not apart:
            return sizes, keys, listed
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        starts = np.cumsum(sizes[3]) - sizes[3]
        return sizes[:, place], keys[flat.indices(starts[place], sizes[3][place])], [listed[k] for k in place.tolist()]

    def _listed(self, a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, groups: int, counts: np.ndarray) -> list[str]:
        """Tokens as text, group by group, those of the first tokenizer before those of the second."""
        last_a, last_b = np.append(group_a[1:] != group_a[:-1], True)[: len(a)], np.append(group_b[1:] != group_b[:-1], True)[: len(b)]
        before_b = np.concatenate([[0], np.cumsum(np.bincount(group_b, minlength=groups))])
        upto_a = np.cumsum(np.bincount(group_a, minlength=groups))
        words = np.empty(len(a) + len(b), object)
        words[np.arange(len(a)) + before_b[group_a]] = self.text_a[2 * a + last_a]
        words[np.arange(len(b)) + upto_a[group_b]] = self.text_b[2 * b + last_b]
        words, at = words.tolist(), [0, *np.cumsum(counts).tolist()]
        return ["".join(words[s:e])[:-1] for s, e in zip(at, at[1:])]


@lru_cache(maxsize=1)
def aligner(path_a: str | None = None, path_b: str | None = None) -> Aligner:
    """One of them for all tasks of a Python worker: it takes longer to read than many a task."""
    return Aligner(path_a, path_b)


def cut(texts: list[bytes], table: np.ndarray, first: bool = True) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(number of each segment among the distinct ones, edges of the texts among the segments, distinct segments).

    ``table`` tells where to cut (see `breaks`). ``first``: the texts are whole
    or begin one, so they get a blank before them. Texts with U+2581, which
    reads as a blank, have no segments.
    """
    spaced = [b"" if BLANK in t else b" " + t if t and first else t for t in texts]
    data = np.frombuffer(b"".join(spaced), np.uint8)
    size = np.fromiter(map(len, spaced), np.int64, len(spaced))
    edges = np.concatenate([[0], np.cumsum(size)])
    begins = np.zeros(len(data) + 1, bool)
    if len(data) > 2:
        begins[1:-1] = table.ravel()[data[:-1].astype(np.uint16) << 8 | data[1:]]
        after = np.flatnonzero(begins[1:-1] & (data[:-1] > 127)) + 1
        last = data[after - 3].astype(np.int64) << 16 | data[after - 2].astype(np.int64) << 8 | data[after - 1]
        begins[after[np.isin(last, _WIDE) | np.isin(last & 0xFFFF, _WIDE)]] = False
    begins[edges[:-1][size > 0]] = True
    starts = np.flatnonzero(begins[:-1])
    codes, words = flat.numbered(data, starts, np.append(starts[1:], len(data))[: len(starts)])
    return codes, np.searchsorted(starts, edges), words


def _documents(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[tuple[list[bytes], bool]]]]:
    """Slices of rows with their texts to align: all at once, or a single very long text in parts."""
    for batch in flat.slices(batches, column, TEXTS):
        texts = [t or b"" for t in utf8(batch.column(column))]
        if len(texts) > 1 or len(texts[0]) <= flat.STRETCH or BLANK in texts[0]:
            yield batch, [(texts, True)]
        else:
            yield batch, [([part], k == 0) for k, part in enumerate(flat.chunks(texts[0]))]


def distinct_segments(docs: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """(segment, n): the distinct segments of all texts (column ``text``) and how often they occur, added up in the tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def give() -> Iterator[pa.RecordBatch]:
            if held:
                sums = pa.concat_tables(held).group_by("segment").aggregate([("n", "sum")])
                yield from sums.select(["segment", "n_sum"]).rename_columns(["segment", "n"]).to_batches(max_chunksize=50_000)
            held.clear()

        for _, parts in _documents(batches, 0):
            for texts, first in parts:
                codes, _, words = cut(texts, aligner(path_a, path_b).breaks, first)
                held.append(pa.table({"segment": words.cast(pa.binary()), "n": np.bincount(codes, minlength=len(words))}))
                if sum(t.num_rows for t in held) > SEEN:
                    yield from give()
        yield from give()

    return docs.select("text").mapInArrow(run, "segment binary, n long").groupBy("segment").agg(F.sum("n").alias("n"))


def pair_counts(docs: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """(key, n): links of each pair, added up in the tasks only; a pair comes once for each task that has it, or a few times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        new: list[tuple[np.ndarray, np.ndarray]] = []
        waiting = 0

        def merge() -> None:
            nonlocal keys, counts, new, waiting
            joined, times = np.concatenate([keys, *(k for k, _ in new)]), np.concatenate([counts, *(n for _, n in new)])
            order = np.argsort(joined)
            joined, times = joined[order], times[order]
            first = np.flatnonzero(np.append(True, joined[1:] != joined[:-1])[: len(joined)])
            keys, counts = joined[first], np.add.reduceat(times, first) if len(first) else times
            new, waiting = [], 0

        def give() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], names=["key", "n"])

        for batch in batches:
            for part in flat.slices(iter([batch]), 0, rows=5000):
                sizes, own, _ = aligner(path_a, path_b).aligned(part.column(0).to_pylist(), said=False)
                new.append((own, np.repeat(part.column(1).to_numpy(), sizes[3])))
                waiting += len(own)
                if waiting > 1 << 20:
                    merge()
                    if len(keys) > HELD:
                        yield give()
                        keys, counts = keys[:0], counts[:0]
        merge()
        yield give()

    return distinct_segments(docs, path_a, path_b).mapInArrow(run, "key long, n long")


def _packed(words: np.ndarray, sizes: np.ndarray) -> tuple[bytes, list[int]]:
    return words.astype("<u8").tobytes(), sizes.tolist()


def _function(row) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(row["words"].as_py(), "<u8"), np.array(row["sizes"].as_py(), np.int64)


def counted(partial: DataFrame, size: int = SLICE, leaf: int = LEAF, fan: int = FAN) -> tuple[DataFrame, int, int]:
    """(part, words, sizes, keys, counts) per slice of pairs, the number of slices, and that of pairs.

    ``words`` and ``sizes`` are the slice's hash function; ``keys`` and
    ``counts`` have at each index the pair and how many links hold it. A task
    holds one slice and at most about ``leaf`` rows of counts or ``fan``
    vectors, whatever the corpus.
    """
    partial = materialise(partial)
    keys = materialise(partial.select("key").distinct())
    total = keys.count()
    parts = max(1, -(-total // size))
    part = F.pmod(F.shiftrightunsigned("key", 1), F.lit(parts)).cast("int").alias("part")

    def build(group: pa.Table) -> pa.Table:
        own = group.column("key").to_numpy().view(np.uint64)
        words, sizes = perfect_hash.build(own)
        ordered = np.zeros(len(own), np.uint64)
        ordered[perfect_hash.Directory([(words, sizes)]).index(own)] = own
        raw, sizes = _packed(words, sizes)
        return pa.table({"part": group.column("part")[:1].cast(pa.int32()), "words": pa.array([raw], pa.binary()), "sizes": pa.array([sizes], pa.list_(pa.int32())), "keys": pa.array([ordered.tobytes()], pa.binary())})

    made = materialise(keys.select("key", part).groupBy("part").applyInArrow(build, "part int, words binary, sizes array<int>, keys binary"))
    leaves = max(1, -(-partial.count() // (parts * leaf)))
    dealt = partial.select("key", "n", part, F.pmod(F.monotonically_increasing_id(), F.lit(leaves)).cast("int").alias("leaf"))
    functions = made.select("part", F.explode(F.sequence(F.lit(0), F.lit(leaves - 1))).alias("leaf"), "words", "sizes")

    def vector(left: pa.Table, right: pa.Table) -> pa.Table:
        empty = pa.table({"part": pa.array([], pa.int32()), "leaf": pa.array([], pa.int32()), "counts": pa.array([], pa.binary())})
        if not left.num_rows:
            return empty
        row = {c: right.column(c)[0] for c in ("words", "sizes")}
        words, sizes = _function(row)
        out = np.zeros(int(np.bitwise_count(words).sum()), np.int64)
        index = perfect_hash.Directory([(words, sizes)]).index(left.column("key").to_numpy().view(np.uint64))
        np.add.at(out, index, left.column("n").to_numpy())
        return pa.table({"part": left.column("part")[:1].cast(pa.int32()), "leaf": left.column("leaf")[:1].cast(pa.int32()), "counts": pa.array([out.tobytes()], pa.binary())})

    kind = "part int, leaf int, counts binary"
    vectors = dealt.groupBy("part", "leaf").cogroup(functions.groupBy("part", "leaf")).applyInArrow(vector, kind)

    def add(group: pa.Table) -> pa.Table:
        out = sum(np.frombuffer(v.as_buffer(), "<i8") for v in group.column("counts"))
        return pa.table({"part": group.column("part")[:1].cast(pa.int32()), "leaf": group.column("leaf")[:1].cast(pa.int32()), "counts": pa.array([out.tobytes()], pa.binary())})

    while leaves > 1:
        leaves = -(-leaves // fan)
        above = vectors.select("part", F.floor(F.col("leaf") / fan).cast("int").alias("leaf"), "counts")
        vectors = above.groupBy("part", "leaf").applyInArrow(add, kind)
    return materialise(made.join(vectors.drop("leaf"), "part")), parts, total


def best_counts(table: DataFrame) -> DataFrame:
    """(b, most): the highest count that any pair of an id of the second tokenizer has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, counts in zip(batch.column(0), batch.column(1)):
                _, b = unmixed(np.frombuffer(keys.as_buffer(), "<u8"))
                n = np.frombuffer(counts.as_buffer(), "<i8")
                order = np.lexsort((n, b))
                last = np.append(b[order][1:] != b[order][:-1], True)[: len(b)]
                yield pa.RecordBatch.from_arrays([pa.array(b[order][last]), pa.array(n[order][last])], names=["b", "most"])

    own = table.select("keys", "counts").mapInArrow(run, "b long, most long")
    return own.groupBy("b").agg(F.max("most").alias("most"))


class Lookup:
    """Counts of pairs from the slices' rows (words, sizes, keys, counts), in order of their parts."""

    def __init__(self, rows: list[tuple[bytes, list[int], bytes, bytes]], most: np.ndarray):
        self.directory = perfect_hash.Directory([(np.frombuffer(w, "<u8"), np.array(s, np.int64)) for w, s, _, _ in rows])
        self.keys = np.frombuffer(b"".join(k for _, _, k, _ in rows), "<u8")
        self.counts = np.frombuffer(b"".join(c for *_, c in rows), "<i8")
        self.parts, self.most = np.uint64(max(1, len(rows))), most

    def of(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(count, whether no pair of the same second id has more) of each key."""
        distinct, back = np.unique(keys, return_inverse=True)
        index = self.directory.index(distinct, ((distinct >> np.uint64(1)) % self.parts).astype(np.int64))
        if not np.array_equal(self.keys[index], distinct):
            raise ValueError("a pair that was not counted")
        n = self.counts[index]
        return n[back], (n == self.most[unmixed(distinct)[1]])[back]


def _summary(docs: DataFrame, path_a: str | None, path_b: str | None, shared=None, size: int = 0) -> DataFrame:
    """Per document counts and the digest of its groups; with ``shared`` counts looked up, else its distinct pairs."""
    looked = shared is not None
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", *(["n_best", "count_sum"] if looked else ["keys", "times"]), "groups_sha256"]
    kinds = [kind, *["long"] * 4, *(["long"] * 2 if looked else ["array<long>"] * 2), "string"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = None
        if looked:
            rows, best = shared.value
            most = np.zeros(size, np.int64)
            for b, n in best:
                most[b] = n
            table = Lookup(rows, most)
        for batch, parts in _documents(batches, 1):
            n = batch.num_rows
            sums = np.zeros((6, n), np.int64)
            digest, tail = [hashlib.sha256() for _ in range(n)], [""] * n
            pairs: list[list[np.ndarray]] = [[np.zeros(0, np.uint64)] for _ in range(n)]
            for texts, first in parts:
                codes, edges, (sizes, keys, said) = aligner(path_a, path_b).segments(texts, first)
                bounds = np.concatenate([[0], np.cumsum(sizes[3])])
                if looked:
                    count, best = table.of(keys)
                    sizes = [*sizes, flat.spread(best.astype(np.int64), bounds), flat.spread(count, bounds)]
                for row, own in enumerate(sizes):
                    sums[row] += flat.spread(own[codes], edges)
                numbers, ends = codes.tolist(), edges.tolist()
                for k in np.flatnonzero(np.diff(edges) > 0).tolist():
                    digest[k].update((tail[k] + ";".join([said[c] for c in numbers[ends[k] : ends[k + 1]]])).encode())
                    tail[k] = ";"
                    if not looked:
                        own = codes[ends[k] : ends[k + 1]]
                        pairs[k].append(keys[flat.indices(bounds[own], sizes[3][own])])
            if looked:
                middle = [pa.array(sums[4]), pa.array(sums[5])]
            else:
                own = [np.unique(np.concatenate(p), return_counts=True) for p in pairs]
                lists = pa.list_(pa.int64())
                middle = [pa.array([k.view(np.int64) for k, _ in own], lists), pa.array([c for _, c in own], lists)]
            made = pa.array([d.hexdigest() if t else "" for d, t in zip(digest, tail)])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(s) for s in sums[:4]), *middle, made], names=names)

    return docs.mapInArrow(run, ", ".join(f"{n} {k}" for n, k in zip(names, kinds)))


def _joined(whole: DataFrame, table: DataFrame, best: DataFrame, parts: int, leaf: int = LEAF) -> DataFrame:
    """The looked-up counts of ``whole`` by meeting the slices' functions in the shuffle instead of a broadcast."""
    whole = materialise(whole).withColumn("rid", F.monotonically_increasing_id())
    links = whole.select("rid", F.explode(F.arrays_zip("keys", "times")).alias("p")).select("rid", F.col("p.keys").alias("key"), F.col("p.times").alias("times"))
    leaves = max(1, -(-int(whole.agg(F.sum(F.size("keys"))).first()[0] or 0) // (parts * leaf)))
    part = F.pmod(F.shiftrightunsigned("key", 1), F.lit(parts)).cast("int").alias("part")
    dealt = links.select("rid", "key", "times", part, F.pmod("rid", F.lit(leaves)).cast("int").alias("leaf"))
    functions = table.select("*", F.explode(F.sequence(F.lit(0), F.lit(leaves - 1))).alias("leaf"))

    def look(left: pa.Table, right: pa.Table) -> pa.Table:
        own = left.column("key").to_numpy().view(np.uint64)
        row = {c: right.column(c)[0] for c in right.column_names} if len(own) else None
        if row is None:
            return pa.table({c: pa.array([], pa.int64()) for c in ("rid", "b", "times", "n")})
        words, sizes = _function(row)
        index = perfect_hash.Directory([(words, sizes)]).index(own)
        if not np.array_equal(np.frombuffer(row["keys"].as_py(), "<u8")[index], own):
            raise ValueError("a pair that was not counted")
        n = np.frombuffer(row["counts"].as_py(), "<i8")[index]
        return pa.table({"rid": left.column("rid"), "b": pa.array(unmixed(own)[1]), "times": left.column("times"), "n": pa.array(n)})

    found = dealt.groupBy("part", "leaf").cogroup(functions.groupBy("part", "leaf")).applyInArrow(look, "rid long, b long, times long, n long")
    found = found.join(F.broadcast(best), "b")  # a row for each id of one vocabulary at most
    sums = found.groupBy("rid").agg(
        F.sum(F.when(F.col("n") == F.col("most"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("times")).alias("count_sum")
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return whole.join(sums, "rid", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")


def alignment(
    docs: DataFrame, text: str = "text", id_col: str = "doc_id", path_a: str | None = None, path_b: str | None = None, limit: int = BROADCAST, size: int = SLICE
) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for every row of ``docs``.

    The first tokenizer reads space + text, the second puts the blank itself.
    Groups end where tokens of both end; a link is a pair of overlapping
    tokens. ``count_sum`` adds the corpus-wide counts of the links' pairs,
    ``n_best`` counts links whose pair is the most frequent of its second id,
    ties included. Texts that are null, empty or not the same bytes again when
    tokens are joined (U+2581 reads as a blank) have no tokens, zeros and an
    empty digest. Rows that repeat an id are rows like others and count;
    an empty table gives an empty result; further columns are left out, so
    none can clash. Up to ``limit`` distinct pairs are broadcast.
    """
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text).cast("string").alias("text"))
    table, parts, total = counted(pair_counts(plain, path_a, path_b), size)
    best = best_counts(table)
    if total > limit:
        return _joined(_summary(plain, path_a, path_b), table, materialise(best), parts)
    rows = [(bytes(r.words), list(r.sizes), bytes(r["keys"]), bytes(r.counts)) for r in table.orderBy("part").collect()]
    most = [(r.b, r.most) for r in best.collect()]
    shared = docs.sparkSession.sparkContext.broadcast((rows, most))
    return _summary(plain, path_a, path_b, shared, max([b for b, _ in most], default=0) + 1)
