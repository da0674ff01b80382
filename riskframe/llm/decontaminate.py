"""Benchmark decontamination: a broadcast set of the benchmark's word n-grams, scanned over all training text.

The benchmark's vocabulary numbers its words; a document word outside it is 0
and no window crosses it. Windows of numbered words are looked up by a 64-bit
hash and verified word by word. A benchmark whose windows pass ``SLICE`` is
cut into slices by hash; the documents pass one slice after the other, and what
was found is stored in between, so no task holds more than one slice of the set.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskframe.llm.common import fresh, lookup, mix, parts, utf8, with_columns
from riskframe.session import materialise

WINDOW = 10
#: Windows of the benchmark that are broadcast at a time (about 150 bytes each).
SLICE = 500_000
#: Bytes of text looked at together.
STRIDE = 4_000_000

# Words: ASCII digits and letters, lower-cased, and everything beyond ASCII; on UTF-8 bytes the same as on characters.
_WORD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_WORD_CHARS = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_WORD).split()


class Grams:
    """A slice of the benchmark's windows: words by number, windows by hash, items by window."""

    def __init__(self, rows: list[tuple[list[bytes], list]]):
        self.items = [tuple(items) for _, items in rows]
        self.vocabulary = {w: i + 1 for i, w in enumerate(sorted({w for ws, _ in rows for w in ws}))}
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        order = sorted(range(len(rows)), key=lambda i: len(rows[i][0]))
        for n, group in groupby(order, key=lambda i: len(rows[i][0])):
            at = np.array(list(group))
            ids = np.array([[self.vocabulary[w] for w in rows[i][0]] for i in at], np.int64)
            hashes = self.hash(ids)
            by_hash = np.argsort(hashes, kind="stable")
            self.by_length[n] = hashes[by_hash], ids[by_hash], at[by_hash]

    @classmethod
    def of(cls, parts: dict) -> Grams:
        """From the plain parts that were broadcast."""
        grams = cls.__new__(cls)
        grams.__dict__.update(parts)
        return grams

    @staticmethod
    def hash(ids: np.ndarray) -> np.ndarray:
        total = np.zeros(len(ids), np.uint64)
        for i in range(ids.shape[1]):
            total = mix(total + ids[:, i].astype(np.uint64) * np.uint64(2 * i + 1))
        return total

    def hits(self, ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """(positions, windows, length) of the windows that occur in a sequence of word numbers."""
        known = np.concatenate([[0], np.cumsum(ids > 0)])
        for n, (hashes, grams, rows) in self.by_length.items():
            at = np.flatnonzero(known[n:] - known[:-n] == n) if len(ids) >= n else np.zeros(0, np.int64)
            if not len(at):
                continue
            looked = self.hash(ids[at[:, None] + np.arange(n)])
            start, end = np.searchsorted(hashes, looked, "left"), np.searchsorted(hashes, looked, "right")
            for step in range(int((end - start).max())):
                live = np.flatnonzero(end - start > step)
                gram = start[live] + step
                same = (ids[at[live][:, None] + np.arange(n)] == grams[gram]).all(axis=1)
                yield at[live[same]], rows[gram[same]], n


def benchmark_windows(benchmark: DataFrame, item: str = "item_id", text: str = "text", width: int = WINDOW) -> DataFrame:
    """(words, items): each distinct window with the items it comes from. Fewer words than ``width`` are one window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            ids, out = [], []
            for i, raw in enumerate(utf8(b.column(1))):
                w = words(raw)
                n = min(width, len(w))
                for k in range(len(w) - n + 1 if n else 0):
                    ids.append(i)
                    out.append(b" ".join(w[k : k + n]))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(ids, pa.int64())), pa.array(out, pa.binary())], names=["item", "words"])

    plain = benchmark.select(F.col(item).cast("string").alias("item"), F.col(text).cast("string").alias("text"))
    return plain.mapInArrow(run, "item string, words binary").groupBy("words").agg(F.collect_set("item").alias("items"))


_FOUND = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))),
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
)


def _scan(docs: DataFrame, text: str, name: str, grams, so_far: str | None) -> DataFrame:
    """Add (or extend) a column of word spans and items found with the windows of one broadcast slice."""

    def found(raw: list[bytes | None], before: list[dict | None]) -> list[dict]:
        own = Grams.of(grams.value)
        out = []
        start = 0
        while start < len(raw):
            stop, size = start, 0
            while stop < len(raw) and (stop == start or size < STRIDE):
                size += len(raw[stop] or b"")
                stop += 1
            lists = [words(t) for t in raw[start:stop]]
            flat, ends = [], []
            for ws in lists:
                flat += ws
                flat.append(b"")
                ends.append(len(flat))
            ends = np.array(ends)
            spans: dict[int, list] = {}
            items: dict[int, set] = {}
            ids = lookup(flat, own.vocabulary)
            for at, rows, n in own.hits(ids):
                doc = np.searchsorted(ends, at, side="right")
                for p, d, row in zip(at.tolist(), doc.tolist(), rows.tolist()):
                    base = int(ends[d - 1]) if d else 0
                    spans.setdefault(d, []).append([p - base, p - base + n])
                    items.setdefault(d, set()).update(own.items[row])
            for d in range(stop - start):
                old = before[start + d] or {"spans": [], "items": []}
                united = merged([*old["spans"], *spans.get(d, [])])
                out.append({"n_words": len(lists[d]), "spans": united, "items": sorted({*old["items"], *items.get(d, set())})})
            start = stop
        return out

    kind = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.list_(pa.int64()))), ("items", pa.list_(pa.string()))])

    def run(column: pa.Array, *old: pa.Array) -> list[pa.Array]:
        before = old[0].to_pylist() if old else [None] * len(column)
        return [pa.array(found(utf8(column), before), kind)]

    return with_columns(docs, [text, *([so_far] if so_far else [])], [T.StructField(name, _FOUND)], run)


def merged(spans: list[list[int]]) -> list[list[int]]:
    """Overlapping and touching [start, end) spans united, in order."""
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return out


def find(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", width: int = WINDOW, slice_size: int = SLICE
) -> tuple[DataFrame, str]:
    """``docs`` with a struct column of ``spans`` (word positions, [start, end)) and ``items`` (ids as strings), and its name.

    Null and empty texts have no words and no hits. A benchmark without words
    hits nothing. Items may share windows, and ids may repeat.
    """
    grams = materialise(benchmark_windows(benchmark, item, item_text, width))
    slices = max(1, -(-grams.count() // slice_size))
    sc = docs.sparkSession.sparkContext
    (name,) = fresh(docs, "decontamination")
    last = None
    for s in range(slices):
        rows = grams.where(F.pmod(F.xxhash64("words"), F.lit(slices)) == s).collect()
        share = sc.broadcast(vars(Grams([(bytes(r[0]).split(), r[1]) for r in rows])))
        (step,) = fresh(docs, f"slice_{s}_")
        docs = _scan(docs, text, step, share, last)
        docs = docs.drop(last) if last else docs
        if s + 1 < slices:
            docs = materialise(docs)
        last = step
    return docs.withColumnRenamed(last, name), name


def report(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """``docs`` with n_words, n_hit, n_items, items_sha256, contaminated and spans."""
    found, name = find(docs, benchmark, text, **options)
    names = fresh(docs, "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans")
    hit = F.aggregate(f"{name}.spans", F.lit(0).cast("long"), lambda a, s: a + s[1] - s[0])
    listed = F.concat_ws(",", F.array_sort(f"{name}.items"))
    values = [F.col(f"{name}.n_words"), hit, F.size(f"{name}.items").cast("long"), F.sha2(listed, 256), hit > 0, F.col(f"{name}.spans")]
    return found.select(*docs.columns, *[v.alias(n) for v, n in zip(values, names)])


def clean(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", drop_share: float = 0.0, **options
) -> DataFrame:
    """``docs`` without what the benchmark shares with it.

    A document whose share of hit words is above ``drop_share`` is removed;
    from the others the hit spans are cut, with one blank left in their place.
    With the default 0 every hit document goes; with 1 only spans go.
    """
    found, name = find(docs, benchmark, text, **options)
    if drop_share <= 0:
        return found.where(F.size(f"{name}.spans") == 0).select(*docs.columns)

    def cut(column: pa.Array, marks: pa.Array) -> list[pa.Array]:
        out, share = [], []
        for raw, mark in zip(utf8(column), marks.to_pylist()):
            if raw is None or not mark["spans"]:
                out.append(None if raw is None else raw.decode())
                share.append(0.0)
                continue
            value = raw.decode()
            at = [m.span() for m in _WORD_CHARS.finditer(value)]
            share.append(sum(e - s for s, e in mark["spans"]) / len(at))
            for s, e in reversed(mark["spans"]):
                value = value[: at[s][0]] + " " + value[at[e - 1][1] :]
            out.append(value)
        return [pa.array(out, pa.string()), pa.array(share)]

    rest, share = fresh(found, "rest", "share")
    done = with_columns(found, [text, name], [T.StructField(rest, T.StringType()), T.StructField(share, T.DoubleType())], cut)
    done = done.where(F.col(share) <= drop_share).withColumn(text, F.col(rest))
    return done.select(*docs.columns)


def digest(items: list[str]) -> str:
    """What ``items_sha256`` holds for these items."""
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
