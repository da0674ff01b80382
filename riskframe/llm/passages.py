"""Repeated lines, paragraphs and passages: hashed units, the earliest occurrence kept, the rest cut out with offsets.

Units are whole lines and paragraphs of at least ``MIN_LINE`` words, and
windows of ``WINDOW`` words: of any ``SPREAD`` successive windows of a text the
one with the least hash is a unit, wherever the text stands, so a passage of
``WINDOW + SPREAD - 1`` words or more shares a unit with each of its copies,
also in the middle of a line. Digests of units are grouped over the corpus; the
document with the smallest id keeps a unit, in other documents it goes.
Successive windows of a passage overlap or touch; where a run of them ends, it
grows word by word as far as the words are those around the keeper's unit.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskframe.llm import flat
from riskframe.llm.common import LOWER, fresh, mix, utf8
from riskframe.session import materialise

#: Least words of a line or paragraph that goes, and of a passage inside a line.
MIN_LINE, MIN_WORDS = 16, 20
#: Words of a window, and successive windows of which one is a unit (at most as many as a window has words).
WINDOW, SPREAD = 16, 16
#: Keepers' windows up to which they are sent to the texts (about 20 bytes each); beyond it the texts are shuffled to them.
MANY = 1_000_000
#: Kinds of units besides windows, as bits of a place.
LINE, PARAGRAPH = 1 << 28, 1 << 29
_LOWER = np.frombuffer(LOWER, np.uint8)
_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_BASE = 0x9E3779B97F4A7C15  # odd, and 5 modulo 8
_UNBASE = pow(_BASE, -1, 1 << 64)
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
_WORD = re.compile(rb"[^\t-\r ]+")


class Words(NamedTuple):
    """The words of some texts one after another."""

    hashes: np.ndarray
    text: np.ndarray  # the text of each word
    line: np.ndarray  # the number of line ends before it, over all texts
    first: np.ndarray  # edges of the texts among the words


def words_of(data: np.ndarray, edges: np.ndarray) -> Words:
    """Lower-cased words (ASCII) between ASCII blanks of the texts between ``edges``."""
    data = _LOWER[data]
    starts, ends = flat.runs(~_BLANK[data], edges)
    codes, distinct = flat.numbered(data, starts, ends)
    own = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in distinct.to_pylist()), np.uint64, len(distinct))
    line = np.cumsum(data == 10)[starts] if len(starts) else np.zeros(0, np.int64)
    return Words(own[codes], np.searchsorted(edges, starts, side="right") - 1, line, np.searchsorted(starts, edges))


class Sums:
    """Hashes of any stretches of words by differences of sums: a stretch has the same hash wherever it stands."""

    def __init__(self, hashes: np.ndarray):
        n = len(hashes)
        power = lambda b: np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(n - 1, 0), b, np.uint64)]))[:n]
        self.unpower = power(np.uint64(_UNBASE))
        self.total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(hashes) * power(np.uint64(_BASE)))])

    def of(self, start: np.ndarray, end: np.ndarray, kind: int) -> np.ndarray:
        spread = (self.total[end] - self.total[start]) * self.unpower[start]
        return mix(spread + ((end - start).astype(np.uint64) * np.uint64(2) + np.uint64(1)) * np.uint64(kind))


def _sliding(f, x: np.ndarray, n: int) -> np.ndarray:
    """``f`` over every ``n`` successive values."""
    done = 1
    while done < n:
        step = min(done, n - done)
        x = f(x[:-step], x[step:])
        done += step
    return x


def units(words: Words, min_line: int = MIN_LINE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(digest, text, place) of every unit; the place is the unit's first word in its text, with the bit of its kind."""
    h, text, line, first = words
    n = len(h)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    sums, out = Sums(h), []
    if n >= WINDOW:
        at = np.arange(n - WINDOW + 1)
        x = sums.of(at, at + WINDOW, 3)
        x[text[at] != text[at + WINDOW - 1]] = _NONE
        around = np.concatenate([np.full(SPREAD - 1, _NONE), x, np.full(SPREAD - 1, _NONE)])
        least = _sliding(np.minimum, around, SPREAD)  # of the windows i - SPREAD + 1 to i
        # a window is a unit if it is the least of some stretch that it stands in, though not of empty ones
        chosen = (_sliding(np.maximum, np.where(least == _NONE, np.uint64(0), least), SPREAD) == x) & (x != _NONE)
        out.append((x[chosen], at[chosen], 0))
    new_text = np.append(True, text[1:] != text[:-1])
    for kind, begins in ((LINE, new_text | np.append(True, line[1:] != line[:-1])), (PARAGRAPH, new_text | np.append(True, line[1:] - line[:-1] > 1))):
        start = np.flatnonzero(begins)
        end = np.append(start[1:], n)
        keep = end - start >= min_line
        if kind == PARAGRAPH:  # one of a single line is that line
            keep &= line[end - 1] > line[start]
        out.append((sums.of(start[keep], end[keep], kind), start[keep], kind))
    digest = np.concatenate([d for d, _, _ in out])
    at = np.concatenate([a for _, a, _ in out])
    kind = np.concatenate([np.full(len(a), k) for _, a, k in out])
    return digest, text[at], (at - first[text[at]]) | kind


def again(digest: np.ndarray, text: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Which units repeat one that stands earlier in the same text without overlapping it."""
    order = np.lexsort((place, digest, text))
    d, t, p = digest[order], text[order], place[order]
    new = np.append(True, (d[1:] != d[:-1]) | (t[1:] != t[:-1]))[: len(d)]
    begin = p[np.maximum.accumulate(np.where(new, np.arange(len(d)), 0))] if len(d) else p
    out = np.zeros(len(digest), bool)
    out[order] = ~new & ((p >= LINE) | (p - begin >= WINDOW))
    return out


def _parts(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, Words]]:
    for batch in flat.slices(batches, column):
        yield batch, words_of(*flat.flat(batch.column(column)))


def _emitted(docs: DataFrame, min_line: int) -> DataFrame:
    """(digest, doc_id, at, later): every unit; ``later``: its document has the same earlier on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, words in _parts(batches, 1):
            digest, text, place = units(words, min_line)
            later = again(digest, text, place)
            columns = [pa.array(digest.view(np.int64)), batch.column(0).take(pa.array(text)), pa.array(place.astype(np.int32)), pa.array(later)]
            yield pa.RecordBatch.from_arrays(columns, names=["digest", "doc_id", "at", "later"])

    return docs.mapInArrow(run, "digest long, doc_id long, at int, later boolean")


def runs_of(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last window of each run of sorted windows that overlap or touch, as positions in ``places``."""
    cut = np.append(True, np.diff(places) > WINDOW)[: len(places)]
    return np.flatnonzero(cut), np.append(np.flatnonzero(cut)[1:], len(places))[: int(cut.sum())] - 1


def _edges(by_doc: DataFrame) -> DataFrame:
    """(doc_id, digest, at, side): the windows at the ends of the runs that go; side 0 grows to the left, 1 to the right."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [])
            for row in range(batch.num_rows):
                marks = batch.column(1)[row].values
                at, digest = (marks.field(i).to_numpy() for i in (0, 1))
                window = at < LINE
                order = np.argsort(at[window], kind="stable")
                at, digest = at[window][order], digest[window][order]
                for side, ends in enumerate(runs_of(at) if len(at) else ()):
                    out[0].append(np.full(len(ends), row))
                    out[1].append(digest[ends])
                    out[2].append(at[ends])
                    out[3].append(np.full(len(ends), side, np.int32))
            rows, digest, at, side = (np.concatenate([np.zeros(0, np.int64), *x]) for x in out)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows)), pa.array(digest.astype(np.int64)), pa.array(at.astype(np.int32)), pa.array(side.astype(np.int32))],
                names=["doc_id", "digest", "at", "side"],
            )

    return by_doc.mapInArrow(run, "doc_id long, digest long, at int, side int")


def _surroundings(docs: DataFrame, keepers: DataFrame) -> DataFrame:
    """(digest, before, after): hashes of the words next to the window ``at`` of each of ``keepers`` (doc_id, digest, at).

    Both lists begin beside the window and end with the text or after ``SPREAD`` words.
    """
    keepers = materialise(keepers)
    wanted = keepers.groupBy("doc_id").agg(F.collect_list(F.struct("at", "digest")).alias("marks"))
    texts = docs.join(F.broadcast(wanted) if keepers.count() <= MANY else wanted, "doc_id").select("text", "marks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, words in _parts(batches, 0):
            h = words.hashes.view(np.int64)
            out: tuple[list, ...] = ([], [], [])
            for row in range(batch.num_rows):
                own = h[words.first[row] : words.first[row + 1]]
                marks = batch.column(1)[row].values
                for at, digest in zip(marks.field(0).to_pylist(), marks.field(1).to_pylist()):
                    out[0].append(digest)
                    out[1].append(own[max(0, at - SPREAD) : at][::-1].tolist())
                    out[2].append(own[at + WINDOW : at + WINDOW + SPREAD].tolist())
            lists = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], lists), pa.array(out[2], lists)], names=["digest", "before", "after"])

    return texts.mapInArrow(run, "digest long, before array<long>, after array<long>").dropDuplicates(["digest"])


def without_repeats(
    docs: DataFrame, text: str = "text", id_col: str = "doc_id", min_words: int = MIN_WORDS, min_line: int = MIN_LINE
) -> DataFrame:
    """``docs`` with repeated lines, paragraphs and passages cut from its text, ``kept`` and ``removed``.

    Both list [start, stop) in characters of the original text. A line or
    paragraph goes if it has ``min_line`` words, a passage inside lines if it
    has ``min_words``; passages are found from 31 words on. Ids name
    documents and rank them; rows that repeat an id are treated alike, rows
    with a null id are only compared within themselves. Null texts stay null;
    of an exact copy nothing is left if it has ``min_line`` words. Words are
    compared by 64-bit hashes, in lower case (ASCII), whatever the blanks
    between them. Clashing names get new columns with ``_`` appended.
    """
    plain = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text")).where("doc_id IS NOT NULL")
    emitted = _emitted(plain, min_line)
    counts = emitted.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.bool_or("later").alias("inside"))
    # stored, so that Spark sees two plain shuffles in the join and can split a digest that very many documents have
    repeated = materialise(counts.where("first < last OR inside").select("digest", "first"))
    held = materialise(emitted.join(repeated, "digest"))
    goes = held.where("doc_id > first OR later")
    by_doc = materialise(goes.groupBy("doc_id").agg(F.collect_list(F.struct("at", "digest")).alias("marks")))
    edges = materialise(_edges(by_doc))
    keepers = held.where(f"doc_id = first AND NOT later AND at < {LINE}").join(edges.select("digest").distinct(), "digest", "left_semi")
    keepers = keepers.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.min("at").alias("at"))
    around = materialise(_surroundings(plain, keepers))
    beside = F.when(F.col("side") == 0, F.col("before")).otherwise(F.col("after"))
    grown = edges.join(around, "digest").groupBy("doc_id").agg(F.collect_list(F.struct("at", "side", beside.alias("words"))).alias("edges"))
    key, marks, ends, new, kept, removed = fresh(docs, "key_", "marks_", "edges_", "new_text_", "kept", "removed")
    found = by_doc.join(grown, "doc_id", "left").select(F.col("doc_id").alias(key), F.col("marks.at").alias(marks), F.col("edges").alias(ends))
    joined = docs.join(found, F.col(f"`{id_col}`").cast("long") == F.col(key), "left")
    spans = T.ArrayType(T.ArrayType(T.LongType()))
    schema = T.StructType([*joined.schema.fields, T.StructField(new, T.StringType()), T.StructField(kept, spans), T.StructField(removed, spans)])
    names, at_text, at_marks, at_ends, at_id = [f.name for f in schema.fields], *(joined.columns.index(c) for c in (text, marks, ends, id_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in flat.slices(batches, at_text):
            out: tuple[list, ...] = ([], [], [])
            for row, raw in enumerate(utf8(batch.column(at_text))):
                own, grow, gone = batch.column(at_marks)[row], batch.column(at_ends)[row], []
                if raw is not None and (own.is_valid or not batch.column(at_id)[row].is_valid):
                    places = own.values.to_numpy() if own.is_valid else None
                    gone = repeats(raw, places, grow.as_py() or [], min_words, min_line)
                value = None if raw is None else raw.decode()
                cuts = [0, *(x for s in gone for x in s), len(value or "")]
                stay = [[a, b] for a, b in zip(cuts[::2], cuts[1::2]) if b > a]
                for column, x in zip(out, (None if value is None else "".join(value[a:b] for a, b in stay), stay, gone)):
                    column.append(x)
            kind = pa.list_(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out[0], pa.string()), pa.array(out[1], kind), pa.array(out[2], kind)], names=names)

    done = joined.mapInArrow(run, schema)
    return done.select(*[F.col(new).alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns], kept, removed)


def repeats(raw: bytes, places: np.ndarray | None, grow: list[dict], min_words: int = MIN_WORDS, min_line: int = MIN_LINE) -> list[list[int]]:
    """[start, stop) in characters of what goes from a text.

    ``places`` are the units that go (None: those that the text itself has
    earlier on); ``grow`` has at, side and the hashes of the keeper's words
    beside a window.
    """
    data = np.frombuffer(raw, np.uint8)
    words = words_of(data, np.array([0, len(data)]))
    n = len(words.hashes)
    if places is None:
        digest, text, place = units(words, min_line)
        places = place[again(digest, text, place)]
    if not n or not len(places):
        return []
    whole, inside = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
    for kind, least in ((LINE, 0), (PARAGRAPH, 1)):
        start = places[(places & kind) > 0] & (LINE - 1)
        begins = np.flatnonzero(np.append(True, words.line[1:] - words.line[:-1] > least))
        end = np.append(begins, n)[np.searchsorted(begins, start, side="right")]
        np.add.at(whole, start, 1)
        np.add.at(whole, end, -1)
    start = places[places < LINE]
    np.add.at(inside, start, 1)
    np.add.at(inside, start + WINDOW, -1)
    h = words.hashes.view(np.int64)
    for edge in grow:
        other = np.array(edge["words"] or [], np.int64)
        at = edge["at"]
        own = h[max(0, at - len(other)) : at][::-1] if edge["side"] == 0 else h[at + WINDOW : at + WINDOW + len(other)]
        other = other[: len(own)]
        same = int(np.argmin(np.append(own == other, False)))
        begin = at - same if edge["side"] == 0 else at + WINDOW
        inside[begin] += 1
        inside[begin + same] -= 1
    whole, inside = np.cumsum(whole[:-1]) > 0, np.cumsum(inside[:-1]) > 0
    goes = whole | inside
    edges = np.flatnonzero(np.diff(np.concatenate([[0], goes.astype(np.int8), [0]])))
    spans = [m.span() for m in _WORD.finditer(raw)]
    out, at, chars = [], 0, 0
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
        if b - a < min_words:  # too short for a passage: whole lines and paragraphs only
            part = np.flatnonzero(np.diff(np.concatenate([[0], whole[a:b].astype(np.int8), [0]]))) + a
        else:
            part = np.array([a, b])
        for s, e in zip(part[::2].tolist(), part[1::2].tolist()):
            pair = []
            for place in (spans[s][0], spans[e - 1][1]):
                chars += len(raw[at:place].decode())
                at = place
                pair.append(chars)
            out.append(pair)
    return out
