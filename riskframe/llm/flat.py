"""Texts as flat byte arrays: words are cut, numbered and looked up without a Python step for each occurrence."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa

#: Bytes and rows that Python works on at a time; a single longer text is cut where ``BREAK`` allows.
STRETCH, ROWS = 1 << 20, 4096
#: A blank between ASCII letters or digits: no token and no word of any operator here reaches over its start.
BREAK = re.compile(rb"(?<=[A-Za-z0-9])(?= [A-Za-z0-9])")


def slices(batches: Iterator[pa.RecordBatch], column: int, limit: int = STRETCH, rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most ``limit`` bytes in a string column, or of one row."""
    for batch in batches:
        sizes = np.diff(flat(batch.column(column))[1])
        at = 0
        while at < batch.num_rows:
            total = np.cumsum(sizes[at : at + rows])
            n = max(1, int(np.searchsorted(total, limit, side="right")))
            yield batch.slice(at, n)
            at += n


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after another and the edges between them; a null is an empty text."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, edges, data = column.buffers()
    if len(column) == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    edges = np.frombuffer(edges, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[edges[0] : edges[-1]], edges - edges[0]


def chunks(text: bytes, limit: int = STRETCH) -> Iterator[bytes]:
    """A text cut at breaks into parts of about ``limit`` bytes; without a break it stays whole."""
    at = 0
    while len(text) - at > limit and (found := BREAK.search(text, at + limit)):
        yield text[at : found.start()]
        at = found.start()
    yield text[at:]


def runs(inside: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True, which also end at ``edges``."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.zeros(len(inside) + 1, bool)
    cut[edges] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | cut[1:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | cut[1:-1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def numbered(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """The number of each word (bytes ``starts`` to ``ends``) among the distinct ones, and these."""
    if not len(starts):
        return np.zeros(0, np.int64), pa.array([], pa.large_binary())
    if not np.array_equal(starts[1:], ends[:-1]):  # gaps between words go
        data, ends = data[indices(starts, ends - starts)], np.cumsum(ends - starts)
        edges = np.concatenate([[0], ends])
    else:
        edges = np.append(starts, ends[-1])
    words = pa.Array.from_buffers(
        pa.large_binary(), len(starts), [None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]
    ).dictionary_encode()
    return words.indices.to_numpy(zero_copy_only=False).astype(np.int64), words.dictionary


def indices(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[i], start[i] + 1, ... (``count[i]`` of them) for each i, one after another."""
    ends = np.cumsum(count)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - count), count)


class Remembered(dict):
    """Packed ids of words, made by ``make`` for many new words at once; starts anew when it holds ``limit`` words.

    It lives as long as a task.
    """

    def __init__(self, make: Callable[[list[bytes]], list[bytes]], limit: int = 100_000, step: int = 5_000):
        super().__init__()
        self.make, self.limit, self.step = make, limit, step

    def of(self, words: list[bytes]) -> list[bytes]:
        """The packed ids of distinct words."""
        held = list(map(self.get, words))
        new = [i for i, ids in enumerate(held) if ids is None]
        if len(self) + len(new) > self.limit:
            self.clear()
            self.update(islice(((w, ids) for w, ids in zip(words, held) if ids is not None), self.limit))
        for at in range(0, len(new), self.step):
            some = [words[i] for i in new[at : at + self.step]]
            made = self.make(some)
            for i, ids in zip(new[at : at + self.step], made):
                held[i] = ids
            self.update(islice(zip(some, made), max(0, self.limit - len(self))))
        return held

    def tokens(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in order (unsigned 32 bit), and how many ids each word has."""
        codes, words = numbered(data, starts, ends)
        known = self.of(words.to_pylist())
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // 4
        pool = np.frombuffer(b"".join(known), "<u4")
        counts = sizes[codes]
        return pool[indices((np.cumsum(sizes) - sizes)[codes], counts)], counts


def spread(total: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Sums of ``total`` between successive edges."""
    ends = np.concatenate([[0], np.cumsum(total)])
    return ends[edges[1:]] - ends[edges[:-1]]
