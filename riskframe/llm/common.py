"""Small helpers that several operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_GOLDEN, _M1, _M2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """For each name one that no column of ``df`` bears, whatever its case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


#: Rows that Python looks at together; what it holds at a time is bounded by them, not by Spark's batches.
ROWS = 256


def parts(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most ``rows`` rows."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def utf8(column: pa.Array) -> list[bytes | None]:
    """The texts of an Arrow column as UTF-8 bytes, without decoding them."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def with_columns(
    df: DataFrame, read: list[str], fields: list[T.StructField], fn: Callable[..., list[pa.Array]], once: Callable | None = None
) -> DataFrame:
    """``df`` with further columns that ``fn`` makes, batch by batch, of the columns named in ``read``.

    A narrow map: every row stays where it is, with all its columns. What
    ``once`` returns is made once by each task that has rows, and is the first
    argument of all its calls of ``fn``.
    """
    schema = T.StructType([*df.schema.fields, *fields])
    at = [df.columns.index(c) for c in read]
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        for b in parts(batches):
            if once and not held:
                held.append(once())
            yield pa.RecordBatch.from_arrays([*b.columns, *fn(*held, *(b.column(i) for i in at))], names=names)

    return df.mapInArrow(run, schema)


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit integers that spreads every bit (the finaliser of SplitMix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(_M1)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(_M2)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of words, remembered for the most recent ``limit`` of them."""

    def __init__(self, limit: int = 100_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """Fingerprints of every ``k`` consecutive words; fewer words are one window, no word is none."""
    n = len(hashes)
    if n == 0:
        return hashes
    width = min(n, k)
    total = np.full(n - width + 1, (width * _GOLDEN) & 0xFFFFFFFFFFFFFFFF, np.uint64)
    for i in range(width):
        odd = (int(mix(np.uint64([i + 1]))[0]) | 1) & 0xFFFFFFFFFFFFFFFF
        total += mix(hashes[i : n - width + 1 + i] * np.uint64(odd))
    return mix(total)


def lookup(words: list, table: dict) -> np.ndarray:
    """Numbers of words by ``table``; 0 for words it lacks."""
    return np.fromiter(map(table.get, words, repeat(0)), np.int64, len(words))


def id_key(*columns: str):
    """A well-mixed long of a row's identifying columns, nulls included."""
    return F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns])
