"""Importance resampling towards a target's distribution of hashed features.

Features (runs of words) are hashed to buckets by CRC-32. Within a task the
distinct features of a slice of texts are grouped by length into
two-dimensional byte matrices whose checksums advance column by column, all
rows at once; the buckets are then scattered back to the occurrences. Counts
per bucket are added up in the tasks and then over them; what reaches the
driver is one number per bucket. A document's weight is the sum of its
features' gains, a Gumbel draw by its id makes the sample, and the places of
the sample come from one sort by ranges.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskframe.llm import flat
from riskframe.session import materialise

GRAMS, BUCKETS, PERCENT, LEAST, SEED = 1, 10_000, 10, 20, 2024
#: Features longer than this are hashed one by one.
LONG = 256
#: Bytes of a word (digits, letters, all beyond ASCII), and each byte in lower case (A-Z only).
_WORD = np.array([48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c >= 128 for c in range(256)])
_LOW = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)


def crc_steps() -> np.ndarray:
    """The 256 steps of CRC-32 (polynomial 0xEDB88320, bits reflected)."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, (step >> 1) ^ np.uint32(0xEDB88320), step >> 1)
    return step


_STEPS = crc_steps()


def checksums(words: pa.Array) -> np.ndarray:
    """CRC-32 of each byte string: those of one length form a matrix, which is worked off column by column."""
    data, edges = flat.flat(words)
    size = np.diff(edges)
    out = np.zeros(len(size), np.uint32)
    order = np.argsort(size, kind="stable")
    lengths, first = np.unique(size[order], return_index=True)
    for n, rows in zip(lengths.tolist(), np.split(order, first[1:])):
        if n > LONG:
            out[rows] = [zlib.crc32(data[edges[r] : edges[r] + n]) for r in rows.tolist()]
            continue
        matrix = data[edges[rows][:, None] + np.arange(n)]
        crc = np.full(len(rows), 0xFFFFFFFF, np.uint32)
        for column in range(n):
            crc = _STEPS[(crc ^ matrix[:, column]) & 0xFF] ^ (crc >> np.uint32(8))
        out[rows] = ~crc
    return out


def features(data: np.ndarray, edges: np.ndarray, grams: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text) of every feature of the texts between ``edges``: all runs of 1 to ``grams`` consecutive words."""
    data = _LOW[data]
    starts, ends = flat.runs(_WORD[data], edges)
    codes, words = flat.numbered(data, starts, ends)
    text = np.searchsorted(edges, starts, side="right") - 1
    found, rows = [(checksums(words) % np.uint32(buckets)).astype(np.int64)[codes]], [text]
    listed = words.to_pylist() if grams > 1 else []
    for n in range(2, grams + 1):
        whole = text[: len(text) - n + 1] == text[n - 1 :]
        runs = np.stack([codes[k : len(codes) - n + 1 + k][whole] for k in range(n)], axis=1) if len(codes) >= n else np.zeros((0, n), np.int64)
        distinct, place = np.unique(runs, axis=0, return_inverse=True)
        joined = pa.array([b" ".join([listed[c] for c in run]) for run in distinct.tolist()], pa.large_binary())
        found.append((checksums(joined) % np.uint32(buckets)).astype(np.int64)[place.ravel()])
        rows.append(text[: len(text) - n + 1][whole] if len(codes) >= n else np.zeros(0, np.int64))
    return np.concatenate(found), np.concatenate(rows)


def _parts(column: pa.Array, grams: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The bytes and edges of a slice; a single very long text in parts that no feature spans."""
    data, edges = flat.flat(column)
    if len(column) > 1 or len(data) <= flat.STRETCH or grams > 1:
        yield data, edges
        return
    for part in flat.chunks(data.tobytes()):
        yield np.frombuffer(part, np.uint8), np.array([0, len(part)])


def bucket_counts(texts: DataFrame, grams: int = GRAMS, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): how many features of column ``text`` fall into each bucket that has any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in flat.slices(batches, 0):
            for data, edges in _parts(batch.column(0), grams):
                total += np.bincount(features(data, edges, grams, buckets)[0], minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(total[held])], names=["bucket", "n"])

    own = texts.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "bucket int, n long")
    return own.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: dict[int, int], target: dict[int, int], buckets: int = BUCKETS) -> np.ndarray:
    """floor(1000 ln of the smoothed share of the target over that of the source) for each bucket."""
    all_s, all_t = sum(source.values()), sum(target.values())
    share = lambda b: (target.get(b, 0) + 1) * (all_s + buckets) / ((source.get(b, 0) + 1) * (all_t + buckets))
    return np.array([math.floor(1000 * math.log(share(b))) for b in range(buckets)], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, grams: int = GRAMS) -> DataFrame:
    """(doc_id, n_features, weight, n_words) of every row of ``docs`` (doc_id, text)."""
    buckets = len(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in flat.slices(batches, 1):
            n = batch.num_rows
            count, weight, words = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
            for data, edges in _parts(batch.column(1), grams):
                bucket, row = features(data, edges, grams, buckets)
                np.add.at(weight, row, gain[bucket])
                own = np.bincount(row, minlength=n)
                count += own
                words += own if grams == 1 else np.bincount(_first(data, edges), minlength=n)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *map(pa.array, (count, weight, words))], names=["doc_id", "n_features", "weight", "n_words"]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, n_features long, weight long, n_words long")


def _first(data: np.ndarray, edges: np.ndarray) -> np.ndarray:
    starts, _ = flat.runs(_WORD[data], edges)
    return np.searchsorted(edges, starts, side="right") - 1


def draw(doc_id: Column, seed: int = SEED) -> Column:
    """floor of 1000 times a Gumbel variate fixed by the id and ``seed``; a null id draws like an empty one."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def resample(
    docs: DataFrame,
    target: DataFrame,
    text: str = "text",
    id_col: str = "doc_id",
    grams: int = GRAMS,
    buckets: int = BUCKETS,
    percent: int = PERCENT,
    least: int = LEAST,
    seed: int = SEED,
) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of ``docs``; ``rank`` is null for what is not drawn.

    Of the rows with at least ``least`` words, ``percent`` in a hundred
    (rounded down) with the highest scores are drawn, ties to the smaller id;
    ``rank`` counts them 1, 2, 3, ... in that order. Null, empty and wordless
    texts have no feature and a weight of 0; rows that repeat an id draw alike
    and are ranked in any order among themselves; a null id comes last among
    ties; empty tables give empty results; further columns are left out, so
    none can clash.
    """
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text).cast("string").alias("text"))
    aimed = target.select(F.col(text).cast("string").alias("text"))
    seen = {r["bucket"]: r["n"] for r in bucket_counts(plain, grams, buckets).collect()}
    wanted = {r["bucket"]: r["n"] for r in bucket_counts(aimed, grams, buckets).collect()}
    scored = weighed(plain, gains(seen, wanted, buckets), grams)
    may = (F.col("n_words") >= least).alias("may")
    scored = materialise(scored.select("doc_id", "n_features", "weight", (F.col("weight") + draw(F.col("doc_id"), seed)).alias("score"), may))
    quota = scored.where("may").count() * percent // 100
    order = [F.col("may").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("at").asc()]
    marked = scored.withColumn("at", F.monotonically_increasing_id())
    placed = materialise(marked.repartitionByRange(*order).sortWithinPartitions(*order).drop("at"))
    place = placed.withColumn("at", F.monotonically_increasing_id())
    place = place.withColumn("part", F.shiftright("at", 33)).withColumn("inside", F.col("at").bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = sorted((r["part"], r["n"]) for r in place.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect())
    before, offsets = 0, []
    for part, n in sizes:
        offsets.append((part, before))
        before += n
    begun = docs.sparkSession.createDataFrame(offsets, "part long, before long")
    rank = F.col("before") + F.col("inside") + 1
    ranked = place.join(F.broadcast(begun), "part")
    return ranked.select("doc_id", "n_features", "weight", "score", F.when(rank <= quota, rank).cast("long").alias("rank"))
