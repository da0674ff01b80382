"""Near-duplicate groups by SuperMinHash signatures, banding, exact verification and union-find.

Documents of the same word sequence form a class; a class is signed once. A
signature comes from permutation ranks that are drawn per shingle without
replacement (each shingle offers its rank j at the j-th place of its own
permutation), so ranks already held by every place stop the work early.
Signatures are cut into bands; classes that share a band are compared with the
band's smallest class on their full shingle sets. What did not link there is
compared with the other members of that class's bands, block by block, as far
as the triangle inequality of the Jaccard distance leaves a link possible.
Links are united by components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.llm.common import LOWER, WordHashes, fresh, mix, parts, utf8, windows
from riskframe.llm.graph import Forest, components, unite
from riskframe.session import materialise

SHINGLE = 5
#: 32 bands of 6: a pair at a similarity of 0.85 shares no band with a chance of 3e-7, one at 0.8 of 6e-5.
BANDS, ROWS = 32, 6
#: Shingles signed at a time, and members compared with one centre in a run of rows.
CHUNK, RUN = 16_384, 256
#: Documents and shingles of a block, and shingles multiplied at a time.
BLOCK, BLOCK_SHINGLES, STRETCH = 256, 400_000, 8192
_LOW = np.uint64(0xFFFFFFFF)


def superminhash(x: np.ndarray, places: int) -> np.ndarray:
    """Signature of the set of 64-bit elements ``x``: per place the least (rank, random tie-break).

    For each element the ranks 0, 1, ... fall on the places in a random order
    of its own, drawn step by step (Fisher-Yates); place p holds the least
    rank, with a random fraction, that any element put there. When all places
    hold a rank below j, later steps change nothing.
    """
    held = np.full(places, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(x), CHUNK):
        part = x[start : start + CHUNK]
        rows = np.arange(len(part))
        order = None
        first = None
        for j in range(places):
            if int(held.max()) >> 32 < j:
                break
            drawn = mix(part + np.uint64(((j + 1) * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF))
            k = (j + (((drawn & _LOW) * np.uint64(places - j)) >> np.uint64(32))).astype(np.int64)
            if j == 0:
                first = slot = k
            else:
                if order is None:
                    order = np.tile(np.arange(places, dtype=np.int16), (len(part), 1))
                    order[rows, first] = 0
                    order[:, 0] = first
                slot = order[rows, k]
                order[rows, k] = order[:, j]
                order[:, j] = slot
            np.minimum.at(held, slot, (np.uint64(j) << np.uint64(32)) | (drawn >> np.uint64(32)))
    return held


def band_keys(signature: np.ndarray, bands: int) -> np.ndarray:
    """One 64-bit key per band; equal only if the band's places are equal, but for a chance of about 1e-19."""
    parts = signature.reshape(bands, -1)
    total = np.arange(1, bands + 1, dtype=np.uint64)
    for i in range(parts.shape[1]):
        total = mix(total * np.uint64(0x9E3779B97F4A7C15) + mix(parts[:, i]))
    return total.view(np.int64)


def shingle_set(text: bytes | None, hashes: WordHashes, k: int = SHINGLE) -> np.ndarray:
    """Sorted 64-bit fingerprints of the distinct ``k``-word shingles; words end at ASCII white space."""
    return np.unique(windows(hashes.of((text or b"").translate(LOWER).split()), k))


def signed(docs: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, digest of the word sequence, n_shingles, bands); digest and bands are null without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in parts(batches):
            digests, sizes, keys = [], [], []
            for text in utf8(batch.column(1)):
                words = (text or b"").translate(LOWER).split()
                digests.append(xxhash.xxh3_128_digest(b" ".join(words)) if words else None)
                x = np.unique(windows(hashes.of(words), k))
                sizes.append(len(x))
                keys.append(band_keys(superminhash(x, bands * rows), bands) if words else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64()))],
                names=["doc_id", "digest", "n", "bands"],
            )

    return docs.mapInArrow(run, "doc_id long, digest binary, n long, bands array<long>")


def verified(docs: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """(a, b, common, total) for each pair: sizes of intersection and union of the two full shingle sets.

    A run of rows has one centre's text first and then up to about ``RUN``
    members; a task holds the centre's set and one member's at a time.
    """
    runs = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / RUN).alias("runs"))
    dealt = pairs.join(runs, "a").withColumn("run", F.pmod(F.xxhash64("b"), F.col("runs")))
    members = dealt.select(F.col("b").alias("doc_id"), "a", "run", F.lit(1).alias("role"))
    centres = runs.select(
        F.col("a").alias("doc_id"), "a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("runs") - 1)).alias("run"), F.lit(0).alias("role")
    )
    texts = docs.select("doc_id", "text").join(members.union(centres), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        at, centre = None, None
        for batch in parts(batches):
            out: tuple[list, ...] = ([], [], [], [])
            ids, a, part, role = (batch.column(i).to_pylist() for i in (0, 2, 3, 4))
            for i, text in enumerate(utf8(batch.column(1))):
                x = shingle_set(text, hashes, k)
                if role[i] == 0:
                    at, centre = (a[i], part[i]), x
                elif at == (a[i], part[i]):
                    common = len(np.intersect1d(centre, x, assume_unique=True))
                    for column, value in zip(out, (a[i], ids[i], common, len(centre) + len(x) - common)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["a", "b", "common", "total"])

    together = texts.repartition("a", "run").sortWithinPartitions("a", "run", "role")
    return together.mapInArrow(run, "a long, b long, common long, total long")


def linked_in_blocks(docs: DataFrame, members: DataFrame, k: int, percent: int) -> DataFrame:
    """(a, b): a forest of the links inside each group of ``members`` (grp, doc_id, n).

    A group is dealt into blocks of bounded rows and shingles; each pair of
    blocks is compared in one task by matrix products of set membership, and
    only united links leave it, so nothing emitted grows with the square of a
    group.
    """
    size = members.groupBy("grp").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).alias("blocks"))
    dealt = members.join(size, "grp").withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("blocks")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")
    dealt = dealt.select("doc_id", "grp", "own", other)
    dealt = dealt.select("doc_id", "grp", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    texts = docs.select("doc_id", "text").join(dealt, "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        at, held = None, []

        def give() -> pa.RecordBatch:
            forest = Forest()
            for x, y in block_links([h for h in held if h[1] == at[1]], [h for h in held if h[1] == at[2]], at[1] == at[2], percent):
                forest.join(x, y)
            nodes = list(forest.parent)
            return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([forest.find(x) for x in nodes], pa.int64())], names=["a", "b"])

        for batch in parts(batches):
            ids, groups, own, i, j = (batch.column(c).to_pylist() for c in (0, 2, 3, 4, 5))
            for r, text in enumerate(utf8(batch.column(1))):
                if at != (groups[r], i[r], j[r]):
                    if held:
                        yield give()
                    at, held = (groups[r], i[r], j[r]), []
                held.append((ids[r], own[r], shingle_set(text, hashes, k)))
        if held:
            yield give()

    together = texts.repartition("grp", "i", "j").sortWithinPartitions("grp", "i", "j")
    return together.mapInArrow(lambda batches: unite(run(batches)), "u long, v long").toDF("a", "b")


def block_links(left: list[tuple], right: list[tuple], same: bool, percent: int) -> Iterator[tuple[int, int]]:
    """Linked pairs of (id, block, set) rows of two blocks; all intersections at once, a stretch of shingles at a time."""
    if not left or not right:
        return
    sides = [left] if same else [left, right]
    values = np.concatenate([x for side in sides for _, _, x in side])
    _, number = np.unique(values, return_inverse=True)
    rows = np.repeat(np.arange(sum(map(len, sides))), [len(x) for side in sides for _, _, x in side])
    order = np.argsort(number, kind="stable")
    number, rows = number[order], rows[order]
    n_left, total = len(left), int(number[-1]) + 1 if len(number) else 0
    common = np.zeros((n_left, len(right)), np.float32)
    edges = np.searchsorted(number, np.arange(0, total + STRETCH, STRETCH))
    for c, (s, e) in enumerate(zip(edges, edges[1:])):
        held = np.zeros((sum(map(len, sides)), STRETCH), np.float32)
        held[rows[s:e], number[s:e] - c * STRETCH] = 1
        common += held[:n_left] @ (held if same else held[n_left:]).T
    common = common.astype(np.int64)
    size = lambda side: np.array([len(x) for _, _, x in side])
    union = size(left)[:, None] + size(right)[None, :] - common
    hit = (100 * common >= percent * union) & (common > 0)
    if same:
        hit = np.triu(hit, 1)
    for x, y in zip(*np.nonzero(hit)):
        yield left[x][0], right[y][0]


def near_duplicates(
    docs: DataFrame, text: str = "text", id_col: str = "doc_id", k: int = SHINGLE, percent: int = 85, bands: int = BANDS, rows: int = ROWS
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``.

    Two documents link when 100 * intersection >= ``percent`` * union of their
    shingle sets; ``component_id`` is the smallest id reachable over links and
    ``kept`` marks the document that bears it. Sets are 64-bit fingerprints of
    shingles. Null, empty and blank texts have no shingle and link with
    nothing; an empty table gives an empty result. Ids name documents: rows
    that repeat an id get equal results, and a null id links with nothing.
    """
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    marks = materialise(signed(plain, k, bands, rows))
    known = marks.where("digest IS NOT NULL AND doc_id IS NOT NULL")
    classes = materialise(known.groupBy("digest").agg(F.min("doc_id").alias("rep")))
    keys = materialise(
        known.join(classes.withColumnRenamed("digest", "own"), F.col("doc_id") == F.col("rep"), "left_semi")
        .select(F.explode("bands").alias("key"), F.col("doc_id").alias("b"))
    )
    centres = keys.groupBy("key").agg(F.min("b").alias("a"), F.max("b").alias("last")).where("a < last").drop("last")
    starred = materialise(keys.join(centres, "key").where("a < b").select("key", "a", "b"))
    tested = materialise(verified(plain, starred.select("a", "b").distinct(), k))
    link = F.expr(f"100 * common >= {percent} * total")
    united = components(tested.where(link).select("a", "b"))

    # Members that did not link with their centre may link with one another, or with those that did and lie near enough.
    reach = 1 - percent / 100 + 1e-9
    far = tested.select("a", "b", (1 - F.col("common") / F.col("total")).alias("d"), link.alias("linked"))
    open_groups = far.where("NOT linked").groupBy("a").agg(F.min("d").alias("least"))
    members = far.join(open_groups, "a").where(f"NOT linked OR d >= least - {reach}").select(F.col("a").alias("grp"), F.col("b").alias("doc_id"))
    crowd = members.groupBy("grp").agg(F.count(F.lit(1)).alias("crowd")).where("crowd > 1")
    sizes = known.groupBy("doc_id").agg(F.max("n").alias("n"))
    members = materialise(members.join(crowd, "grp").join(sizes, "doc_id").select("grp", "doc_id", "n"))
    if not members.isEmpty():
        # stored, so that no task keeps one Python worker for the blocks and one for the components
        more = materialise(linked_in_blocks(plain, members, k, percent))
        united = components(more.union(united.select("node", "component")))

    rep, comp, own = fresh(marks, "rep", "component", "own")
    whole = (
        marks.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("digest", F.concat(F.lit("-"), F.col("doc_id").cast("string")).cast("binary")).alias(own))
        .join(classes.select(F.col("digest").alias(own), F.col("rep").alias(rep)), own, "left")
        .join(united.select(F.col("node").alias(rep), F.col("component").alias(comp)), rep, "left")
    )
    return whole.select(
        "doc_id", "n_shingles", F.coalesce(comp, rep, "doc_id").alias("component_id")
    ).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
