"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns many points of a ring; a key belongs to the next point
clockwise. A shard takes no more than its bound; keys beyond it continue
clockwise to the next point whose shard still has room. With the bound at the
mean, row counts differ by one at most.

Only the counts per arc (shards x points, a fixed number) reach the driver,
where the flow from arc to shard is settled; the rows get their place by their
rank inside their arc.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.llm.common import fresh
from riskframe.llm.ranks import LEAST_ROWS, ranked
from riskframe.session import materialise

POINTS = 128
#: Positions on the ring; a key is placed by the upper bits of its hash.
BITS = 32
#: A key with more than this part of all rows is a group of its own; so there are at most as many such keys.
HEAVY = 4096


def ring(shards: int, points: int = POINTS) -> list[tuple[int, int]]:
    """(position, shard) clockwise. A shard's points depend on its number alone, so a new shard moves no other."""
    placed: dict[int, int] = {}
    for s in range(shards):
        for v in range(points):
            at, again = xxhash.xxh3_64_intdigest(f"{s}/{v}") >> (64 - BITS), 0
            while at in placed:
                again += 1
                at = xxhash.xxh3_64_intdigest(f"{s}/{v}/{again}") >> (64 - BITS)
            placed[at] = s
    return sorted(placed.items())


def bounds(total: int, shards: int, slack: float = 0.0) -> list[int]:
    """Rows each shard may take: the mean, rounded so that the sum is ``total``, or more by the share ``slack``."""
    if slack:
        return [-(-int(total * (1 + slack)) // shards) + 1] * shards
    return [total // shards + (s < total % shards) for s in range(shards)]


def flow(
    counts: dict[int, int], nodes: list[tuple[int, int]], room: list[int], arcs: dict[int, int] | None = None
) -> list[tuple[int, int, int, int, int]]:
    """(group, first rank, end rank, shard, first slot): where the rows of each group go.

    A group lies on the arc of its own number, or on that named in ``arcs``.
    Rows come to shards in waves: first all groups' own rows, then what found
    no room, one point further, and so on. Within a wave groups are served in
    ring order. The rows of a group with the lowest ranks find room first.
    """
    room, filled = list(room), [0] * len(room)
    arc = lambda g: (arcs or {}).get(g, g)
    order = sorted(counts, key=lambda g: (arc(g), g))
    waiting = {g: (0, counts[g]) for g in order if counts[g]}
    out = []
    for step in range(len(nodes)):
        for g in [g for g in order if g in waiting]:
            start, n = waiting.pop(g)
            s = nodes[(arc(g) + step) % len(nodes)][1]
            take = min(n, room[s])
            if take:
                out.append((g, start, start + take, s, filled[s]))
                room[s] -= take
                filled[s] += take
            if n > take:
                waiting[g] = (start + take, n - take)
        if not waiting:
            break
    return out


def shard_rows(
    docs: DataFrame, shards: int, key: str = "text", id_col: str = "doc_id", points: int = POINTS, slack: float = 0.0
) -> DataFrame:
    """``docs`` with ``shard``, ``slot`` (0, 1, ... inside the shard) and ``arc``.

    Rows are placed by the hash of ``key`` (null: by its own) and ordered by it
    within an arc, so equal keys stay together but where a shard is full: such
    a cut parts the rows of one key at most. A key of more than one row in
    ``HEAVY`` is a group of its own, ordered by id. With ``slack`` 0 row
    counts differ by at most one; with more, less moves when shards are added.
    An empty table gives an empty result; repeated rows are rows like others;
    clashing names get new columns with ``_`` appended.
    """
    nodes = ring(shards, points)
    shard_c, slot_c, arc_c, hash_c, pri, group_c, first_c, end_c, base_c = fresh(
        docs, "shard", "slot", "arc", "hash", "priority", "group", "first", "end", "base"
    )
    text = F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("\x00"))
    placed = docs.withColumn(hash_c, F.xxhash64(text))
    placed = materialise(placed.withColumn(arc_c, _arcs(nodes)(F.shiftrightunsigned(hash_c, 64 - BITS))))
    total = placed.count()
    heavy = placed.groupBy(arc_c, hash_c).count().where(F.col("count") > max(LEAST_ROWS, total // HEAVY)).collect()
    arcs = {len(nodes) + i: r[0] for i, r in enumerate(sorted(heavy, key=lambda r: r[1]))}
    own = docs.sparkSession.createDataFrame(
        [(r[1], len(nodes) + i) for i, r in enumerate(sorted(heavy, key=lambda r: r[1]))], f"`{hash_c}` long, `{group_c}` long"
    )
    by_id = F.xxhash64(F.col(f"`{id_col}`").cast("string"), F.lit("ring"))
    by_key = F.xxhash64(hash_c, F.lit("order")).bitwiseAND(F.lit(-1 << 32)).bitwiseOR(F.shiftrightunsigned(by_id, 32))
    rows = placed.join(F.broadcast(own), hash_c, "left")
    rows = rows.withColumn(pri, F.when(F.col(group_c).isNotNull(), by_id).otherwise(by_key)).withColumn(group_c, F.coalesce(group_c, arc_c))
    rows = materialise(rows) if heavy else rows
    counts = {r[0]: r[1] for r in rows.groupBy(group_c).count().collect()}
    plan = flow(counts, nodes, bounds(total, shards, slack), arcs)
    rows, rank = ranked(rows, group_c, pri, counts)
    way = docs.sparkSession.createDataFrame(plan, f"`{group_c}` long, `{first_c}` long, `{end_c}` long, `{shard_c}` int, `{base_c}` long")
    hit = (F.col(rank) >= F.col(first_c)) & (F.col(rank) < F.col(end_c))
    joined = rows.alias("r").join(F.broadcast(way).alias("w"), (F.col(f"r.{group_c}") == F.col(f"w.{group_c}")) & hit)
    return joined.select(
        *[F.col(f"r.`{c}`") for c in docs.columns], F.col(shard_c), (F.col(base_c) + F.col(rank) - F.col(first_c)).alias(slot_c), F.col(arc_c)
    )


def _arcs(nodes: list[tuple[int, int]]):
    """Position -> index of the next point clockwise."""
    edges = np.array([p for p, _ in nodes], np.int64)

    @F.pandas_udf("long")
    def arc(at: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, at.to_numpy(np.int64)) % len(edges))

    return arc


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, size (UTF-8 bytes of the text plus 1), text_crc32 and the text's digest, which stands for the text."""
    raw = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        "doc_id",
        (F.octet_length(raw) + 1).cast("long").alias("size"),
        F.crc32(F.encode(raw, "UTF-8")).alias("text_crc32"),
        F.when(F.col("text").isNotNull(), F.sha2("text", 256)).alias("digest"),
    )
