"""Gapless ranks inside groups of any size, without sorting a group in one task."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskframe.llm.common import fresh

#: At most so many buckets besides one per key, and at least so many rows in a bucket.
BUCKETS, LEAST_ROWS = 65_536, 256


def ranked(df: DataFrame, key: str, priority: str, counts: dict[int, int]) -> tuple[DataFrame, str]:
    """``df`` with a column of ranks 0, 1, ... inside each ``key`` in the order of ``priority``, and that column's name.

    ``counts`` has the rows of each key; keys come from a small fixed domain.
    ``priority`` is a well-mixed long, taken as unsigned, so equal ranges of it hold about equal
    rows. Each key is cut into ranges, a range is ordered on its own, and the
    rows of the ranges before it are added. The result does not depend on how
    many ranges there are. Rows that share a priority are ordered arbitrarily.
    Columns of any name may be there: those that are added get other names.
    """
    rank, part, parts, before, inside, n = fresh(df, "rank", "part", "parts", "before", "inside", "n")
    total = sum(counts.values())
    size = max(LEAST_ROWS, -(-total // BUCKETS))
    # an Arrow table, as a list of rows goes through Python workers of its own on the executors
    listed = {key: pa.array([int(k) for k in counts], pa.int64()), parts: pa.array([int(-(-m // size)) for m in counts.values()], pa.int64())}
    cut = df.sparkSession.createDataFrame(pa.table(listed))
    share = (F.shiftrightunsigned(F.col(f"`{priority}`"), 12).cast("double")) / F.lit(float(1 << 52))
    dealt = df.join(F.broadcast(cut), key).withColumn(part, F.floor(share * F.col(parts)).cast("long")).drop(parts)
    sums = F.sum(n).over(Window.partitionBy(key).orderBy(part).rowsBetween(Window.unboundedPreceding, -1))
    offsets = dealt.groupBy(key, part).agg(F.count(F.lit(1)).alias(n)).select(key, part, F.coalesce(sums, F.lit(0)).alias(before))
    place = F.row_number().over(Window.partitionBy(key, part).orderBy(F.col(f"`{priority}`") < 0, F.col(f"`{priority}`")))
    done = dealt.withColumn(inside, place).join(offsets, [key, part]).withColumn(rank, F.col(before) + F.col(inside) - 1)
    return done.drop(part, inside, before), rank
