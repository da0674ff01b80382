"""Table maintenance (SNK group): upserts, manifest, feedback, clearing.

Tables are parquet snapshots. A writer never overwrites what it reads: each
upsert reads one snapshot and writes the next.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskframe import schemas
from riskframe.session import exists
from riskframe.sources.readers import empty_frame


# ------------------------------------------------------------------ corpus
def last_write_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the one greatest in ``order``.

    max_by combines before the shuffle, so a key with very many versions
    sends one row per task.
    """
    columns = df.columns
    rest = [c for c in columns if c not in keys]
    return (
        df.groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
        .select(*keys, "_row.*")
        .select(*columns)
    )


def upsert_corpus(existing: DataFrame, batch: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """SNK1: existing rows overlaid with a batch; the batch wins, and within a batch the last row by ``order``."""
    old = existing.withColumn("_batch", F.lit(0))
    new = batch.select(*existing.columns).withColumn("_batch", F.lit(1))
    return last_write_wins(old.unionByName(new), keys, ["_batch", *order]).drop("_batch")


def write_snapshot(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def merge_into(target: str, batch: DataFrame, keys: list[str]) -> None:
    """SNK1 for a table of a catalog that supports row-level changes."""
    condition = F.lit(True)
    for k in keys:
        condition = condition & (F.col(f"target.{k}") == F.col(f"source.{k}"))
    (
        batch.alias("source")
        .mergeInto(target, condition)
        .whenMatched()
        .updateAll()
        .whenNotMatched()
        .insertAll()
        .merge()
    )


def clear_table(spark: SparkSession, path: str, schema: T.StructType) -> None:
    """SNK3: leave an empty table of the same schema."""
    empty_frame(spark, schema).write.mode("overwrite").parquet(path)


def sanitise_metadata(metadata: Column | str) -> Column:
    """SNK2 for maps: entries without a value are dropped."""
    return F.map_filter(F.col(metadata) if isinstance(metadata, str) else metadata, lambda k, v: v.isNotNull())


def metadata_map(df: DataFrame, columns: list[str]) -> Column:
    """SNK2 for columns: a string map of the non-null values; nested values as JSON."""
    entries = []
    for c in columns:
        nested = isinstance(df.schema[c].dataType, (T.StructType, T.ArrayType, T.MapType))
        value = F.to_json(F.col(c)) if nested else F.col(c).cast("string")
        entries.append(F.when(F.col(c).isNotNull(), F.struct(F.lit(c).alias("k"), value.alias("v"))))
    return F.map_from_entries(F.array_compact(F.array(*entries)))


# ------------------------------------------------------------------ manifest
def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The manifest as one row per key; empty only when there is none yet, any other trouble is raised."""
    if not exists(spark, path):
        return empty_frame(spark, schemas.MANIFEST)
    return current_manifest(spark.read.schema(manifest_log_schema()).parquet(path))


def manifest_log_schema() -> T.StructType:
    return T.StructType(schemas.MANIFEST.fields + [T.StructField("removed", T.BooleanType())])


def current_manifest(marks: DataFrame) -> DataFrame:
    """SNK4: the last mark of each key; removed keys are gone."""
    latest = last_write_wins(marks, ["key"], ["loaded_at", "removed"])
    return latest.filter(~F.col("removed")).drop("removed")


def manifest_mark(spark: SparkSession, path: str, key: str, rows: int, docs: int, at: float | None = None) -> None:
    """SNK4: append a mark; marking a key again replaces its earlier mark."""
    row = [(key, rows, docs, time.time() if at is None else at, False)]
    spark.createDataFrame(row, manifest_log_schema()).write.mode("append").parquet(path)


def manifest_remove(spark: SparkSession, path: str, key: str, at: float | None = None) -> None:
    row = [(key, 0, 0, time.time() if at is None else at, True)]
    spark.createDataFrame(row, manifest_log_schema()).write.mode("append").parquet(path)


def manifest_clear(spark: SparkSession, path: str) -> None:
    clear_table(spark, path, manifest_log_schema())


def pending_sources(inventory: DataFrame, manifest: DataFrame, reset: bool = False) -> DataFrame:
    """SNK5: sources (column ``key``) not loaded yet; all of them with ``reset``."""
    return inventory if reset else inventory.join(manifest.select("key"), "key", "left_anti")


# ------------------------------------------------------------------ feedback
def valid_feedback(feedback: DataFrame) -> DataFrame:
    """SNK8: ratings other than up and down are not accepted."""
    return feedback.filter(F.col("rating").isin("up", "down"))


def append_feedback(feedback: DataFrame, path: str) -> None:
    """SNK8: append valid ratings; rows without a time get the current one."""
    now = F.unix_micros(F.current_timestamp()) / 1e6
    stamped = valid_feedback(feedback).withColumn("ts", F.coalesce("ts", now))
    stamped.select(*schemas.FEEDBACK.names).write.mode("append").parquet(path)
