"""Listing of source files and choice among them (SRC6, SRC7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Suffixes that count as source files.
SUPPORTED = (".csv", ".tsv", ".xlsx", ".xls", ".json", ".parquet")


def source_inventory(spark: SparkSession, directory: str, manifest: DataFrame) -> DataFrame:
    """SRC6: every supported file below ``directory`` with its load state, sorted by path.

    Only paths and lengths are selected, so file contents are never read.
    """
    base = directory.rstrip("/")
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .load(base)
        .select("path", "length")
    )
    # listed paths are URIs; what follows the base directory is the key of a file
    relative = F.regexp_replace(F.substring_index(F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))), base + "/", -1), r"\\", "/")
    name = F.substring_index("key", "/", -1)
    listed = (
        files.select(relative.alias("key"), F.col("path").alias("uri"), "length")
        .withColumn("name", name)
        .withColumn("ext", F.lower(F.regexp_extract("name", r"(\.[^.]*)$", 1)))
        .filter(F.col("ext").isin(*SUPPORTED))
        .withColumn("folder", F.regexp_extract("key", r"^(.*)/[^/]*$", 1))
        .withColumn("size_mb", F.bround(F.col("length") / 1048576, 2))
    )
    known = manifest.select("key", F.lit(True).alias("_loaded"), "docs", "rows")
    return (
        listed.join(known, "key", "left")
        .select(
            "name",
            F.col("key").alias("path"),
            "ext",
            "folder",
            "length",
            "size_mb",
            F.coalesce("_loaded", F.lit(False)).alias("loaded"),
            F.coalesce("docs", F.lit(0)).alias("loaded_docs"),
            F.coalesce("rows", F.lit(0)).alias("loaded_rows"),
            "uri",
        )
        .orderBy("path")
    )


def pick_source(inventory: DataFrame, dataset: str = "orders") -> DataFrame:
    """SRC7: the CSV to load (one row or none): the largest for orders, the first by path otherwise."""
    csv = inventory.filter(F.col("ext") == ".csv")
    chosen = (
        F.max_by("path", F.struct("length", "path")) if dataset == "orders" else F.min("path")
    )
    return csv.agg(chosen.alias("path")).filter(F.col("path").isNotNull())


def preferred_source(inventory: DataFrame, preference: list[str]) -> DataFrame:
    """The first existing path of a preference list (orders, then SKUs); one row or none."""
    position = F.array_position(F.array(*[F.lit(p) for p in preference]), F.col("path"))
    return (
        inventory.filter(F.col("path").isin(preference))
        .agg(F.min_by("path", position).alias("path"))
        .filter(F.col("path").isNotNull())
    )
