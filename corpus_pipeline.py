"""From raw documents to packed training sequences: five stages, each written as Parquet and read again.

quality (rejected documents go), near duplicates (one document of each group
stays), benchmark decontamination (documents that share a window with the
benchmark go), PII (entities get surrogates), packing.

Every stage takes tables of any size, also empty ones. A null or empty text has
no duplicates, no window of the benchmark and no personal data, is judged by
its site's record, and is packed as the one id that ends a document. Rows that
repeat an id are treated alike; a null id is nobody's duplicate. Further columns
are kept until packing, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.llm import decontaminate, minhash, packing, quality, surrogates
from riskframe.llm.common import fresh, table
from riskframe.llm.queries import site
from riskframe.session import checkpoint_dir


#: Percent of shared 5-word shingles from which two documents are near duplicates here.
SIMILAR = 80


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier and their site's record do not reject; null texts are judged by their site."""
    found = quality.judged(docs, table(spark, sf_dir, "labels"), **site(docs))
    return found.where(F.col(found.columns[-1])).select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group linked at ``SIMILAR``; documents without words or id all stay."""
    (gone_id,) = fresh(docs, "gone_id")
    gone = minhash.near_duplicates(docs, percent=SIMILAR).where("NOT kept").select(F.col("doc_id").alias(gone_id))
    return docs.join(gone, F.col("doc_id") == F.col(gone_id), "left_anti")


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of the benchmark occurs."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def without_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with surrogates for personal data, their lengths brought up to date."""
    done = surrogates.pseudonymised(docs)
    return done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The tokens of what is left in sequences of at most 2048."""
    return packing.pack(packing.pieces(docs))


STAGES = [
    ("quality", good_quality),
    ("near_duplicates", one_of_each_group),
    ("decontamination", decontaminated),
    ("pii", without_pii),
    ("packing", packed),
]

#: A trained classifier, keyed surrogates and a tokenizer are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. What a stage wrote is removed once the next has been written."""
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            _remove(spark, before)
        before = path
    return docs


def _remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
