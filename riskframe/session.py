"""Session helpers for tests and benchmarks.

Library code never builds a session: every operator works on the session of
the DataFrames it is given, so a cluster's own settings stay in charge.
"""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str | int = "*", memory: str = "8g", app: str = "riskframe") -> SparkSession:
    """A local session with the settings the operators are written for."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and stream state.

    Read from ``spark.checkpoint.dir``. Only a session of one process
    (``local[...]``) may go without: there a folder is made. On a cluster a
    local folder would be another one on each machine, so that is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not is_local(spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="riskframe-checkpoint-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path


def is_local(master: str) -> bool:
    """Driver and executors are one process."""
    return master == "local" or master.startswith("local[")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, whatever file system it names; errors of the file system are raised."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def _file(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def list_names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none where there is no such folder."""
    where, fs = _file(spark, path)
    return [f.getPath().getName() for f in fs.listStatus(where)] if fs.exists(where) else []


def create_text(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file that must not be there yet; False if it is."""
    where, fs = _file(spark, path)
    try:
        out = fs.create(where, False)
    except Exception as error:  # the file systems name this differently
        if fs.exists(where):
            return False
        raise error
    out.write(bytearray(text.encode()))
    out.close()
    return True


def read_text(spark: SparkSession, path: str) -> str:
    """A small file."""
    where, fs = _file(spark, path)
    stream = fs.open(where)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def stored(df: DataFrame) -> tuple[DataFrame, str]:
    """Compute once and keep as parquet, compressed, on the shared checkpoint folder: the rows read back, and their path.

    For results of the size of the input, of which later branches read some
    columns each; `discard` the path when it is not read any more.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Remove a folder that `stored` made."""
    where, fs = _file(spark, path)
    fs.delete(where, True)


def materialise(df: DataFrame) -> DataFrame:
    """Compute once and keep on the shared checkpoint folder.

    For small results that several later branches read; the files outlive any
    executor, and the branches do not recompute what came before.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Let go of shuffle files that nothing refers to any more.

    Spark removes them when the driver's garbage is collected, which a driver
    with much room does far too seldom for steps that each move a whole table.
    """
    for _ in range(2):  # what the first round frees may hold more
        gc.collect()  # frames that Python does not hold any more
        spark.sparkContext._jvm.System.gc()


#: Bytes of an Arrow batch where rows are texts or blocks.
BATCH_BYTES = 8 << 20


@contextmanager
def small_batches(spark: SparkSession, limit: int = BATCH_BYTES) -> Iterator[None]:
    """What runs meanwhile hands rows to Python in batches of at most about ``limit`` bytes.

    A batch is held by the JVM, in buffers of up to twice its size, and by
    Python once more, for each core. A session that has a smaller limit keeps it.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    former = spark.conf.get(name)
    most = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(former)
    spark.conf.set(name, str(min(most, limit) if most > 0 else limit))
    try:
        yield
    finally:
        spark.conf.set(name, former)
