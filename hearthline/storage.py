"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
LOCAL_FALLBACK = "/tmp/checkpoints/hearthline"
NUMBERS = {"spark.sql.execution.arrow.maxRecordsPerBatch": "8192", "spark.sql.execution.arrow.maxBytesPerBatch": "2147483647", "spark.sql.files.maxPartitionBytes": "16m"}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where it is unset, a local session uses a folder of its own under /tmp and any other
    session uses the warehouse, which executors share.
    """
    conf = spark.sparkContext.getConf()
    named = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.startswith("local["):
        return LOCAL_FALLBACK
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: its lineage ends
    there, so a lost executor costs no recomputation of what led to it, and what was shuffled for
    it is deleted at once instead of when the driver next collects garbage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/hearthline/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


@contextlib.contextmanager
def number_rows(spark: SparkSession) -> Iterator[None]:
    """For passes over rows of numbers that run inside. Such rows go to Python tasks in longer batches than ship() sets, whose bytes
    needn't be counted row by row; and files are read in small shares, many for each core, as of a few large shares most
    cores would wait for the last."""
    before = {key: spark.conf.get(key) for key in NUMBERS}
    for key, value in NUMBERS.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def forget(df: DataFrame | None) -> None:
    """Delete a table that ``written`` made and that nothing reads any more."""
    path = getattr(df, "stored_at", None)
    if path:
        jvm = df.sparkSession.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


_shipped: set[str] = set()
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}
LINES = BATCHES | {"spark.sql.execution.arrow.maxRecordsPerBatch": "8192"}  # for rows of lines, of which most are short


def ship(spark: SparkSession, batches: dict[str, str] = BATCHES) -> None:
    """Send this package to the executors once for each application, so that functions that
    tasks run can be imported there wherever the driver was started. Batches to Python tasks
    are kept small in rows and bytes, as a row may be a very long text; that setting stays, as
    queries that are returned run later."""
    import os
    import zipfile

    from pyspark import SparkFiles

    for key, most in batches.items():
        spark.conf.set(key, most)
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    folder = os.path.join(SparkFiles.getRootDirectory(), f"source-{uuid.uuid4().hex}")  # goes when the session ends
    os.makedirs(folder)
    path = os.path.join(folder, "hearthline.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(os.path.join(top, "hearthline")):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, top))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)
