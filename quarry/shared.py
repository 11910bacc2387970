"""The folder that driver and executors share, for checkpoints and scratch tables."""

from __future__ import annotations

import re
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session, or the folder already set for checkpoints; in local mode a temporary one if neither is."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if path:
        return path
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quarry-"))
    return spark.sparkContext.getCheckpointDir()


def scratch_root(spark: SparkSession) -> str:
    """This application's folder for scratch tables; it goes when the application ends."""
    return f"{shared_dir(spark)}/scratch-{spark.sparkContext.applicationId}"


def on_disk(spark: SparkSession, path: str) -> tuple:
    """The file system of a path, and the path, as the JVM knows them."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def written(df: DataFrame, path: str) -> DataFrame:
    """``df`` written once as Parquet in the scratch folder, and read back."""
    spark = df.sparkSession
    df.write.parquet(path)
    fs, root = on_disk(spark, scratch_root(spark))
    fs.deleteOnExit(root)
    return spark.read.schema(df.schema).parquet(path)


_OPEN: ContextVar[list[str] | None] = ContextVar("checkpoints", default=None)


@contextmanager
def collected() -> Iterator[list[str]]:
    """The paths of the tables that ``checkpointed`` writes inside, for ``drop``."""
    token = _OPEN.set([])
    try:
        yield _OPEN.get()
    finally:
        _OPEN.reset(token)


def drop(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables that nothing still to be read depends on."""
    for path in paths:
        fs, where = on_disk(spark, path)
        fs.delete(where, True)
    paths.clear()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed once, its lineage cut by a table in the shared folder.

    Not ``DataFrame.checkpoint``: that hands on the constraints of the plan that it cuts, and plans of several rounds
    then take minutes to optimize.
    """
    path = f"{scratch_root(df.sparkSession)}/{uuid.uuid4().hex}"
    if _OPEN.get() is not None:
        _OPEN.get().append(path)
    return written(df, path)


_LOCK, _INSIDE = threading.Lock(), {}


@contextmanager
def arrow_batches(spark: SparkSession, most: int) -> Iterator[None]:
    """Jobs that run inside hand rows to Python in Arrow batches of about ``most`` bytes.

    Spark's own limits are 10,000 rows and 64 MB, and a worker holds a few batches at once. It is a setting of the session,
    so threads inside at the same time share the first one's, and the last one puts back what was there.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    with _LOCK:
        users, before = _INSIDE.get(id(spark), (0, None))
        if not users:
            before = spark.conf.get(key, None)
            spark.conf.set(key, str(most))
        _INSIDE[id(spark)] = users + 1, before
    try:
        yield
    finally:
        with _LOCK:
            users, before = _INSIDE.pop(id(spark))
            if users > 1:
                _INSIDE[id(spark)] = users - 1, before
            elif before is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, before)
