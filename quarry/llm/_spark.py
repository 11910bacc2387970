"""Scratch tables in the folder that all executors share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.shared import shared_dir

__all__ = ["collected", "drop", "drop_scratch", "files", "materialize", "numbered", "shared_dir", "shuffle_partitions"]

_OPEN: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


@contextmanager
def collected() -> Iterator[list[str]]:
    """The paths of all scratch tables that are made inside without a list of their own, for ``drop``."""
    token = _OPEN.set([])
    try:
        yield _OPEN.get()
    finally:
        _OPEN.reset(token)


def _root(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/scratch-{spark.sparkContext.applicationId}"


def _path(spark: SparkSession, path: str) -> tuple:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def materialize(df: DataFrame, scratch: list[str] | None = None) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back: cuts lineage, survives lost executors.

    Its path is added to ``scratch``, or else to what ``collected`` gave, for ``drop``. What is left goes when the application ends.
    """
    spark = df.sparkSession
    path = f"{_root(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    fs, root = _path(spark, _root(spark))
    fs.deleteOnExit(root)
    made = _OPEN.get() if scratch is None else scratch
    if made is not None:
        made.append(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(docs: DataFrame, *columns: Column) -> DataFrame:
    """(file, index) and ``columns``: the place of every row in the files that ``docs`` reads, the same in every scan.

    Rows that come from no file are written to a scratch table first. ``file`` is a hash of the path (see ``files``).
    """
    try:
        meta = docs.metadataColumn("_metadata")
        return docs.select(F.xxhash64(meta["file_path"]).alias("file"), meta["row_index"].alias("index"), *columns)
    except AnalysisException:
        plain = [F.col(f"`c{i}`") for i in range(len(columns))]
        table = materialize(docs.select(*(c.alias(f"c{i}") for i, c in enumerate(columns))))
        names = docs.select(*columns).columns
        return numbered(table, *(c.alias(n) for c, n in zip(plain, names, strict=True)))


def files(rows: DataFrame) -> np.ndarray:
    """The ``file`` numbers of ``numbered`` rows in ascending order: one a file, as many as the driver lists anyway."""
    return np.array(sorted(r["file"] for r in rows.select("file").distinct().collect()), np.int64)


def drop(spark: SparkSession, scratch: list[str]) -> None:
    """Delete tables that nothing still to be read depends on."""
    for path in scratch:
        fs, where = _path(spark, path)
        fs.delete(where, True)
    scratch.clear()


def drop_scratch(spark: SparkSession) -> None:
    """Delete every scratch table of this application; call it when no result is still to be read."""
    drop(spark, [_root(spark)])


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
