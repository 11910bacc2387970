"""Recorded responses as a data source: ``spark.read.format("quarry_recorded").load(folder)``.

The folder has a folder ``source=<name>`` for each connector, with JSON lines (query_id, ix, payload, code). Each file is
one partition or, if it is large, several of ``splitBytes`` bytes, each of which reads the lines that begin in it. Filters on ``source``
are pushed down: folders of other sources are not listed. Files are opened by the tasks that read them, in any file
system that pyarrow knows (local, HDFS, S3, GCS by address). A line that does not parse is a response with the code
``MALFORMED_RECORD``; nothing raises.
"""

from __future__ import annotations

import io
import json
import posixpath
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

FORMAT = "quarry_recorded"
SCHEMA = "query_id long, ix int, source string, payload string, code string"


def _opened(path: str) -> tuple:
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Stretch(InputPartition):
    """Bytes of a file; lines that begin in it."""

    source: str
    path: str
    first: int
    end: int


class RecordedReader(DataSourceReader):
    def __init__(self, folder: str, split: int) -> None:
        self.folder, self.split, self.sources = folder, split, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes what says which sources are wanted; the rest is Spark's."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("source",):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.sources = wanted if self.sources is None else self.sources & wanted
            else:
                yield f

    def partitions(self) -> list[Stretch]:
        from pyarrow import fs

        disk, root = _opened(self.folder)
        out = []
        for one in sorted(disk.get_file_info(fs.FileSelector(root)), key=lambda x: x.base_name):
            if not one.base_name.startswith("source="):
                continue
            source = unquote(one.base_name.removeprefix("source="))
            if self.sources is not None and source not in self.sources:
                continue
            for file in sorted(disk.get_file_info(fs.FileSelector(one.path)), key=lambda x: x.base_name):
                if file.is_file and not file.base_name.startswith(("_", ".")):
                    path = posixpath.join(self.folder, one.base_name, file.base_name)
                    out += [Stretch(source, path, a, min(a + self.split, file.size)) for a in range(0, file.size, self.split)]
        return out or [Stretch("", "", 0, 0)]

    def read(self, partition: Stretch) -> Iterator[tuple]:
        if not partition.path:
            return
        disk, path = _opened(partition.path)
        with io.BufferedReader(disk.open_input_file(path)) as file:
            file.seek(max(0, partition.first - 1))
            if partition.first:
                file.readline()  # the line that began before, or the end of it
            while file.tell() < partition.end and (line := file.readline()):
                if not line.strip():
                    continue
                try:
                    told = json.loads(line)
                    row = (int(told["query_id"]), int(told.get("ix") or 0), partition.source, told.get("payload"), told.get("code"))
                except (ValueError, TypeError, KeyError, AttributeError):
                    row = (None, None, partition.source, None, "MALFORMED_RECORD")
                yield row


class Recorded(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> RecordedReader:
        return RecordedReader(self.options["path"], int(self.options.get("splitbytes", 64 << 20)))


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, with its filters pushed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Recorded)


def read_recorded(spark: SparkSession, folder: str, **options: str) -> DataFrame:
    register(spark)
    return spark.read.format(FORMAT).options(**options).load(folder)


def record(responses: DataFrame, folder: str) -> None:
    """Writes responses (query_id, ix, source, payload, code) as a folder that can be read so."""
    responses.select("query_id", "ix", "source", "payload", "code").write.partitionBy("source").json(folder)
