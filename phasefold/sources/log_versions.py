"""Growing text files as a stream of file versions: ``spark.readStream.format("log_versions").load(folder)``.

A file stream never opens a path again, but running logs grow in place.  Here an
offset is the list of all files with their modification time and size, so a file
whose version differs from the last offset's is one row of the next batch, whole:
log_file, mtime (microseconds), size, value.  Files that didn't change are not
opened.  A batch that is run again reads the same number of bytes of each file, so
lines that were added meanwhile come with a later version.  Paths must be visible to
every executor; offsets hold an entry per log file, so this is for run logs.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from phasefold.sources.matrix_files import mounted

SCHEMA = "log_file string, mtime bigint, size bigint, value string"


@dataclass
class Version(InputPartition):
    path: str
    mtime: int
    size: int


class VersionReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path = mounted(options["path"])

    def initialOffset(self) -> dict:
        return {"files": {}}

    def latestOffset(self) -> dict:
        files = {}
        for folder, _, names in sorted(os.walk(self.path)):
            for name in sorted(names):
                if not name.startswith((".", "_")):
                    about = os.stat(os.path.join(folder, name))
                    files[os.path.join(folder, name)] = [about.st_mtime_ns // 1000, about.st_size]
        return {"files": files}

    def partitions(self, start: dict, end: dict) -> list[Version]:
        changed = [Version(path, *version) for path, version in end["files"].items() if start["files"].get(path) != version]
        return changed or [Version("", 0, 0)]

    def read(self, partition: Version) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        with open(partition.path, "rb") as f:
            text = f.read(partition.size).decode(errors="replace")
        yield pa.RecordBatch.from_arrays([pa.array([partition.path]), pa.array([partition.mtime]), pa.array([partition.size]), pa.array([text])],
                                         names=["log_file", "mtime", "size", "value"])

    def commit(self, end: dict) -> None:
        pass


class LogVersions(DataSource):
    @classmethod
    def name(cls) -> str:
        return "log_versions"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema: StructType) -> VersionReader:
        return VersionReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(LogVersions)
