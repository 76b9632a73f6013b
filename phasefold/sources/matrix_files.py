"""NumPy matrix files as a Spark data source: ``spark.read.format("npy_particles")``.

A file is an (N, >= 8) matrix: x, y, z, vx, vy, vz, r, vr, then optionally the
particle id and the mass.  ``load(path)`` reads a file, a folder or a pattern; with
option ``tree`` the path is a root with folders ``<split>/<class>`` and rows get the
columns ``split`` and ``is_stream`` (option ``splits``: the splits to read).

Planning lists names and sizes only.  A file becomes parts of about ``split_rows``
rows by its size; the task of a part opens the header, maps the file and reads its
share of the rows, so headers are opened by tasks, all at once.  Only the columns of the
read schema are taken from a matrix (``spark.read.schema("x double, vx double")``).
Option ``where`` holds conditions that all apply, as JSON ``[[column, "<=", value], ...]``: those
on ``file_id``, ``split`` and ``is_stream`` leave out whole files, those on matrix columns
leave out rows before they are converted.  (Spark 4.1 keeps the filters it pushed into a Python
source for later plans of the same DataFrame, so its own push-down is not used.)

Files without an id column get ids that are unique over the files of a read: the
file's place in name order in the high bits, the row in the low 40 bits.

Writing puts bounded files per task and publishes them on commit, before replaced
files go.  Paths must be visible to every executor.
"""

from __future__ import annotations

import glob
import json
import operator
import os
import uuid
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from phasefold.sources.splits import CLASSES, SPLITS

MATRIX = ("x", "y", "z", "vx", "vy", "vz", "r", "vr")
KINDS = {"file_id": "string", "row_index": "bigint", **{c: "double" for c in MATRIX}, "particle_id": "bigint", "mass": "double"}
PLACED = {"split": "string", "is_stream": "int"}
ARROW = {"string": pa.string(), "bigint": pa.int64(), "double": pa.float64(), "int": pa.int32()}
SCHEMA = ", ".join(f"{c} {k}" for c, k in KINDS.items())
BATCH_ROWS = 65_536
#: Bytes of a row of the narrowest matrix, which turn ``split_rows`` into a size.
ROW_BYTES = 64
ROW_BITS = 40
COMPARE = {"<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge, "=": operator.eq}


@dataclass
class FilePart(InputPartition):
    path: str
    number: int
    part: int
    parts: int
    split: str | None = None
    is_stream: int | None = None


@dataclass
class Written(WriterCommitMessage):
    files: list


def mounted(path: str) -> str:
    """Plain path of a ``file:`` URI or path; object stores must be mounted to be memory-mapped."""
    parts = urlparse(path)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"matrix files need a mounted path, got {path}")
    return parts.path


def _files(path: str) -> list[str]:
    if os.path.isdir(path):
        path = os.path.join(path, "*.npy")
    return sorted(glob.glob(path))


def _stem(path: str) -> str:
    return os.path.splitext(os.path.basename(path))[0]


class MatrixReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.path = mounted(options["path"])
        self.split_bytes = int(options.get("split_rows", 1_000_000)) * ROW_BYTES
        self.tree = str(options.get("tree", "false")).lower() == "true"
        self.splits = [x.strip() for x in options.get("splits", ",".join(SPLITS)).split(",")]
        self.columns = list(schema.names)
        known = KINDS | (PLACED if self.tree else {})
        strange = [c for c in self.columns if c not in known]
        if strange:
            raise ValueError(f"no such columns in matrix files: {strange}")
        self.kinds = [ARROW[known[c]] for c in self.columns]
        tests = [tuple(t) for t in json.loads(options.get("where", "[]"))]
        strange = [t for t in tests if len(t) != 3 or t[1] not in COMPARE or t[0] not in (*MATRIX, "file_id", *(PLACED if self.tree else ()))]
        if strange:
            raise ValueError(f"no such conditions on matrix files: {strange}")
        self.file_tests = [t for t in tests if t[0] not in MATRIX]
        self.row_tests = [t for t in tests if t[0] in MATRIX]

    def _found(self) -> Iterator[tuple[str, str | None, int | None]]:
        if not self.tree:
            yield from ((f, None, None) for f in _files(self.path))
            return
        for split in self.splits:
            for name, flag in CLASSES.items():
                folder = os.path.join(self.path, split, name)
                if not os.path.isdir(folder):
                    raise ValueError(f"missing data directory: {folder}")
                files = _files(folder)
                if not files:
                    raise ValueError(f"no rows in {folder}")
                yield from ((f, split, flag) for f in files)

    def partitions(self) -> list[FilePart]:
        found = list(self._found())
        if not found:
            raise ValueError(f"no .npy files under {self.path}")
        out = []
        for number, (path, split, flag) in enumerate(found):
            own = {"file_id": _stem(path), "split": split, "is_stream": flag}
            if all(COMPARE[how](own[column], value) for column, how, value in self.file_tests):
                parts = max(1, -(-os.path.getsize(path) // self.split_bytes))
                out += [FilePart(path, number, i, parts, split, flag) for i in range(parts)]
        return out or [FilePart("", -1, 0, 1)]

    def read(self, partition: FilePart) -> Iterator[pa.RecordBatch]:
        if partition.number < 0:  # the filters left no file
            return
        rows = np.load(partition.path, mmap_mode="r")
        if rows.ndim != 2 or rows.shape[1] < 8:
            raise ValueError(f"{partition.path} must be (N, >= 8), got {rows.shape}")
        first, last = (len(rows) * i // partition.parts for i in (partition.part, partition.part + 1))
        for start in range(first, last, BATCH_ROWS):
            block = rows[start:min(start + BATCH_ROWS, last)]
            index = np.arange(start, start + len(block), dtype=np.int64)
            keep = np.ones(len(block), bool)
            for column, how, value in self.row_tests:
                cells = np.asarray(block[:, MATRIX.index(column)], dtype=np.float64)
                ok = COMPARE[how](cells, float(value))
                keep &= ok | np.isnan(cells) if how in (">", ">=") else ok  # NaN is Spark's largest value
            if not keep.all():
                block, index = block[keep], index[keep]
            if len(block):
                yield pa.RecordBatch.from_arrays([self._column(c, k, partition, block, index) for c, k in zip(self.columns, self.kinds)], names=self.columns)

    def _column(self, name: str, kind: pa.DataType, partition: FilePart, block: np.ndarray, index: np.ndarray) -> pa.Array:
        if name in MATRIX:
            return pa.array(np.asarray(block[:, MATRIX.index(name)], dtype=np.float64))
        if name == "row_index":
            return pa.array(index)
        if name == "particle_id":
            return pa.array(np.asarray(block[:, 8]).astype(np.int64) if block.shape[1] >= 9 else index + (partition.number << ROW_BITS))
        if name == "mass":
            return pa.array(np.asarray(block[:, 9], dtype=np.float64) if block.shape[1] >= 10 else np.ones(len(block)))
        value = {"file_id": _stem(partition.path), "split": partition.split, "is_stream": partition.is_stream}[name]
        return pa.array([value] * len(block), kind)


class MatrixWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, columns: list[str], overwrite: bool):
        self.path = mounted(options["path"])
        self.columns = columns
        self.file_rows = int(options.get("file_rows", 1_000_000))
        os.makedirs(self.path, exist_ok=True)
        self.replaced = _files(self.path) if overwrite else []

    def _flush(self, blocks: list, files: list) -> None:
        from pyspark import TaskContext

        target = os.path.join(self.path, f"part-{TaskContext.get().partitionId():05d}-{len(files):05d}-{uuid.uuid4().hex}.npy")
        with open(target + ".tmp", "wb") as out:
            np.save(out, np.vstack(blocks))
        files.append(target)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        blocks, held, files = [], 0, []
        for batch in iterator:
            blocks.append(np.column_stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in self.columns]))
            held += batch.num_rows
            if held >= self.file_rows:
                self._flush(blocks, files)
                blocks, held = [], 0
        if held:
            self._flush(blocks, files)
        return Written(files)

    def commit(self, messages: list) -> None:
        for message in messages:
            for file in message.files if message else []:
                os.replace(file + ".tmp", file)
        for old in self.replaced:
            os.remove(old)

    def abort(self, messages: list) -> None:
        for message in messages:
            for file in message.files if message else []:
                os.remove(file + ".tmp")


class MatrixSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "npy_particles"

    def schema(self) -> str:
        tree = str(self.options.get("tree", "false")).lower() == "true"
        return SCHEMA + "".join(f", {c} {k}" for c, k in PLACED.items()) if tree else SCHEMA

    def reader(self, schema: StructType) -> MatrixReader:
        return MatrixReader(self.options, schema)

    def writer(self, schema: StructType, overwrite: bool) -> MatrixWriter:
        return MatrixWriter(self.options, schema.names, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(MatrixSource)


def read_tree(spark: SparkSession, root: str, splits: Iterable[str] = SPLITS, columns: Iterable[str] | None = None, where: Sequence[tuple] = (),
              split_rows: int = 1_000_000) -> DataFrame:
    """Rows of ``<root>/<split>/<class>/*.npy`` with split and is_stream; ``columns``: those to read, ``where``: (column, comparison, value) to keep."""
    register(spark)
    reader = spark.read.format("npy_particles").options(tree="true", splits=",".join(splits), split_rows=split_rows, where=json.dumps([list(t) for t in where]))
    if columns is not None:
        known = KINDS | PLACED
        reader = reader.schema(", ".join(f"{c} {known[c]}" for c in columns))
    return reader.load(root)


def write_tree(df: DataFrame, root: str, file_rows: int = 1_000_000) -> None:
    """Lay rows with split, is_stream, the matrix columns, particle_id and mass out as ``<root>/<split>/<class>/*.npy``."""
    register(df.sparkSession)
    matrix = [*MATRIX, "particle_id", "mass"]
    for split in sorted(r[0] for r in df.select("split").distinct().collect()):  # a handful of names
        for name, flag in CLASSES.items():
            part = df.where((df["split"] == split) & (df["is_stream"] == flag)).select(*[df[c].cast("double").alias(c) for c in matrix])
            part.write.format("npy_particles").option("file_rows", file_rows).mode("overwrite").save(os.path.join(root, split, name))
