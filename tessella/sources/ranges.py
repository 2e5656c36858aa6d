"""Readers that plan their own partitions: ranges of rows of .npy matrices, members of .zip archives.

The driver reads headers and directories only; each task opens its file at
its own place, and holds one batch of it.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of a matrix that a task reads, and of which it makes one batch.
RANGE_BYTES, STEP_BYTES = 64_000_000, 4_000_000
#: Lines in a batch.
LINES = 10_000


def _files(path: str, ending: str) -> list[tuple[fs.FileSystem, str, str]]:
    """(file system, its path, URI) of a file or of the files of a folder, in order."""
    uri = path if "://" in path or path.startswith("file:") else f"file://{path}"
    system, at = fs.FileSystem.from_uri(uri)
    root = uri[: len(uri) - len(at)] if uri.endswith(at) else "file://"
    info = system.get_file_info(at)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [at] if info.type == fs.FileType.File else sorted(x.path for x in system.get_file_info(fs.FileSelector(at)) if x.path.endswith(ending))
    return [(system, x, root + x) for x in found]


def _open(uri: str):
    system, at = fs.FileSystem.from_uri(uri)
    return system.open_input_file(at)


class _Range(InputPartition):
    def __init__(self, uri: str, offset: int, first: int, rows: int, width: int, dtype: str):
        self.uri, self.offset, self.first, self.rows, self.width, self.dtype = uri, offset, first, rows, width, dtype


class _NpyReader(DataSourceReader):
    def __init__(self, path: str, size: int):
        self.path, self.size = path, size

    def partitions(self) -> list[_Range]:
        out = []
        for system, at, uri in _files(self.path, ".npy"):
            with system.open_input_file(at) as f:
                head = io.BytesIO(f.read(65_536))
            version = np.lib.format.read_magic(head)
            shape, fortran, dtype = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(head)
            if dtype.hasobject or len(shape) > 2:
                raise ValueError(f"{uri}: a matrix of numbers is asked for, not {dtype} of shape {shape}")
            rows, width = (shape[0] if shape else 1), (shape[1] if len(shape) > 1 else 1)
            if fortran and width > 1 and rows > 1:
                raise ValueError(f"{uri}: rows must lie one behind the other")
            step = max(1, self.size // max(1, width * dtype.itemsize))
            out += [_Range(uri, head.tell() + i * width * dtype.itemsize, i, min(step, rows - i), width, dtype.str) for i in range(0, rows, step)]
        return out

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        if partition is None:  # nothing to read: no partition was planned
            return
        p, dtype = partition, np.dtype(partition.dtype)
        line = max(1, p.width * dtype.itemsize)
        step = max(1, STEP_BYTES // line)
        with _open(p.uri) as f:
            f.seek(p.offset)
            for i in range(0, p.rows, step):
                n = min(step, p.rows - i)
                raw = f.read(n * line)
                if len(raw) < n * line:
                    raise OSError(f"{p.uri} ends before its header says")
                a = np.frombuffer(raw, dtype=dtype).reshape(n, p.width)
                r, c = np.nonzero(a)
                cols = [pa.array(r.astype(np.int64) + p.first + i), pa.array(c.astype(np.int64)), pa.array(a[r, c].astype(float))]
                yield pa.RecordBatch.from_arrays(cols, ["row", "col", "count"])


class _Member(InputPartition):
    def __init__(self, uri: str, name: str):
        self.uri, self.name = uri, name


class _ZipReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[_Member]:
        out = []
        for system, at, uri in _files(self.path, ".zip"):
            with system.open_input_file(at) as f, zipfile.ZipFile(f) as z:
                out += [_Member(uri, x.filename) for x in z.infolist() if not x.is_dir()]
        return out

    def read(self, partition: _Member) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        with _open(partition.uri) as f, zipfile.ZipFile(f) as z, z.open(partition.name) as m:
            lines, first = [], 0
            for x in io.TextIOWrapper(m, encoding="utf-8", newline="\n"):
                lines.append(x.rstrip("\n").removesuffix("\r"))
                if len(lines) == LINES:
                    yield self._batch(partition, first, lines)
                    first, lines = first + len(lines), []
            if lines:
                yield self._batch(partition, first, lines)

    @staticmethod
    def _batch(p: _Member, first: int, lines: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([f"{p.uri}/{p.name}"] * len(lines)), pa.array(np.arange(first, first + len(lines))), pa.array(lines, pa.string())], ["file", "line", "value"])


class NpySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "npy_rows"

    def schema(self) -> str:
        return "row bigint, col bigint, count double"

    def reader(self, schema) -> DataSourceReader:
        return _NpyReader(self.options["path"], int(self.options.get("rangeBytes", str(RANGE_BYTES))))


class ZipSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "zip_lines"

    def schema(self) -> str:
        return "file string, line bigint, value string"

    def reader(self, schema) -> DataSourceReader:
        return _ZipReader(self.options["path"])


def read_npy(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """row, col, count of the non-zeros of an .npy matrix, or of those in a folder; ranges of rows in tasks of their own."""
    spark.dataSource.register(NpySource)
    return spark.read.format("npy_rows").option("rangeBytes", str(range_bytes)).load(path)


def read_zip(spark: SparkSession, path: str) -> DataFrame:
    """file, line, value of the text members of a .zip, or of those in a folder; each member in a task of its own, batch by batch."""
    spark.dataSource.register(ZipSource)
    return spark.read.format("zip_lines").load(path)
