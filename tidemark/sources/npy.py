"""Arrays in .npy files as a data source: `spark.read.format("npy").load(folder)`.

The header of a file says where its rows lie, so a file is cut into partitions of rows that are read from their offsets; no
task reads more than its rows. One-dimensional files are one row. Object arrays are refused; files in Fortran order, whose rows
are scattered, are one partition each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of samples in a partition, and rows in a batch.
PARTITION_BYTES, BATCH_ROWS = 32 << 20, 1024


@dataclass
class Rows(InputPartition):
    path: str
    first: int
    last: int
    width: int
    offset: int
    dtype: str
    fortran: bool


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def header(source) -> tuple[tuple[int, int], bool, np.dtype, int]:
    """((rows, columns), in Fortran order, type, offset of the samples) from an open file."""
    version = np.lib.format.read_magic(source)
    shape, fortran, dtype = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(source)
    if dtype.hasobject:
        raise ValueError("object arrays are not read")
    if not 1 <= len(shape) <= 2:
        raise ValueError(f"{len(shape)} dimensions; one or two are read")
    return ((1, shape[0]) if len(shape) == 1 else shape), fortran and len(shape) == 2, dtype, source.tell()


class NpyReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.bytes = int(options.get("partitionbytes", PARTITION_BYTES))

    def partitions(self) -> list[InputPartition]:
        system, base = _open(self.path)
        found = system.get_file_info(base)
        files = [found] if found.type == fs.FileType.File else system.get_file_info(fs.FileSelector(base, recursive=True))
        out = []
        for path in sorted(f.path for f in files if f.type == fs.FileType.File and f.path.endswith(".npy")):
            with system.open_input_file(path) as source:
                (rows, width), fortran, dtype, offset = header(source)
            step = rows if fortran else max(1, self.bytes // max(1, width * dtype.itemsize))
            shown = self.path.split("://")[0] + "://" + path if "://" in self.path else path
            out += [Rows(shown, k, min(k + step, rows), width, offset, dtype.str, fortran) for k in range(0, rows, max(1, step))]
        return out or [Rows("", 0, 0, 0, 0, "<f8", False)]

    def read(self, part: Rows) -> Iterator[pa.RecordBatch]:
        if part.first >= part.last:
            return
        system, path = _open(part.path)
        dtype = np.dtype(part.dtype)
        with system.open_input_file(path) as source:
            if part.fortran:
                source.seek(part.offset)
                whole = np.frombuffer(source.read(part.last * part.width * dtype.itemsize), dtype).reshape((part.last, part.width), order="F")
            for k in range(part.first, part.last, BATCH_ROWS):
                n = min(BATCH_ROWS, part.last - k)
                if part.fortran:
                    x = whole[k : k + n]
                else:
                    source.seek(part.offset + k * part.width * dtype.itemsize)
                    x = np.frombuffer(source.read(n * part.width * dtype.itemsize), dtype).reshape(n, part.width)
                samples = pa.ListArray.from_arrays(np.arange(0, n * part.width + 1, max(part.width, 1), dtype=np.int32) if part.width else np.zeros(n + 1, np.int32), pa.array(np.ascontiguousarray(x, float).ravel()))
                yield pa.RecordBatch.from_arrays([pa.array([part.path] * n), pa.array(range(k, k + n), pa.int64()), samples], names=["path", "signal_id", "x"])


class NpySource(DataSource):
    """Options: partitionBytes, the bytes of samples in a partition."""

    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return "path string, signal_id long, x array<double>"

    def reader(self, schema) -> NpyReader:
        return NpyReader({k.lower(): v for k, v in self.options.items()})


def register(spark: SparkSession) -> None:
    """Makes format("npy") known to the session."""
    spark.dataSource.register(NpySource)


