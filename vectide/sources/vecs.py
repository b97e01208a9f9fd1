"""Spark data source for .fvecs, .bvecs and .ivecs files.

A record is a little-endian int32 dimension and so many float32, uint8 or int32.
All records have the dimension of the first, so a file is cut into ranges of
records that tasks read on their own. A short last record, or a dimension below
1, ends the file; another dimension than the first one's is an error; so is a
file without records.

Options: ``path``, ``kind`` (fvecs, bvecs, ivecs; default: by suffix, fvecs for
others), ``limit`` (first records only, 0 for all), ``records`` (a range's size).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

KINDS = {"fvecs": (np.dtype("<f4"), pa.float32(), "float"), "bvecs": (np.dtype("u1"), pa.float32(), "float"), "ivecs": (np.dtype("<i4"), pa.int32(), "int")}


def open_file(path: str):
    from pyarrow import fs

    if "://" in path:
        store, path = fs.FileSystem.from_uri(path)
    else:
        store, path = fs.LocalFileSystem(), path.removeprefix("file:")
    return store.open_input_file(path)


def kind_of(path: str, kind: str | None = None) -> str:
    found = kind or path.rpartition(".")[2]
    return found if found in KINDS else "fvecs"


@dataclass
class Records(InputPartition):
    """A range of records, of ``dim`` dimensions each."""

    first: int
    count: int
    dim: int


class VecsReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.kind = kind_of(self.path, options.get("kind"))
        self.limit = int(options.get("limit", 0))
        self.step = int(options.get("records", 100_000))
        self.dtype, self.arrow, _ = KINDS[self.kind]

    def partitions(self) -> list[Records]:
        with open_file(self.path) as f:
            head = np.frombuffer(f.read(4), "<i4")
            size = f.size()
        if not len(head) or head[0] < 1:
            raise ValueError(f"{self.path} has no records")
        dim = int(head[0])
        n = size // self.stride(dim)
        n = min(n, self.limit) if self.limit else n
        if not n:
            raise ValueError(f"{self.path} has no whole record")
        return [Records(i, min(self.step, n - i), dim) for i in range(0, n, self.step)]

    def stride(self, dim: int) -> int:
        return 4 + dim * self.dtype.itemsize

    def read(self, part: Records) -> Iterator[pa.RecordBatch]:
        stride = self.stride(part.dim)
        with open_file(self.path) as f:
            f.seek(part.first * stride)
            raw = np.frombuffer(f.read(part.count * stride), np.uint8).reshape(-1, stride)
        dims = raw[:, :4].copy().view("<i4").ravel()
        wrong = np.flatnonzero(dims != part.dim)
        if len(wrong):
            if dims[wrong[0]] >= 1:
                raise ValueError(f"{self.path}: record {part.first + wrong[0]} has {dims[wrong[0]]} dimensions, the first {part.dim}")
            raw = raw[: wrong[0]]
        for i in range(0, len(raw), 10_000):
            rows = raw[i : i + 10_000, 4:].copy().view(self.dtype)
            flat = pa.array(rows.ravel().astype(self.arrow.to_pandas_dtype()))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, rows.size + 1, part.dim, dtype=np.int32)), flat)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(part.first + i, part.first + i + len(rows))), lists], names=["vec_id", "embedding"])


class VecsDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "vecs"

    def schema(self) -> str:
        return f"vec_id bigint, embedding array<{KINDS[kind_of(self.options['path'], self.options.get('kind'))][2]}>"

    def reader(self, schema) -> VecsReader:
        return VecsReader(dict(self.options))


def register(spark) -> None:
    spark.dataSource.register(VecsDataSource)
