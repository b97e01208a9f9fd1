"""Segment files: a Spark data source over their records, their codebooks, and a writer of one file a segment.

A file has a header of ``HEADER_BYTES``, ``count`` records of dim float32 and
degree uint32, and, if the header names parts, the codes: their own header
(parts, codes, dimensions of a part), the centroids, and a byte a part and record.

Options: ``path``, ``id_offset`` (added to a record's number), ``records`` (a range's size).
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .vecs import open_file

# Fixed values of the format.
MAGIC, HEADER_BYTES, VERSION = b"VSG1", 4096, 2
SCHEMA = "local_id int, vec_id bigint, embedding array<float>, neighbors array<int>, pq_code array<smallint>, is_entry boolean"


@dataclass(frozen=True)
class Header:
    dim: int
    count: int
    degree: int
    entry: int
    data: int
    parts: int
    codes: int
    d_sub: int

    @property
    def record(self) -> int:
        return 4 * (self.dim + self.degree)

    @property
    def centroids(self) -> int:
        """Where the centroids begin."""
        return self.data + self.count * self.record + 12


def header(path: str) -> Header:
    """The checked header of a segment file."""
    with open_file(path) as f:
        raw = f.read(HEADER_BYTES)
        if raw[:4] != MAGIC or len(raw) < 48:
            raise ValueError(f"{path} is no segment")
        version, dim, count, degree, entry, record, data = struct.unpack_from("<IIQIIIQ", raw, 4)
        parts, codes = struct.unpack_from("<2I", raw, 40) if version >= 2 else (0, 0)
        if not dim or not count or record != 4 * (dim + degree):
            raise ValueError(f"{path}: {count} records of {record} bytes for {dim} dimensions and degree {degree}")
        d_sub = 0
        if parts:
            f.seek(data + count * record)
            m, k, d_sub = struct.unpack("<3I", f.read(12))
            if (m, k) != (parts, codes):
                raise ValueError(f"{path}: codes of {m} parts and {k} centroids, the header has {parts} and {codes}")
    return Header(dim, count, degree, entry, data, parts, codes, d_sub)


@dataclass
class Range(InputPartition):
    first: int
    count: int


class SegmentReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.offset, self.step = options["path"], int(options.get("id_offset", 0)), int(options.get("records", 50_000))
        self.header = header(self.path)

    def partitions(self) -> list[Range]:
        return [Range(i, min(self.step, self.header.count - i)) for i in range(0, self.header.count, self.step)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        h = self.header
        with open_file(self.path) as f:
            for first in range(part.first, part.first + part.count, 5000):
                n = min(5000, part.first + part.count - first)
                f.seek(h.data + first * h.record)
                rows = np.frombuffer(f.read(n * h.record), np.uint8).reshape(n, h.record)
                x, near = rows[:, : 4 * h.dim].copy().view("<f4"), rows[:, 4 * h.dim :].copy().view("<i4")
                codes = pa.nulls(n, pa.list_(pa.int16()))
                if h.parts:
                    f.seek(h.centroids + 4 * h.parts * h.codes * h.d_sub + first * h.parts)
                    codes = _lists(np.frombuffer(f.read(n * h.parts), np.uint8).reshape(n, h.parts).astype(np.int16), pa.int16())
                local = np.arange(first, first + n)
                columns = [pa.array(local.astype(np.int32)), pa.array(local + self.offset), _lists(x, pa.float32()), _lists(near, pa.int32()), codes, pa.array(local == h.entry)]
                yield pa.RecordBatch.from_arrays(columns, names=["local_id", "vec_id", "embedding", "neighbors", "pq_code", "is_entry"])


def _lists(x: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32) if x.shape[1] else np.zeros(len(x) + 1, np.int32)), pa.array(x.ravel(), kind))


class SegmentDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "segment"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> SegmentReader:
        return SegmentReader(dict(self.options))


def read_segment(spark: SparkSession, path: str, id_offset: int = 0, records: int = 50_000) -> DataFrame:
    """Nodes of a segment file: local_id, vec_id, embedding, neighbors, pq_code, is_entry; tasks read ranges of records."""
    spark.dataSource.register(SegmentDataSource)
    return spark.read.format("segment").options(path=path, id_offset=str(id_offset), records=str(records)).load()


def segment_codebook(spark: SparkSession, path: str) -> DataFrame | None:
    """m, k, centroid of the file's codes; None if it has none."""
    h = header(path)
    if not h.parts:
        return None
    with open_file(path) as f:
        f.seek(h.centroids)
        x = np.frombuffer(f.read(4 * h.parts * h.codes * h.d_sub), "<f4").reshape(h.parts, h.codes, h.d_sub)
    return spark.createDataFrame([(m, k, x[m, k].tolist()) for m in range(h.parts) for k in range(h.codes)], "m int, k int, centroid array<float>")


def write_segments(nodes: DataFrame, folder: str, codebook: DataFrame | None = None) -> DataFrame:
    """Write each segment of nodes (segment_id, local_id, vec_id, embedding, neighbors, pq_code, is_entry) as one file, in
    its own task; rows (segment_id, path, id_offset, count) of the files, already written.

    Local ids must be 0, 1, 2, ... in the order of ids. A file has its name only once it is whole.
    """
    from ..operators.pq import codebook_array

    sent = nodes.sparkSession.sparkContext.broadcast(None if codebook is None else codebook_array(codebook).astype("<f4"))

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("local_id")
        n, book = t.num_rows, sent.value
        x, near = (np.asarray(t.column(c).combine_chunks().flatten()).reshape(n, -1) for c in ("embedding", "neighbors"))
        entry = int(np.flatnonzero(t.column("is_entry").to_numpy(zero_copy_only=False))[0])
        parts = (0, 0) if book is None else book.shape[:2]
        head = MAGIC + struct.pack("<IIQIIIQ", VERSION, x.shape[1], n, near.shape[1], entry, 4 * (x.shape[1] + near.shape[1]), HEADER_BYTES) + struct.pack("<2I", *parts)
        body = np.concatenate([np.ascontiguousarray(x, "<f4").view(np.uint8).reshape(n, -1), np.ascontiguousarray(near, "<u4").view(np.uint8).reshape(n, -1)], axis=1).tobytes()
        tail = b""
        if book is not None:
            codes = np.asarray(t.column("pq_code").combine_chunks().flatten()).astype(np.uint8)
            tail = struct.pack("<3I", *book.shape) + book.tobytes() + codes.tobytes()
        segment = t.column("segment_id")[0].as_py()
        name = f"segment_{segment}.vsg"
        store, at = _store(folder)
        store.create_dir(at, recursive=True)
        held = f"{at}/.{uuid.uuid4().hex}.tmp"
        with store.open_output_stream(held, compression=None) as f:
            f.write(head.ljust(HEADER_BYTES, b"\0") + body + tail)
        store.move(held, f"{at}/{name}")
        least = min(t.column("vec_id").to_pylist())
        return pa.table([pa.array([segment]), pa.array([f"{folder.rstrip('/')}/{name}"]), pa.array([least]), pa.array([n])], names=["segment_id", "path", "id_offset", "count"])

    rows = nodes.select("segment_id", "local_id", "vec_id", "embedding", "neighbors", "pq_code", "is_entry")
    found = rows.groupBy("segment_id").applyInArrow(run, "segment_id bigint, path string, id_offset bigint, count bigint").collect()  # one row a file
    return nodes.sparkSession.createDataFrame(found, "segment_id bigint, path string, id_offset bigint, count bigint")


def _store(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder.removeprefix("file:"))
