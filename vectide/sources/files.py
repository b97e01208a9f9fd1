"""Vector files by suffix, and the binary and text formats around them."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import vecs

# Fixed values of the formats.
CODEBOOK_MAGIC = b"VPQC"
MANIFEST = "path string, id_offset bigint, level bigint"


def load_vectors(spark: SparkSession, path: str, limit: int = 0, kind: str | None = None) -> DataFrame:
    """vec_id, embedding of a .bvecs, .fvecs, .ivecs or Parquet file; the first ``limit`` by id, 0 for all."""
    if path.rstrip("/").endswith(".parquet") or kind == "parquet":
        df = spark.read.parquet(path)
        return df.orderBy("vec_id").limit(limit) if limit else df
    vecs.register(spark)
    options = {"path": path, "limit": str(limit)} | ({"kind": kind} if kind else {})
    return spark.read.format("vecs").options(**options).load()


def write_vectors(df: DataFrame, path: str, kind: str = "fvecs", vector: str = "embedding") -> None:
    """One file of all vectors in id order; tasks make the records, the driver appends them a partition at a time."""
    dtype = vecs.KINDS[kind][0]

    def records(batches):
        for batch in batches:
            column = batch.column(0)
            size = np.diff(column.offsets.to_numpy())
            if len(size) and (size == size[0]).all():
                x = np.asarray(column.flatten()).reshape(len(size), -1).astype(dtype)
                rows = np.concatenate([np.full((len(x), 1), size[0], "<i4").view(np.uint8), np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1)], axis=1)
                body = rows.tobytes()
            else:
                body = b"".join(struct.pack("<i", len(r)) + np.asarray(r).astype(dtype).tobytes() for r in column.to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array([body], pa.binary())], names=["body"])

    with open(path, "wb") as f:
        for r in df.orderBy("vec_id").select(vector).mapInArrow(records, "body binary").toLocalIterator():
            f.write(r.body)


def _read(path: str) -> bytes:
    with vecs.open_file(path) as f:
        return f.read()


def read_codebook(spark: SparkSession, path: str) -> DataFrame:
    """m, k, centroid of a codebook file."""
    raw = _read(path)
    if raw[:4] != CODEBOOK_MAGIC or len(raw) < 20:
        raise ValueError(f"{path} is no codebook")
    version, parts, codes, d = struct.unpack_from("<4I", raw, 4)
    if version != 1 or not parts * codes * d or len(raw) < 20 + 4 * parts * codes * d:
        raise ValueError(f"{path}: version {version}, {parts} x {codes} x {d} values in {len(raw)} bytes")
    values = np.frombuffer(raw, "<f4", parts * codes * d, 20).reshape(parts, codes, d)
    return spark.createDataFrame([(m, k, values[m, k].tolist()) for m in range(parts) for k in range(codes)], "m int, k int, centroid array<float>")


def write_codebook(codebook: DataFrame, path: str) -> None:
    from ..operators.pq import codebook_array

    book = codebook_array(codebook)
    with open(path, "wb") as f:
        f.write(CODEBOOK_MAGIC + struct.pack("<4I", 1, *book.shape) + book.astype("<f4").tobytes())


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """path, id_offset, level of a text manifest: fields between |, level 0 if left out, other lines ignored."""
    line = F.split("value", r"\|")
    rows = spark.read.text(path).select(line.alias("f")).where(F.size("f") >= 2)
    out = rows.select(F.col("f")[0].alias("path"), F.col("f")[1].try_cast("bigint").alias("id_offset"), F.coalesce(F.get("f", F.lit(2)).try_cast("bigint"), F.lit(0)).alias("level"))
    out = out.where(F.col("id_offset").isNotNull())
    if out.isEmpty():
        raise ValueError(f"{path} lists no segment")
    return out


def write_manifest(manifest: DataFrame, path: str) -> None:
    """The text form, published by a rename."""
    import os

    rows = manifest.select("path", "id_offset", "level").orderBy("id_offset").collect()  # one row a segment
    with open(f"{path}.tmp", "w") as f:
        f.writelines(f"{r.path}|{r.id_offset}|{r.level}\n" for r in rows)
    os.replace(f"{path}.tmp", path)
