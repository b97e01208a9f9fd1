"""WARC records in seekable Zstandard bundles.

Records are grouped into independent Zstandard frames; a bundle ends with a
skippable frame that holds the seek table of the public seekable format (sizes
of every frame, their number, and a closing magic number), so any Zstandard
reader reads the bundle and ours reads single frames. An index maps each record
to its bundle, frame and offset in the frame.

Records with equal payloads (by SHA-1 and length) of at least ``least_bytes``
are written once, as the response with the largest id; the others are revisits
of it. The largest id of each digest is aggregated before the shuffle, and the
join back is an equi-join of which Spark splits hot partitions.

Each task writes its bundles to the given folder under names that no other
attempt uses; the index is written by Spark's committer, and readers take only
bundles that the index names. So a task that is lost or run twice leaves at
most files that nobody reads.

Defined cases: a null payload is empty; a null URL is an empty one; line ends in
a URL become spaces; a null id is a response only if no equal payload has an
id; rows that repeat an id and payload are all responses or all revisits; an
empty table gives an empty index; columns besides id, URL and payload are not
read, so their names don't matter.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import few, materialise, own_dir

FRAME_BYTES = 512 << 10
BUNDLE_BYTES = 32 << 20
#: Most names of files that are broadcast: some 20 MB.
STALE_NAMES = 1 << 18
# Fixed values of the seekable format.
SKIPPABLE_MAGIC, SEEK_MAGIC = 0x184D2A5E, 0x8F92EAB1
DATE = "2024-01-01T00:00:00Z"

_INDEX = "bundle string, frame int, frame_start bigint, frame_size bigint, offset bigint, length bigint, record_id string"
_RECORD = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary"


def verdicts(pages: DataFrame, id_col: str, url_col: str, payload_col: str, least_bytes: int) -> DataFrame:
    """id, url, payload, digest, last (the id of the response; null for one without an id)."""
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("size", F.length("payload"))
    last = rows.select("id", "digest", "size").groupBy("digest", "size").agg(F.max("id").alias("last"))
    joined = rows.join(last, ["digest", "size"])
    return joined.select("id", "url", "payload", "digest", F.when(F.col("size") >= least_bytes, F.col("last")).otherwise(F.col("id")).alias("last"))


def record(page, url: str, payload: bytes, digest: str, last) -> bytes:
    """One WARC/1.1 record."""
    b32 = base64.b32encode(bytes.fromhex(digest)).decode()
    revisit = page != last
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{page}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {' '.join(url.splitlines())}",
        f"WARC-Payload-Digest: sha1:{b32}",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{last}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def seek_table(sizes: list[tuple[int, int]]) -> bytes:
    body = b"".join(struct.pack("<II", *x) for x in sizes) + struct.pack("<IBI", len(sizes), 0, SEEK_MAGIC)
    return struct.pack("<II", SKIPPABLE_MAGIC, len(body)) + body


def frames(bundle: bytes) -> list[tuple[int, int, int]]:
    """(start, compressed size, size) of every frame, from the footer."""
    n, flags, magic = struct.unpack("<IBI", bundle[-9:])
    if magic != SEEK_MAGIC:
        raise ValueError("the bundle has no seek table")
    each = 12 if flags & 0x80 else 8
    at, out, start = len(bundle) - 9 - n * each, [], 0
    for k in range(n):
        packed, size = struct.unpack_from("<II", bundle, at + k * each)
        out.append((start, packed, size))
        start += packed
    return out


def records_of(data: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, headers, block) of the records of a frame."""
    at = 0
    while at < len(data):
        head_end = data.index(b"\r\n\r\n", at)
        head = dict(x.split(": ", 1) for x in data[at:head_end].decode().split("\r\n")[1:])
        size = int(head["Content-Length"])
        yield at, head, data[head_end + 4 : head_end + 4 + size]
        at = head_end + 8 + size


def _open(folder: str):
    from pyarrow import fs

    if "://" in folder or folder.startswith("file:"):
        return fs.FileSystem.from_uri(folder if "://" in folder else "file://" + folder[5:])
    return fs.LocalFileSystem(), folder


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Write the bundles into ``folder``; the index of their records, already written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = _open(folder)
        store.create_dir(path, recursive=True)
        z = zstandard.ZstdCompressor(level=3, write_content_size=True)
        out: list[bytes] = []
        sizes: list[tuple[int, int]] = []
        held = bytearray()
        rows: list[tuple] = []
        here: list[tuple] = []
        total = 0

        def close_frame():
            nonlocal held, here, total
            if held:
                packed = z.compress(bytes(held))
                rows.extend((len(sizes), total, len(packed), *x) for x in here)
                sizes.append((len(packed), len(held)))
                out.append(packed)
                total += len(packed)
                held, here = bytearray(), []

        def close_bundle():
            nonlocal out, sizes, rows, total
            close_frame()
            name = f"{uuid.uuid4().hex}.warc.zst"
            with store.open_output_stream(f"{path}/{name}", compression=None) as f:
                f.write(b"".join(out) + seek_table(sizes))
            columns = list(zip(*rows))
            batch = pa.RecordBatch.from_arrays(
                [pa.array([name] * len(rows))] + [pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()))],
                names=["bundle", "frame", "frame_start", "frame_size", "offset", "length", "record_id"],
            )
            out, sizes, rows, total = [], [], [], 0
            return batch

        for batch in batches:
            for page, url, payload, digest, last in zip(*(c.to_pylist() for c in batch.columns)):
                x = record(page, url, payload, digest, last)
                here.append((len(held), len(x), f"urn:page:{page}"))
                held += x
                if len(held) >= frame_bytes:
                    close_frame()
                    if total >= bundle_bytes:
                        yield close_bundle()
        if held or out:
            yield close_bundle()

    return materialise(verdicts(pages, id_col, url_col, payload_col, least_bytes).mapInArrow(run, _INDEX), "warc-index")


def _page(urn: str | None) -> int | None:
    found = (urn or "").strip("<>").rpartition(":")[2]
    return None if found in ("", "None") else int(found)


def parse(head: dict[str, str], block: bytes) -> tuple:
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = head["WARC-Type"]
    if kind == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
        raise ValueError(f"the payload of {head['WARC-Record-ID']} doesn't have its digest")
    size = int(http.rpartition(b"Content-Length: ")[2])
    return _page(head["WARC-Record-ID"]), head.get("WARC-Target-URI", ""), size, digest, kind, _page(head.get("WARC-Refers-To")), payload if kind == "response" else None


def read(spark: SparkSession, folder: str, index: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records of the bundles that the index names."""
    schema = _RECORD if with_payload else _RECORD.rpartition(",")[0]
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()][: 7 if with_payload else 6]
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdDecompressor()
        for batch in batches:
            for content in batch.column(0):
                bundle = content.as_buffer()
                for start, packed, size in frames(memoryview(bundle)):
                    data = z.decompress(memoryview(bundle)[start : start + packed], max_output_size=size)
                    rows = [parse(head, block)[: len(types)] for _, head, block in records_of(data)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder)
    files = files.withColumn("bundle", F.element_at(F.split("path", "/"), -1))
    # names are compared first, without contents: what the index doesn't name are a few files of lost attempts
    stale = files.select("bundle").join(index.select("bundle").distinct(), "bundle", "left_anti")
    return files.join(few(stale, STALE_NAMES), "bundle", "left_anti").select("content").mapInArrow(run, schema)


def fetch(folder: str, entry) -> tuple:
    """One record by its row of the index: reads and unpacks its frame only."""
    store, path = _open(folder)
    with store.open_input_file(f"{path}/{entry['bundle']}") as f:
        f.seek(entry["frame_start"])
        data = zstandard.ZstdDecompressor().decompress(f.read(entry["frame_size"]))
    _, head, block = next(records_of(data[entry["offset"] : entry["offset"] + entry["length"]]))
    return parse(head, block)


def digest(pages: DataFrame) -> DataFrame:
    """The columns of ``op2``."""
    spark = pages.sparkSession
    folder = f"{own_dir(spark)}/warc-{uuid.uuid4().hex}"
    index = write(pages, folder)
    if index.isEmpty():
        return spark.createDataFrame([], _RECORD).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    return read(spark, folder, index, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
