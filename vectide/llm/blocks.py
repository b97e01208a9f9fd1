"""Blocks of rows, and questions that blocks put to a hash-partitioned exchange.

Operators that compare all texts with each other (repeated spans, exact token
counts, repeated byte strings) need one answer for each of very many small
keys. Rows of one key each would cost far more than the keys. So rows are
packed into blocks of about ``BLOCK_BYTES`` of text, written once to the shared
folder; each block sends, to each part of the key space, one compressed array
of keys, and gets one compressed array of answers. A block asks for a key once,
however many of its rows have it, so a key that stands in a third of all rows
costs one entry a block.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytescan as bs
from .scratch import materialise

BLOCK_BYTES = 4 << 20
#: What a row counts for beside its bytes, so that very many short or empty texts fill a block too.
ROW_BYTES = 64
_BLOCK = "block bigint, size bigint, meta binary, body binary"
_MAIL = "block bigint, part int, body binary"


def _rows_out(schema: pa.Schema, columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(columns, schema=schema)


BLOCK_ARROW = pa.schema([("block", pa.int64()), ("size", pa.int64()), ("meta", pa.binary()), ("body", pa.binary())])
MAIL_ARROW = pa.schema([("block", pa.int64()), ("part", pa.int32()), ("body", pa.binary())])


def pack(docs: DataFrame, text: str, name: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Write ``docs`` as blocks. All columns but the text stay as they are in ``meta``."""
    return materialise(packed(docs, text, block_bytes), name)


def packed(docs: DataFrame, text: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The blocks of ``docs``, for one pass: numbers of blocks hold once they are written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        z, number, base = zstandard.ZstdCompressor(3), 0, TaskContext.get().partitionId() << 32
        held: list[pa.Table] = []
        size = 0

        def flush():
            nonlocal number, held, size
            table = pa.concat_tables(held).combine_chunks()
            buf, offs = bs.flat(table.column(text))
            sink = pa.BufferOutputStream()
            lengths = pa.array(np.diff(offs))
            rest = table.drop_columns([text]).append_column("\0null", table.column(text).is_null()).append_column("\0size", lengths)
            with pa.ipc.new_stream(sink, rest.schema) as w:
                w.write_table(rest)
            out = _rows_out(BLOCK_ARROW, {"block": [base + number], "size": [int(offs[-1])], "meta": [z.compress(sink.getvalue())], "body": [z.compress(buf.tobytes())]})
            number, held, size = number + 1, [], 0
            return out

        for batch in batches:
            table = pa.Table.from_batches([batch])
            _, offs = bs.flat(table.column(text))
            rest = (table.drop_columns([text]).nbytes // max(1, table.num_rows)) + ROW_BYTES  # a row's, on average
            weight = offs + np.arange(len(offs)) * rest
            for i, j in bs.slices(weight, block_bytes):
                held.append(table.slice(i, j - i))
                size += int(weight[j] - weight[i])
                if size >= block_bytes // 2:
                    yield flush()
        if held:
            yield flush()
        bs.release()

    return docs.mapInArrow(run, _BLOCK)


class Block:
    """One unpacked block: ``rest`` has the other columns; texts are in buf, offs."""

    def __init__(self, meta: bytes, body: bytes):
        z = zstandard.ZstdDecompressor()
        table = pa.ipc.open_stream(z.decompress(meta)).read_all().combine_chunks()
        self.null = table.column("\0null").to_numpy(zero_copy_only=False)
        self.offs = np.concatenate([[0], np.cumsum(table.column("\0size").to_numpy())]).astype(np.int64)
        self.rest = table.drop_columns(["\0null", "\0size"])
        self.buf = np.frombuffer(z.decompress(body), np.uint8) if self.offs[-1] else np.zeros(0, np.uint8)

    def ids(self, column: str) -> np.ndarray:
        """The ids as 64-bit integers; null sorts last."""
        c = self.rest.column(column).cast(pa.int64())
        return c.fill_null(np.iinfo(np.int64).max).to_numpy()

    def texts(self) -> Iterator[bytes]:
        for i, j in zip(self.offs[:-1], self.offs[1:]):
            yield self.buf[i:j].tobytes()


def _block_at(batch: pa.RecordBatch, i: int) -> Block:
    return Block(batch.column("meta")[i].as_py(), batch.column("body")[i].as_py())


def text_bytes(blocks: DataFrame) -> int:
    """Bytes of all texts; reads the column of sizes only."""
    return int(blocks.agg(F.sum("size")).first()[0] or 0)


def ask(blocks: DataFrame, question: Callable[[Block], Iterator[tuple[int, bytes]]], replies: bool = False) -> DataFrame:
    """Rows (block, part, body) with what ``question(block[, answers])`` yields."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                number, b = batch.column("block")[i].as_py(), _block_at(batch, i)
                more = (answers_of(batch.column("mail")[i].as_py()),) if replies else ()
                part, body, size = [], [], 0
                for p, x in question(b, *more):
                    part.append(p)
                    body.append(x)
                    size += len(x)
                    if size > 8 << 20:
                        yield _rows_out(MAIL_ARROW, {"block": [number] * len(part), "part": part, "body": body})
                        part, body, size = [], [], 0
                if part:
                    yield _rows_out(MAIL_ARROW, {"block": [number] * len(part), "part": part, "body": body})
                del b
                bs.release()

    return blocks.mapInArrow(run, _MAIL)


def answers_of(mail) -> dict[int, bytes]:
    return {x["part"]: x["body"] for x in mail or ()}


def answer(asked: DataFrame, reply: Callable[[list[bytes]], list[bytes | None]]) -> DataFrame:
    """Bring the questions of a part together; ``reply`` returns an answer for each, or None."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        found = reply(table.column("body").to_pylist())
        bs.release()
        keep = pa.array([x is not None for x in found])
        return pa.table({"block": table.column("block"), "part": table.column("part"), "body": pa.array(found, pa.binary())}, schema=MAIL_ARROW).filter(keep)

    return asked.groupBy("part").applyInArrow(run, _MAIL)


def deliver(blocks: DataFrame, answers: DataFrame) -> DataFrame:
    """Each block with its answers, a list of (part, body)."""
    mail = answers.groupBy("block").agg(F.collect_list(F.struct("part", "body")).alias("mail"))
    # always by shuffle: the blocks' answers grow with the input
    return blocks.join(mail.hint("merge"), "block", "left")


def per_block(delivered: DataFrame, out: Callable[[Block, dict[int, bytes]], pa.Table], schema) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                b = _block_at(batch, i)
                yield from out(b, answers_of(batch.column("mail")[i].as_py())).to_batches()
                del b
                bs.release()

    return delivered.mapInArrow(run, schema)


def split_parts(h: np.ndarray, parts: int, bits: int = 64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, low ``bits`` of the hashes, bounds): hashes by part, sorted by those bits within each."""
    part = (h >> np.uint64(40)) % np.uint64(parts)
    low = h & np.uint64((1 << bits) - 1)
    order = np.lexsort((low, part))
    bounds = np.searchsorted(part[order], np.arange(parts + 1))
    return order, low[order], bounds


def frame(*pieces: bytes) -> bytes:
    return b"".join(struct.pack("<Q", len(x)) + x for x in pieces)


def unframe(body: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(body):
        (n,) = struct.unpack_from("<Q", body, at)
        out.append(body[at + 8 : at + 8 + n])
        at += 8 + n
    return out


__all__ = ["Block", "answer", "ask", "deliver", "frame", "pack", "per_block", "split_parts", "text_bytes", "unframe"]
