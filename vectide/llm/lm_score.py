"""Bigram language model in a log-frequency Bloom filter.

Counts are gathered over all training texts. Token counts are exact: blocks ask
hash parts for the counts of the tokens they hold. Bigrams, held-out ones too, go
to the same kind of parts; each part puts (bigram, level) pairs for the levels 1 to
1 + floor(log2 count) into its slices of a Bloom filter and probes level after level
until one is absent, which gives the quantised count of each bigram asked for. The
probability of a word w after h is
``(c(h w) + mu * p(w)) / (c(h) + mu)`` with ``p(w) = (c(w) + 1) / (N + V + 1)``.

A slice has ``BITS`` bits a (bigram, level) pair at every size of the input, so its
error rate is the same too. A part whose slice would take more than ``filter_mb`` at
a byte a bit cuts its keys into ranges with a slice each. The number of parts follows
the bytes of the texts, so a score depends on the data and not on the cluster.

Defined cases: a null text is empty; an empty text is one end token; a null id
counts as the empty string in the split into training and held-out texts;
without training tokens all counts are 0. Repeated rows count, and are scored, one by
one. The result has the id and the columns below; no other column is read, so
names of other columns don't matter.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import bytescan as bs
from .blocks import Block, answer, ask, deliver, frame, pack, per_block, split_parts, text_bytes, unframe
from .scratch import materialise, parts_of

U = np.uint64
END, BEGIN = U(0x5851F42D4C957F2D), U(0x14057B7EF767814F)
BITS, PROBES, FILTER_MB, MU = 12, 4, 64, 50.0
#: Bytes of text of a hash part.
PART_BYTES = 8 << 20
#: Smaller blocks than the default: the counts of a block's tokens and pairs are held beside its text.
BLOCK_BYTES = 1 << 20


def held_out(ids: pa.ChunkedArray, modulus: int, remainder: int) -> np.ndarray:
    return np.array([zlib.crc32(b"" if i is None else str(i).encode()) % modulus == remainder for i in ids.to_pylist()], bool)


def stream(b: Block):
    """Hashes of the tokens of every text, an end token after each, and their rows."""
    h, _, _, row = bs.token_hashes(b.buf, b.offs, bs.WORDS_LOWER)
    n = len(b.offs) - 1
    at = np.searchsorted(row, np.arange(n), "right")
    return np.insert(h, at, END), np.insert(row, at, np.arange(n))


def bigrams(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each token with the one before it, hash of the one before)."""
    before = np.empty_like(h)
    if len(h):
        before[1:] = h[:-1]
        before[np.flatnonzero(np.r_[True, row[1:] != row[:-1]])] = BEGIN
    return bs.mix(before * U(bs.BASE) + h), before


def _slots(key: np.ndarray, level: int, probe: int, size: np.ndarray) -> np.ndarray:
    return (bs.mix(key + U((level * 16 + probe + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) % size).astype(np.int64)


def _merge(hs: list[np.ndarray], cs: list[np.ndarray]):
    """(key, total, inverse) over the concatenation."""
    h = np.concatenate(hs)
    key, inverse = np.unique(h, return_inverse=True)
    return key, np.bincount(inverse, weights=np.concatenate(cs), minlength=len(key)).astype(np.int64), inverse


def _counts(bodies: list[bytes]):
    z = zstandard.ZstdDecompressor()
    got = [unframe(x) for x in bodies]
    hs = [np.cumsum(bs.unpack_ints(x[0], z), dtype=U) for x in got]
    return hs, [bs.unpack_ints(x[1], z).astype(np.int64) for x in got]


def _question(parts: int, id_col: str, split: tuple[int, int], pairs: bool):
    def question(b: Block):
        z = zstandard.ZstdCompressor(1)
        h, row = stream(b)
        train = ~held_out(b.rest.column(id_col), *split)[row]
        if pairs:
            h = bigrams(h, row)[0]
        key, inverse = np.unique(h, return_inverse=True)
        count = np.bincount(inverse, weights=train, minlength=len(key)).astype(np.int64)
        order, low, bounds = split_parts(key, parts, 40 if pairs else 64)
        for p in np.flatnonzero(np.diff(bounds)):
            at = slice(bounds[p], bounds[p + 1])
            yield int(p), frame(bs.pack_ints(bs.deltas(low[at]), z), bs.pack_ints(count[order[at]], z))

    return question


def _token_reply(bodies: list[bytes]) -> list[bytes]:
    c = zstandard.ZstdCompressor(1)
    hs, cs = _counts(bodies)
    _, total, inverse = _merge(hs, cs)
    stats = np.array([total.sum(), (total > 0).sum()], "<u8").tobytes()
    cuts = np.cumsum([len(x) for x in hs])[:-1]
    return [frame(bs.pack_ints(x, c)) + stats for x in np.split(total[inverse], cuts)]


def _slices(key: np.ndarray, total: np.ndarray, most_bits: int, bits: int):
    """(range of the sorted keys, its slice of the filter): about ``most_bits`` each, ``bits`` for every (key, level)."""
    level = np.frexp(total.astype(float))[1]  # 1 + floor(log2 count); 0 for 0
    piece = np.cumsum(bits * level) // max(64, most_bits)
    cuts = np.flatnonzero(np.r_[True, piece[1:] != piece[:-1], True]) if len(key) else []
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        own = level[lo:hi]
        on = np.zeros(max(64, bits * int(own.sum())) // 8 * 8, bool)
        for j in range(1, int(own.max()) + 1):
            k = key[lo:hi][own >= j]
            for i in range(PROBES):
                on[_slots(k, j, i, U(len(on)))] = True
        yield slice(lo, hi), np.packbits(on).tobytes()


def _pair_reply(most_bits: int, bits: int):
    """The levels of the asked pairs, as the filter has them."""

    def reply(bodies: list[bytes]) -> list[bytes]:
        c = zstandard.ZstdCompressor(1)
        hs, cs = _counts(bodies)
        key, total, inverse = _merge(hs, cs)
        cuts = np.cumsum([len(x) for x in hs])[:-1]
        del hs, cs
        level = np.zeros(len(key), np.uint64)
        for at, body in _slices(key, total, most_bits, bits):
            level[at] = Filter(body).level(key[at])
        return [bs.pack_ints(x, c) for x in np.split(level[inverse], cuts)]

    return reply


class Filter:
    """A slice, and the quantised count of any of its keys."""

    def __init__(self, body: bytes):
        self.bits, self.size = np.frombuffer(body, np.uint8), U(len(body) * 8)

    def level(self, key: np.ndarray) -> np.ndarray:
        out = np.zeros(len(key), U)
        live = np.arange(len(key))
        for j in range(1, 64):
            for i in range(PROBES):
                slot = _slots(key[live], j, i, self.size)
                live = live[(self.bits[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8)) & 1 == 1]
            if not len(live):
                break
            out[live] = j
        return out

    def count(self, key: np.ndarray) -> np.ndarray:
        return quantised(self.level(key))


def quantised(level: np.ndarray) -> np.ndarray:
    """The middle of [2**(level-1), 2**level), 0 at level 0."""
    return np.where(level > 0, (3 * 2.0 ** (level.astype(float) - 1) - 1) / 2, 0.0)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", split: tuple[int, int] = (7, 2), mu: float = MU, filter_mb: int = FILTER_MB, bits: int = BITS) -> DataFrame:
    """Per row: id, held_out, n_tokens, n_known, train_tokens, base_score, score, known_pairs."""
    blocks = pack(docs.select(id_col, text_col), text_col, "lm", BLOCK_BYTES)
    parts = parts_of(text_bytes(blocks), PART_BYTES)
    levels = materialise(answer(ask(blocks, _question(parts, id_col, split, True)), _pair_reply(int(filter_mb * (1 << 20)), bits)), "lm-levels")
    counts = materialise(answer(ask(blocks, _question(parts, id_col, split, False)), _token_reply), "lm-counts")
    stats = counts.groupBy("part").agg(F.min(F.expr("substring(body, -16, 16)")).alias("s")).collect()
    n, v = (int(x) for x in sum((np.frombuffer(bytes(r.s), "<u8").astype(np.int64) for r in stats), np.zeros(2, np.int64)))
    schema = T.StructType([docs.schema[id_col], T.StructField("held_out", T.BooleanType())] + [T.StructField(x, T.LongType()) for x in ("n_tokens", "n_known", "train_tokens")] + [T.StructField(x, T.DoubleType()) for x in ("base_score", "score")] + [T.StructField("known_pairs", T.LongType())])
    arrow = to_arrow_schema(schema)
    # the number of training texts is the count of the end token; every block asks for it
    def out(b: Block, mail: dict[int, bytes]) -> pa.Table:
        z = zstandard.ZstdDecompressor()
        h, row = stream(b)
        rows = len(b.offs) - 1
        key, inverse = np.unique(h, return_inverse=True)
        order, _, bounds = split_parts(key, parts, 64)
        count = np.zeros(len(key), np.int64)
        for p, body in mail.items():
            if p >= parts:
                continue
            count[order[bounds[p] : bounds[p + 1]]] = bs.unpack_ints(unframe(body[:-16])[0], z).astype(np.int64)
        c = count[inverse]
        base = (c + 1) / (n + v + 1)
        pair, before = bigrams(h, row)
        c_before = np.empty(len(h), np.int64)
        if len(h):
            c_before[1:] = c[:-1]
            c_before[before == BEGIN] = count[np.searchsorted(key, END)]
        distinct, where = np.unique(pair, return_inverse=True)
        order, _, bounds = split_parts(distinct, parts, 40)
        level = np.zeros(len(distinct), U)
        for p, body in mail.items():
            if p >= parts:
                level[order[bounds[p - parts] : bounds[p - parts + 1]]] = bs.unpack_ints(body, z)
        both = np.minimum(quantised(level)[where], np.minimum(c, c_before))
        p = (both + mu * base) / (c_before + mu)
        total = lambda w: np.bincount(row, weights=w, minlength=rows)
        columns = [b.rest.column(id_col), pa.array(held_out(b.rest.column(id_col), *split)), np.bincount(row, minlength=rows), total(c > 0).astype(np.int64), np.full(rows, n, np.int64), total(np.log10(base)), total(np.log10(p)), total(both > 0).astype(np.int64)]
        return pa.Table.from_arrays([(x if isinstance(x, pa.ChunkedArray) else pa.chunked_array([x])).cast(t.type) for x, t in zip(columns, arrow)], schema=arrow)

    # the answers on pairs have the part numbers after those on tokens
    answers = counts.unionByName(levels.withColumn("part", F.col("part") + parts))
    return per_block(deliver(blocks, answers), out, schema)


def digest(docs: DataFrame) -> DataFrame:
    """The columns of ``op6``, and known_pairs."""
    return score(docs)
