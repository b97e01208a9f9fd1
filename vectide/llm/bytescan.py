"""Vectorised work on the bytes of many texts at once.

A text column arrives as one Arrow buffer with offsets; tokens, rolling hashes
and windows are computed over the whole buffer with NumPy, never per row.
Hashes are polynomial prefix hashes modulo 2**64, so the hash of any span is
two look-ups and a multiplication.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
BASE = 0x9E3779B97F4A7C15
_powers: dict[str, np.ndarray] = {}

#: Bytes of text handled at once; bounds the memory of the NumPy work arrays.
SLICE_BYTES = 1 << 20
#: Powers of the base that stay in a worker.
POWERS = SLICE_BYTES + 4096


_libc = None

#: What an operator keeps in a worker between its tasks, by the operator's name.
_kept: dict[str, dict] = {}


def kept_by(operator: str) -> dict:
    """A table that outlives tasks, until another operator runs in the worker."""
    return _kept.setdefault(operator, {})


def release(operator: str = "") -> None:
    """Give freed memory back: Python workers live on between tasks, and share the executor's memory.

    So go long tables of powers, and what operators other than ``operator`` keep.
    """
    global _libc
    if len(_powers.get("p", ())) > POWERS:
        _powers.clear()
    for name, kept in _kept.items():
        if name != operator:
            kept.clear()
    pa.default_memory_pool().release_unused()
    if _libc is None:
        try:
            _libc = ctypes.CDLL("libc.so.6")
        except OSError:
            _libc = False
    if _libc:
        _libc.malloc_trim(0)


def _table(lower: bool, separators: bytes, others_separate: bool = False) -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    if lower:
        table[65:91] += 32
    table[list(separators)] = 0
    return table


WHITE = bytes([0x20, *range(0x09, 0x0E)])
#: Words are runs of anything but the six white-space bytes; A-Z lower-cased.
WORDS_LOWER = _table(True, WHITE + b"\0")
WORDS_LOWER[0] = 255  # a NUL belongs to words; 255 never occurs in UTF-8
#: Words are runs of digits, letters a-z after lower-casing, and bytes from 0x80 on.
ALNUM_LOWER = np.zeros(256, np.uint8)
ALNUM_LOWER[0x30:0x3A] = np.arange(0x30, 0x3A)
ALNUM_LOWER[0x61:0x7B] = np.arange(0x61, 0x7B)
ALNUM_LOWER[0x41:0x5B] = np.arange(0x61, 0x7B)
ALNUM_LOWER[0x80:] = np.arange(0x80, 0x100)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    if "p" not in _powers or len(_powers["p"]) < n:
        size = max(n, POWERS)
        for key, base in (("p", BASE), ("i", pow(BASE, -1, 1 << 64))):
            out = np.empty(size, U)
            out[0], made, step = 1, 1, base
            while made < size:
                k = min(made, size - made)
                out[made : made + k] = out[:k] * U(step)
                made, step = made + k, step * step % (1 << 64)
            _powers[key] = out
    return _powers["p"][:n], _powers["i"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads a polynomial hash over all 64 bits."""
    h = h ^ (h >> U(33))
    h *= U(0xFF51AFD7ED558CCD)
    h ^= h >> U(33)
    h *= U(0xC4CEB9FE1A85EC53)
    h ^= h >> U(33)
    return h


def prefix(x: np.ndarray) -> np.ndarray:
    """Prefix hashes: out[j] - out[i] is the hash of x[i:j] times BASE**i."""
    out = np.empty(len(x) + 1, U)
    out[0], own = 0, out[1:]
    own[:] = x
    own += U(1)
    own *= powers(len(x))[0]
    np.cumsum(own, out=own)
    return out


def span_hash(pre: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return (pre[end] - pre[start]) * powers(len(pre))[1][start]


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its offsets; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.type not in (pa.string(), pa.large_string()):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    width = np.int32 if column.type == pa.string() else np.int64
    offs = np.frombuffer(column.buffers()[1], width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    buf = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return buf, offs - offs[0]


def slices(offs: np.ndarray, limit: int = SLICE_BYTES):
    """Row ranges of about ``limit`` bytes; a longer text is alone in its range."""
    n, i = len(offs) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = j


def tokens(buf: np.ndarray, offs: np.ndarray, table: np.ndarray):
    """(mapped bytes, starts, ends, row) of the words of every text."""
    n = len(buf)
    x = table[buf]
    inside = x != 0
    before = np.empty(n, bool)
    after = np.empty(n, bool)
    if n:
        before[0], before[1:] = False, inside[:-1]
        after[-1], after[:-1] = False, inside[1:]
        edge = offs[(offs > 0) & (offs < n)]
        before[edge] = False
        after[edge - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    row = np.searchsorted(offs, starts, "right") - 1
    return x, starts, ends, row


def _separator(buf: np.ndarray, table: np.ndarray, at: int) -> int:
    """The first place from ``at`` on that is in no word."""
    while at < len(buf):
        found = np.flatnonzero(table[buf[at : at + 4096]] == 0)
        if len(found):
            return at + int(found[0])
        at += 4096
    return len(buf)


def token_hashes(buf: np.ndarray, offs: np.ndarray, table: np.ndarray):
    """(hashes, starts, ends, row) of the words of every text, worked out a slice at a time: long texts need no more room."""
    out, at, n = [], 0, len(buf)
    while at < n or not out:
        end = n if n - at <= 2 * SLICE_BYTES else _separator(buf, table, at + SLICE_BYTES)
        first, last = np.searchsorted(offs, at, "right") - 1, np.searchsorted(offs, end)
        x, starts, ends, row = tokens(buf[at:end], np.clip(offs[first : last + 1], at, end) - at, table)
        out.append((mix(span_hash(prefix(x), starts, ends)), starts + at, ends + at, row + first))
        at = end
        if not n:
            break
    return out[0] if len(out) == 1 else tuple(np.concatenate(x) for x in zip(*out))


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted values without repeats, by sorting: several times faster than by NumPy's hash table."""
    x = np.sort(x)
    return x[np.r_[True, x[1:] != x[:-1]]] if len(x) else x


def row_bounds(row: np.ndarray, n: int) -> np.ndarray:
    """n + 1 bounds of each row's items in the sorted array ``row``."""
    return np.searchsorted(row, np.arange(n + 1))


def shingles(h: np.ndarray, row: np.ndarray, n_rows: int, n: int):
    """Hashes of n consecutive words (all of them in a shorter text) and their rows."""
    bounds = row_bounds(row, n_rows)
    count = np.diff(bounds)
    many = np.maximum(count - n + 1, (count > 0).astype(np.int64))
    total = int(many.sum())
    out_row = np.repeat(np.arange(n_rows), many)
    first = np.repeat(bounds[:-1], many) + (np.arange(total) - np.repeat(np.cumsum(many) - many, many))
    last = bounds[1:][out_row]
    out = np.zeros(total, U)
    for k in range(n):
        at = first + k
        here = at < last
        out = out * U(BASE) + np.where(here, h[np.minimum(at, max(len(h) - 1, 0))] if len(h) else U(0), U(k + 1))
    return mix(out), out_row


def sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive items, in two passes over blocks of w."""
    m = len(v) - w + 1
    if m <= 0:
        return v[:0]
    a = np.full(-(-len(v) // w) * w, np.iinfo(v.dtype).max, v.dtype)
    a[: len(v)] = v
    a = a.reshape(-1, w)
    left = np.minimum.accumulate(a, axis=1).ravel()
    right = np.minimum.accumulate(a[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:m], left[w - 1 : w - 1 + m])


def pack_ints(v: np.ndarray, z) -> bytes:
    """Compressed 64-bit integers; sorted ones shrink most (pass differences)."""
    v = np.ascontiguousarray(v).astype(np.uint64)
    return len(v).to_bytes(8, "little") + z.compress(v.view(np.uint8).reshape(-1, 8).T.tobytes())


def unpack_ints(b: bytes, z) -> np.ndarray:
    n = int.from_bytes(b[:8], "little")
    return np.ascontiguousarray(np.frombuffer(z.decompress(b[8:]), np.uint8).reshape(8, n).T).view(np.uint64).ravel() if n else np.zeros(0, U)


def deltas(v: np.ndarray) -> np.ndarray:
    out = v.copy()
    out[1:] -= v[:-1]
    return out
