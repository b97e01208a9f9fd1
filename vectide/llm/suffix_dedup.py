"""Suffix-array dedup: remove bytes of long strings that an earlier document has.

A byte goes if a ``length``-byte string that covers it also starts in a document
with a smaller id. Three steps, all on blocks of documents:

1. Every window of ``length`` bytes has an anchor, a ``GRAM``-byte gram chosen by
   its own bytes; equal windows have equal anchors at equal places. Blocks send
   the distinct anchor hashes to hash parts and learn which are shared.
2. Only windows all of whose anchors are shared can be repeats. They go, once
   for each distinct context in a block, to the part of their first anchor. There a
   suffix sort orders them: the leading bytes first, ties by merge sort whose
   comparisons find the common extension by binary search over prefix
   polynomial hashes. Neighbours that agree to ``length`` bytes are compared
   byte by byte; on a hash collision the part is sorted again by its bytes.
3. Each block learns the smallest id of every window and removes what it covers.

Defined cases: a null text is empty and stays null; texts under ``length``
bytes have no windows; rows with the same id never remove each other's bytes; a
null id sorts last and loses to every other id; other columns pass through,
under the name ``in_<name>`` if an added column has theirs.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import bytescan as bs
from .blocks import Block, answer, ask, deliver, frame, pack, per_block, split_parts, text_bytes, unframe
from .scratch import materialise, parts_of, set_aside

LENGTH = 50
GRAM = 32
#: Bytes of text of a hash part.
PART_BYTES = 4 << 20
ADDED = ("n_bytes", "n_removed", "n_spans", "kept_sha256")
#: Starts of windows handled at once.
STEP = 1 << 20
U = np.uint64


def anchors(buf: np.ndarray, offs: np.ndarray, length: int, gram: int):
    """(places of the anchors, their hashes): closed syncmers, inside one text each.

    A gram is an anchor if the least hash of its shorter grams is its first or
    last one; so being an anchor depends on the gram alone, and any ``length``
    bytes have one.
    """
    w = length - gram + 1
    small = gram - w
    out = []
    ends = offs[1:]
    n = len(buf) - gram + 1
    for at in range(0, max(n, 0), STEP):
        piece = buf[at : at + STEP + gram - 1]
        pre = bs.prefix(piece)
        inv = bs.powers(len(pre))[1]
        hs = bs.mix((pre[small:] - pre[:-small]) * inv[: len(pre) - small])
        least = bs.sliding_min(hs, w + 1)
        a = np.flatnonzero((hs[: len(least)] == least) | (hs[w : w + len(least)] == least))
        a = a[a + at + gram <= ends[np.searchsorted(ends, a + at, "right")]]
        out.append((a + at, bs.mix(bs.span_hash(pre, a, a + gram))))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, U)
    return tuple(np.concatenate(x) for x in zip(*out))


def windows(offs: np.ndarray, a: np.ndarray, length: int, gram: int):
    """Each anchor's windows, those whose first anchor it is: (number of the anchor, first start, last start)."""
    if not len(a):
        e = np.zeros(0, np.int64)
        return e, e, e
    text = np.searchsorted(offs, a, "right") - 1
    begin = offs[text]
    before = np.r_[-1, a[:-1]]
    s = np.maximum(np.maximum(begin, before + 1), a - (length - gram))
    e = np.minimum(a, offs[text + 1] - length)
    use = np.flatnonzero(e >= s)
    return use, s[use], e[use]


def _shared_question(parts: int, length: int, gram: int, id_col: str):
    def question(b: Block):
        z = zstandard.ZstdCompressor(1)
        a, h = anchors(b.buf, b.offs, length, gram)
        key, multi = _keys(b, a, h, id_col)
        order, low, bounds = split_parts(key, parts, 40)
        multi = multi[order]
        for p in np.flatnonzero(np.diff(bounds)):
            at = slice(bounds[p], bounds[p + 1])
            yield int(p), frame(bs.pack_ints(bs.deltas(low[at]), z), z.compress(np.packbits(multi[at]).tobytes()))

    return question


def _keys(b: Block, s: np.ndarray, h: np.ndarray, id_col: str):
    """The distinct anchor hashes of a block, and which stand in rows of different ids."""
    key, inverse = np.unique(h, return_inverse=True)
    doc = b.ids(id_col)[np.searchsorted(b.offs, s, "right") - 1] if len(s) else np.zeros(0, np.int64)
    lo = np.full(len(key), np.iinfo(np.int64).max)
    hi = np.full(len(key), np.iinfo(np.int64).min)
    np.minimum.at(lo, inverse, doc)
    np.maximum.at(hi, inverse, doc)
    return key, lo < hi


def _shared_reply(bodies: list[bytes]) -> list[bytes | None]:
    z, c = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(1)
    got = [unframe(x) for x in bodies]
    hs = [np.cumsum(bs.unpack_ints(x[0], z), dtype=U) for x in got]
    own = [np.unpackbits(np.frombuffer(z.decompress(x[1]), np.uint8), count=len(h)).astype(bool) for x, h in zip(got, hs)]
    h = np.concatenate(hs)
    order = np.argsort(h, kind="stable")
    same = np.r_[False, h[order][1:] == h[order][:-1]]
    shared = np.empty(len(h), bool)
    shared[order] = same | np.r_[same[1:], False]
    shared |= np.concatenate(own)
    out, at = [], 0
    for x in hs:
        mark = shared[at : at + len(x)]
        at += len(x)
        out.append(c.compress(np.packbits(mark).tobytes()) if mark.any() else None)
    return out


def contexts(b: Block, mail: dict[int, bytes], parts: int, length: int, gram: int, id_col: str):
    """The windows that may be repeats, as distinct contexts of anchors.

    Returns (anchor, first start, last start, hash, id) of each anchor's windows.
    """
    z = zstandard.ZstdDecompressor()
    a, h = anchors(b.buf, b.offs, length, gram)
    key, inverse = np.unique(h, return_inverse=True)
    order, _, bounds = split_parts(key, parts, 40)
    shared = np.zeros(len(key), bool)
    for p, body in mail.items():
        n = bounds[p + 1] - bounds[p]
        shared[order[bounds[p] : bounds[p + 1]]] = np.unpackbits(np.frombuffer(z.decompress(body), np.uint8), count=n).astype(bool)
    ok = shared[inverse]
    lonely = np.r_[np.iinfo(np.int64).min >> 1, a[~ok], np.iinfo(np.int64).max >> 1]
    own, s, e = windows(b.offs, a, length, gram)
    use = ok[own]
    own, s, e = own[use], s[use], e[use]
    a, h = a[own], h[own]
    # all anchors of a repeated window are shared, not its first one alone
    after = lonely[np.searchsorted(lonely, a)]
    e = np.minimum(e, after - (length - gram + 1))
    use = e >= s
    a, s, e, h = a[use], s[use], e[use], h[use]
    doc = b.ids(id_col)[np.searchsorted(b.offs, s, "right") - 1] if len(s) else np.zeros(0, np.int64)
    return a, s, e, h, doc


def _distinct(b: Block, a, s, e, h, doc, length: int):
    """Order by (hash, place of the anchor, context); numbers of equal contexts, whose bytes are compared."""
    ctx = np.zeros(len(s), U)
    for at in range(0, len(b.buf), STEP):
        here = slice(*np.searchsorted(s, [at, at + STEP]))
        if here.stop > here.start:
            pre = bs.prefix(b.buf[at : int(e[here].max()) + length])
            ctx[here] = bs.mix(bs.span_hash(pre, s[here] - at, e[here] + length - at) + ((a[here] - s[here]) * 256 + (e[here] - s[here])).astype(U))
    order = np.lexsort((doc, ctx, h))
    c, k = ctx[order], h[order]
    new = np.r_[True, (c[1:] != c[:-1]) | (k[1:] != k[:-1])] if len(order) else np.zeros(0, bool)
    start, left, size = s[order], (a - s)[order], (e - s)[order] + length
    for i in np.array_split(np.flatnonzero(~new), 1 + int((~new).sum() >> 16)):
        if not _same_bytes(b.buf, start, left, size, i - 1, i):
            new[:] = True  # a hash collision: no context stands for another one
            break
    return order, np.flatnonzero(new)


def _same_bytes(buf, start, left, size, p: np.ndarray, q: np.ndarray) -> bool:
    """Are the contexts p[i] and q[i] the same bytes with the anchor at the same place, for every i?"""
    if (size[p] != size[q]).any() or (left[p] != left[q]).any():
        return False
    return bool((_gather(buf, start[p], size[p]) == _gather(buf, start[q], size[q])).all())


def _gather(buf: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    total = int(size.sum())
    return buf[np.repeat(start - (np.cumsum(size) - size), size) + np.arange(total)]


def _window_question(parts: int, length: int, gram: int, id_col: str):
    def question(b: Block, mail: dict[int, bytes]):
        z = zstandard.ZstdCompressor(3)
        a, s, e, h, doc = contexts(b, mail, parts, length, gram, id_col)
        order, first = _distinct(b, a, s, e, h, doc, length)
        pick = order[first]
        by, _, bounds = split_parts(h[pick], parts)
        pick = pick[by]
        for p in np.flatnonzero(np.diff(bounds)):
            x = pick[bounds[p] : bounds[p + 1]]
            size = e[x] - s[x] + length
            yield int(p), frame(bs.pack_ints(doc[x].view(U), z), z.compress((a[x] - s[x]).astype(np.uint8).tobytes()), z.compress((e[x] - s[x]).astype(np.uint8).tobytes()), z.compress(_gather(b.buf, s[x], size).tobytes()))

    return question


def _extension(pre: np.ndarray, x: np.ndarray, y: np.ndarray, length: int) -> np.ndarray:
    """Common extension of suffixes x and y, up to ``length``, by binary search over prefix hashes."""
    inv = bs.powers(len(pre))[1]
    lo, hi = np.zeros(len(x), np.int64), np.full(len(x), length, np.int64)
    px, py, ix, iy = pre[x], pre[y], inv[x], inv[y]
    for _ in range(int(length).bit_length()):
        mid = (lo + hi + 1) >> 1
        same = (pre[x + mid] - px) * ix == (pre[y + mid] - py) * iy
        lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
    return lo


def _less(buf, pre, x, y, length, or_equal):
    n = _extension(pre, x, y, length)
    full = n >= length
    at = np.minimum(n, length - 1)
    return np.where(full, or_equal, buf[x + at] < buf[y + at])


def suffix_sort(buf: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(order of the suffixes by their first ``length`` bytes, marks where a new string begins).

    ``starts`` must be sorted so that any equal order is stable; each has
    ``length`` bytes in ``buf``. Leading 16 bytes order most suffixes; what ties
    there is merge-sorted with hash-compared extensions.
    """
    n = len(starts)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, bool)
    lead = min(16, length)
    keys = np.zeros((2, n), U)
    for k in range(lead):
        keys[k // 8] |= buf[starts + k].astype(U) << U(56 - 8 * (k % 8))
    order = np.lexsort((keys[1], keys[0]))
    tied = np.r_[False, (keys[:, order][:, 1:] == keys[:, order][:, :-1]).all(0)]
    del keys
    pre = bs.prefix(buf)
    group = np.cumsum(~tied) - 1
    size = np.bincount(group)
    if length > lead and size.max() > 1:
        busy = np.flatnonzero(size[group] > 1)  # places in ``order`` that stand in tied groups
        g = group[busy]
        first = np.searchsorted(g, g, "left")
        place = np.arange(len(busy)) - first  # place within the group
        total = size[g]
        item = starts[order[busy]]
        what = order[busy]
        width = 1
        while width < int(total.max()):
            live = np.flatnonzero(total > width)
            f, pl, tot = first[live], place[live], total[live]
            run = pl // width
            base = (run // 2) * 2 * width
            right = run % 2 == 1
            other_lo = f + np.where(right, base, base + width)
            other_hi = f + np.minimum(np.where(right, base + width, base + 2 * width), tot)
            other_hi = np.maximum(other_hi, other_lo)
            lo, hi = other_lo.copy(), other_hi.copy()
            x = item[live]
            open_ = np.flatnonzero(lo < hi)
            while len(open_):
                mid = (lo[open_] + hi[open_]) >> 1
                # a left item goes before equal right ones; a right item after equal left ones
                down = _less(buf, pre, item[mid], x[open_], length, right[open_])
                lo[open_] = np.where(down, mid + 1, lo[open_])
                hi[open_] = np.where(down, hi[open_], mid)
                open_ = open_[lo[open_] < hi[open_]]
            to = f + base + (pl - base - np.where(right, width, 0)) + (lo - other_lo)
            moved, moved_what = item.copy(), what.copy()
            moved[to], moved_what[to] = x, what[live]
            item, what = moved, moved_what
            width *= 2
        order = order.copy()
        order[busy] = what
    x, y = starts[order[:-1]], starts[order[1:]]
    cand = np.flatnonzero(_extension(pre, x, y, length) >= length)
    same = np.zeros(n, bool)
    same[cand + 1] = True
    for at in range(0, len(cand), 1 << 16):  # verify: equal hashes must be equal bytes
        c = cand[at : at + (1 << 16)]
        span = np.arange(length)
        if not (buf[x[c][:, None] + span] == buf[y[c][:, None] + span]).all():
            return _by_bytes(buf, starts, length)
    return order, ~same


def _by_bytes(buf, starts, length):
    """Exact order by bytes, for a part in which two strings had equal hashes."""
    rows = [buf[s : s + length].tobytes() for s in starts.tolist()]
    order = np.array(sorted(range(len(rows)), key=rows.__getitem__), np.int64)
    new = np.array([True] + [rows[i] != rows[j] for i, j in zip(order[:-1], order[1:])])
    return order, new


def _window_reply(length: int, gram: int):
    def reply(bodies: list[bytes]) -> list[bytes | None]:
        z, c = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(1)
        docs, lefts, spans, texts = [], [], [], []
        for x in bodies:
            d, left, span, text = unframe(x)
            docs.append(bs.unpack_ints(d, z).view(np.int64))
            lefts.append(np.frombuffer(z.decompress(left), np.uint8))
            spans.append(np.frombuffer(z.decompress(span), np.uint8))
            texts.append(np.frombuffer(z.decompress(text), np.uint8))
        sizes = [len(x) for x in docs]
        doc, left, span, buf = (np.concatenate(x) for x in (docs, lefts, spans, texts))
        left, span = left.astype(np.int64), span.astype(np.int64)
        del docs, lefts, spans, texts
        size = span + length
        begin = np.cumsum(size) - size
        # equal contexts (same bytes, same anchor place) count once, with their least id
        pre = bs.prefix(buf)
        gram_h = bs.span_hash(pre, begin + left, begin + left + gram)
        ctx = bs.mix(bs.span_hash(pre, begin, begin + size) + (left * 256 + span).astype(U))
        del pre
        order = np.lexsort((doc, ctx, gram_h))
        new = np.r_[True, (ctx[order][1:] != ctx[order][:-1]) | (gram_h[order][1:] != gram_h[order][:-1])]
        for at in range(0, len(order) - 1, 1 << 16):  # verify equal contexts by their bytes
            i = np.flatnonzero(~new[1:][at : at + (1 << 16)]) + at
            p, q = order[i], order[i + 1]
            if not _same_bytes(buf, begin, left, size, p, q):
                new[:] = True
                break
        number = np.empty(len(order), np.int64)
        number[order] = np.cumsum(new) - 1
        pick = order[new]
        least = np.minimum.reduceat(doc[order], np.flatnonzero(new))
        # distinct contexts whose anchor gram stands in one context only have nothing else to meet
        gh = gram_h[pick]
        alone = np.r_[True, gh[1:] != gh[:-1]] & np.r_[gh[1:] != gh[:-1], True]
        many = span[pick] + 1
        offset = np.cumsum(many) - many
        best = np.repeat(least, many)
        meet = np.flatnonzero(~alone)
        if len(meet):
            k = many[meet]
            place = np.repeat(offset[meet] - (np.cumsum(k) - k), k) + np.arange(int(k.sum()))
            start = np.repeat(begin[pick[meet]] - (np.cumsum(k) - k), k) + np.arange(int(k.sum()))
            by, fresh = suffix_sort(buf, start, length)
            low = np.minimum.reduceat(best[place[by]], np.flatnonzero(fresh))
            best[place[by]] = low[np.cumsum(fresh) - 1]
        out, at = [], 0
        for n in sizes:
            x = slice(at, at + n)
            at += n
            k = many[number[x]]
            v = best[np.repeat(offset[number[x]] - (np.cumsum(k) - k), k) + np.arange(int(k.sum()))]
            out.append(bs.pack_ints((v - np.repeat(doc[x], k)).view(U), c))
        return out

    return reply


def _removed(b: Block, mail: tuple[dict, dict], parts: int, length: int, gram: int, id_col: str) -> np.ndarray:
    """Marks of the bytes to remove."""
    z = zstandard.ZstdDecompressor()
    a, s, e, h, doc = contexts(b, mail[0], parts, length, gram, id_col)
    order, first = _distinct(b, a, s, e, h, doc, length)
    pick = order[first]
    by, _, bounds = split_parts(h[pick], parts)
    many = e[pick] - s[pick] + 1
    offset = np.cumsum(many) - many
    low = np.empty(int(many.sum()), np.int64)
    for p, body in mail[1].items():
        c = by[bounds[p] : bounds[p + 1]]
        k = many[c]
        at = np.repeat(offset[c] - (np.cumsum(k) - k), k) + np.arange(int(k.sum()))
        low[at] = bs.unpack_ints(body, z).view(np.int64) + np.repeat(doc[pick[c]], k)
    group = np.empty(len(order), np.int64)
    group[order] = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(order)]))
    n = many[group]
    at = np.repeat(offset[group] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    start = np.repeat(s - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    hit = start[low[at] < np.repeat(doc, n)]
    edge = np.zeros(len(b.buf) + 1, np.int32)
    edge += np.bincount(hit, minlength=len(edge))[: len(edge)].astype(np.int32)
    edge -= np.bincount(hit + length, minlength=len(edge))[: len(edge)].astype(np.int32)
    return np.cumsum(edge[:-1]) > 0


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``docs`` with the text that is left and n_bytes, n_removed, n_spans (long), kept_sha256 of each row.

    Where a cut falls inside a character, the text leaves the broken character
    out; kept_sha256 is of the kept bytes themselves.
    """
    docs, name = set_aside(docs, ADDED)
    id_col, text_col = name(id_col), name(text_col)
    blocks = pack(docs, text_col, "suffix")
    parts = parts_of(text_bytes(blocks), PART_BYTES)
    shared = materialise(answer(ask(blocks, _shared_question(parts, length, gram, id_col)), _shared_reply), "anchors")
    asked = ask(deliver(blocks, shared), _window_question(parts, length, gram, id_col), replies=True)
    low = materialise(answer(asked, _window_reply(length, gram)), "windows")
    tagged = shared.selectExpr("block", "part", "body").unionByName(low.selectExpr("block", "part + 1000000000 as part", "body"))
    names = [x for x in docs.columns if x != text_col]
    schema = T.StructType([docs.schema[x] for x in names] + [T.StructField(text_col, T.StringType())] + [T.StructField(x, T.LongType()) for x in ("n_bytes", "n_removed", "n_spans")] + [T.StructField("kept_sha256", T.StringType())])
    arrow = to_arrow_schema(schema)

    def out(b: Block, found: dict[int, bytes]) -> pa.Table:
        mail = ({p: x for p, x in found.items() if p < 10**9}, {p - 10**9: x for p, x in found.items() if p >= 10**9})
        gone = _removed(b, mail, parts, length, gram, id_col)
        begin = gone.copy()
        begin[1:] &= ~gone[:-1]
        begin[b.offs[:-1][b.offs[:-1] < len(gone)]] |= gone[b.offs[:-1][b.offs[:-1] < len(gone)]]
        cg, cb = np.r_[0, np.cumsum(gone)], np.r_[0, np.cumsum(begin)]
        i, j = b.offs[:-1], b.offs[1:]
        kept = [b.buf[x:y][~gone[x:y]].tobytes() for x, y in zip(i, j)]
        texts = [None if null else x.decode("utf-8", "ignore") for null, x in zip(b.null, kept)]
        columns = [b.rest.column(x) for x in names] + [pa.array(texts, pa.string())] + [pa.array(x, pa.int64()) for x in (j - i, cg[j] - cg[i], cb[j] - cb[i])]
        columns.append(pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()))
        return pa.Table.from_arrays([x.cast(t.type) for x, t in zip(columns, arrow)], schema=arrow)

    return per_block(deliver(blocks, tagged), out, schema)


def digest(docs: DataFrame) -> DataFrame:
    """The columns of ``op8``."""
    return suffix_dedup(docs.select("doc_id", "text")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
