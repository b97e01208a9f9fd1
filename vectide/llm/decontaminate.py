"""Benchmark decontamination by a distributed positional inverted index.

The training texts are cut into shards, blocks of documents. ``build_index``
stores for each shard the postings of all its tokens: the distinct token hashes,
and for each the places where it stands, in order. Places count the words of
the shard, with a gap between documents, so no match crosses documents.
``search`` takes windows of test words. In a shard it drops windows with a term
that the shard lacks, starts from the postings of the rarest term, less its
offset in the window, and intersects them with the offset-adjusted postings of
the other terms, rarer ones first. With ``slop`` above 0 a term may also stand
up to so many words from its place: those are the proximity matches.

The test side is sent to all workers only in pieces of at most ``PIECE_BYTES``
of text; a larger test set takes one pass over the index for each piece. A shard
looks each distinct test term up once; windows then drop out term by term.

``matches`` gives the matches themselves, ``decontaminate`` a verdict on documents.

Defined cases: null and empty texts have no words and no hits; an item without
words or with a null id is no query; items with equal ids count once; an empty
test set hits nothing; other columns pass through, under the name ``in_<name>``
if an added column has theirs. Tokens are compared by 64-bit hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import bytescan as bs
from .blocks import Block, frame, packed, unframe
from .scratch import materialise, set_aside

U = np.uint64
WINDOW = 8
SLOP = 2
GAP = 16
ADDED = ("n_words", "n_hit", "n_items", "n_near", "items_sha256", "contaminated", "hit_spans")
PIECE_BYTES = 16 << 20
SHARD_BYTES = 1 << 20
#: Candidate places handled at once.
CHUNK = 1 << 20


def build_index(docs: DataFrame, text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """One row a shard: block, meta (the other columns), body (the texts, if kept), postings."""
    blocks = packed(docs, text_col, SHARD_BYTES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(1)
        for batch in batches:
            for block, meta, body in zip(*(batch.column(c).to_pylist() for c in ("block", "meta", "body"))):
                b = Block(meta, body)
                h, _, _, row = bs.token_hashes(b.buf, b.offs, bs.ALNUM_LOWER)
                place = np.arange(len(h)) + row * GAP
                order = np.argsort(h, kind="stable")
                term, count = np.unique(h, return_counts=True)
                words = np.bincount(row, minlength=len(b.offs) - 1)
                step = np.diff(place[order], prepend=0).astype(np.int32)
                postings = frame(bs.pack_ints(term, z), bs.pack_ints(count, z), z.compress(step.view(np.uint8).reshape(-1, 4).T.tobytes()), bs.pack_ints(words, z))
                yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([meta], pa.binary()), pa.array([body if keep_text else z.compress(b"")], pa.binary()), pa.array([postings], pa.binary())], names=["block", "meta", "body", "postings"])
                bs.release()

    return materialise(blocks.mapInArrow(run, "block bigint, meta binary, body binary, postings binary"), "postings")


class Shard:
    """The postings of one shard."""

    def __init__(self, postings: bytes):
        z = zstandard.ZstdDecompressor()
        term, count, step, words = unframe(postings)
        self.term = bs.unpack_ints(term, z)
        self.count = bs.unpack_ints(count, z).astype(np.int64)
        self.first = np.cumsum(self.count) - self.count
        raw = np.frombuffer(z.decompress(step), np.uint8)
        self.place = np.cumsum(np.ascontiguousarray(raw.reshape(4, -1).T).view(np.int32).ravel().astype(np.int64))
        self.words = bs.unpack_ints(words, z).astype(np.int64)
        self.begin = np.cumsum(self.words) - self.words + np.arange(len(self.words)) * GAP
        self.end = int(self.begin[-1] + self.words[-1]) + GAP if len(self.words) else 0
        self.key = np.repeat(np.arange(len(self.term)), self.count) * (self.end + 2 * GAP) + self.place

    def search(self, query: Query, slop: int):
        """(window, place, exact) of every match."""
        e = np.zeros(0, np.int64)
        if not len(self.term) or not len(query.size):
            return e, e, np.zeros(0, bool)
        width, size = query.at.shape[1], query.size
        place = np.minimum(np.searchsorted(self.term, query.term), len(self.term) - 1)
        here = np.r_[self.term[place] == query.term, True]  # the last one stands for no term
        window = np.arange(len(size))
        for k in range(width):
            window = window[here[query.at[window, k]]]
        at = np.r_[place, 0][query.at[window]]
        used = np.arange(width) < size[window][:, None]
        n = np.where(used, self.count[at], np.iinfo(np.int64).max)
        by = np.argsort(n, axis=1, kind="stable")  # offsets, rarest term first
        rows = np.arange(len(window))
        out = []
        rare = at[rows, by[:, 0]] if len(window) else at[:, 0]
        many = self.count[rare]
        cuts = np.searchsorted(np.cumsum(many), np.arange(0, int(many.sum()), CHUNK))
        for lo, hi in zip(cuts, np.r_[cuts[1:], len(window)]):
            m = many[lo:hi]
            w = np.repeat(np.arange(lo, hi), m)
            start = self.place[np.repeat(self.first[rare[lo:hi]] - (np.cumsum(m) - m), m) + np.arange(int(m.sum()))] - by[w, 0]
            exact = np.ones(len(w), bool)
            for k in range(1, width):
                off = by[w, k]
                need = used[w, off]
                base = at[w, off] * (self.end + 2 * GAP)
                want = base + start + off
                i = np.searchsorted(self.key, want - slop)
                near = np.where(i < len(self.key), self.key[np.minimum(i, len(self.key) - 1)], -(1 << 60))
                ok = (near >= want - slop) & (near <= want + slop)
                if slop:
                    j = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
                    exact &= (self.key[j] == want) | ~need
                ok |= ~need
                w, start, exact = w[ok], start[ok], exact[ok]
            inside = self.inside(start, size[window[w]])
            out.append((window[w], start, exact & inside))
        return tuple(np.concatenate(x) for x in zip(*out)) if out else (window, window, window > 0)

    def doc(self, place: np.ndarray) -> np.ndarray:
        return np.maximum(np.searchsorted(self.begin - GAP // 2, place, "right") - 1, 0)

    def inside(self, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        d = self.doc(start)
        return (start >= self.begin[d]) & (start + size <= self.begin[d] + self.words[d])


class Query:
    """The distinct windows of some test items.

    term: the distinct hashes; at: a row a window of their numbers (len(term) after its last word); size: its words;
    owners of window k: owner[first[k] : first[k + 1]], numbers of ids.
    """

    def __init__(self, items: list[tuple], width: int):
        self.ids = sorted({i for i, _ in items if i is not None}, key=str)
        number = {i: k for k, i in enumerate(self.ids)}
        texts = pa.array([t or "" for i, t in items if i is not None], pa.large_string())
        own = np.array([number[i] for i, _ in items if i is not None], np.int64)
        buf, offs = bs.flat(texts)
        h, _, _, row = bs.token_hashes(buf, offs, bs.ALNUM_LOWER)
        self.term, place = np.unique(h, return_inverse=True)
        bounds = bs.row_bounds(row, len(own))
        words = np.diff(bounds)
        many = np.maximum(words - width + 1, np.minimum(words, 1))
        of = np.repeat(np.arange(len(own)), many)
        start = np.repeat(bounds[:-1] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
        at = start[:, None] + np.arange(width)
        inside = at < bounds[1:][of][:, None]
        at = np.where(inside, np.r_[place, 0][np.minimum(at, len(place))], len(self.term)).astype(np.int32)
        distinct, which = np.unique(np.ascontiguousarray(at).view(np.dtype((np.void, at.itemsize * width))).ravel(), return_inverse=True) if len(at) else (np.zeros((0, width), np.int32), np.zeros(0, np.int64))
        self.at = distinct.view(np.int32).reshape(-1, width)
        self.size = (self.at < len(self.term)).sum(1)
        pair = bs.distinct(which * max(1, len(self.ids)) + own[of])
        self.owner = pair % max(1, len(self.ids))
        self.first = np.searchsorted(pair // max(1, len(self.ids)), np.arange(len(self.size) + 1))

    def owners(self, window: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``window``, number of an id) of every owner of those windows."""
        many = self.first[window + 1] - self.first[window]
        at = np.repeat(self.first[window] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
        return np.repeat(np.arange(len(window)), many), self.owner[at]


def _pieces(spark, items: DataFrame, id_col: str, text_col: str, width: int) -> Iterator:
    """The windows of the test items, broadcast in pieces of a bounded number of bytes."""
    total = items.agg(F.sum(F.length(text_col).cast("bigint") * 4 + 64)).first()[0] or 0
    n = 1 + int(total) // PIECE_BYTES
    for k in range(n):
        piece = items if n == 1 else items.where(F.pmod(F.xxhash64(id_col, text_col), F.lit(n)) == k)
        yield spark.sparkContext.broadcast(Query([tuple(r) for r in piece.select(id_col, text_col).collect()], width))


_HITS = pa.schema([("block", pa.int64()), ("row", pa.int32()), ("n_words", pa.int64()), ("spans", pa.list_(pa.int64())), ("items", pa.list_(pa.string())), ("n_near", pa.int64())])


def find(index: DataFrame, query, slop: int) -> DataFrame:
    """Rows (block, row, n_words, spans, items, n_near): hit words as (start, end) pairs, item ids as strings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, postings in zip(batch.column("block").to_pylist(), batch.column("postings").to_pylist()):
                yield _shard_rows(block, Shard(postings), query.value, slop)

    return index.select("block", "postings").mapInArrow(run, "block bigint, row int, n_words bigint, spans array<bigint>, items array<string>, n_near bigint")


def _shard_rows(block, s: Shard, query: Query, slop: int) -> pa.RecordBatch:
    n, names = len(s.words), [str(i) for i in query.ids]
    w, start, exact = s.search(query, slop)
    near = np.bincount(s.doc(start[~exact]), minlength=n) if len(start) else np.zeros(n, np.int64)
    w, start = w[exact], start[exact]
    edge = np.zeros(s.end + GAP + 1, np.int32)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + query.size[w], -1)
    hit = np.cumsum(edge) > 0
    flip = np.diff(hit.astype(np.int8), prepend=0)
    lo, hi = np.flatnonzero(flip == 1), np.flatnonzero(flip == -1)
    spans: list[list[int]] = [[] for _ in range(n)]
    for d, x, y in zip(s.doc(lo), lo, hi):
        spans[d] += [int(x - s.begin[d]), int(y - s.begin[d])]
    items: list[set] = [set() for _ in range(n)]
    pairs = np.unique(np.stack([s.doc(start), w]), axis=1) if len(w) else np.zeros((2, 0), np.int64)
    at, own = query.owners(pairs[1])
    for d, k in zip(pairs[0][at].tolist(), own.tolist()):
        items[d].add(k)
    return pa.RecordBatch.from_arrays([pa.array([block] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array(s.words, pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array([sorted(names[k] for k in x) for x in items], pa.list_(pa.string())), pa.array(near, pa.int64())], schema=_HITS)


def matches(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = WINDOW, slop: int = SLOP) -> DataFrame:
    """Rows (id, item_id as string, place, n_words, exact): every exact phrase and proximity match of a window.

    place: the document's word, from 0 on, at which the window starts; a proximity match may name a place before it.
    """
    index = build_index(docs.select(id_col, text_col), text_col)
    schema = T.StructType([docs.schema[id_col], T.StructField("item_id", T.StringType()), T.StructField("place", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("exact", T.BooleanType())])
    arrow = to_arrow_schema(schema)
    out = None
    for query in _pieces(docs.sparkSession, items, item_id, item_text, width):

        def run(batches: Iterator[pa.RecordBatch], query=query) -> Iterator[pa.RecordBatch]:
            z, q = zstandard.ZstdDecompressor(), query.value
            for batch in batches:
                for meta, postings in zip(batch.column("meta").to_pylist(), batch.column("postings").to_pylist()):
                    s = Shard(postings)
                    w, start, exact = s.search(q, slop)
                    at, own = q.owners(w)
                    d = s.doc(start[at])
                    ids = pa.ipc.open_stream(z.decompress(meta)).read_all().combine_chunks().column(id_col).take(pa.array(d))
                    names = np.array([str(i) for i in q.ids], object)
                    columns = [ids.combine_chunks(), pa.array(names[own], pa.string()), pa.array(start[at] - s.begin[d]), pa.array(q.size[w][at]), pa.array(exact[at])]
                    yield pa.RecordBatch.from_arrays([c.cast(t.type) for c, t in zip(columns, arrow)], schema=arrow)
                    bs.release()

        one = index.select("meta", "postings").mapInArrow(run, schema)
        out = one if out is None else out.unionByName(one)
    return out


def _union_spans(spans: list[int]) -> list[int]:
    """The spans, (start, end) one after the other, of several pieces without overlaps."""
    out: list[int] = []
    for x, y in sorted(zip(spans[::2], spans[1::2])):
        if out and x <= out[-1]:
            out[-1] = max(out[-1], y)
        else:
            out += [x, y]
    return out


def decontaminate(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = WINDOW, slop: int = SLOP, min_items: int = 2, keep_text: bool = True) -> DataFrame:
    """``docs`` (with the text if ``keep_text``) and n_words, n_hit, n_items, n_near, items_sha256, contaminated, hit_spans."""
    spark = docs.sparkSession
    docs, name = set_aside(docs, ADDED)
    text_col = name(text_col)
    index = build_index(docs, text_col, keep_text)
    names = [c for c in docs.columns if c != text_col]
    extra = [T.StructField(x, T.LongType()) for x in ("n_words", "n_hit", "n_items", "n_near")] + [T.StructField("items_sha256", T.StringType()), T.StructField("contaminated", T.BooleanType()), T.StructField("hit_spans", T.ArrayType(T.LongType()))]
    schema = T.StructType([docs.schema[c] for c in names] + ([T.StructField(text_col, T.StringType())] if keep_text else []) + extra)
    arrow = to_arrow_schema(schema)
    pieces = list(_pieces(spark, items, item_id, item_text, width))
    if len(pieces) == 1:  # one pass over the index, without a shuffle
        query = pieces[0]

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for block, meta, body, postings in zip(*(batch.column(c).to_pylist() for c in ("block", "meta", "body", "postings"))):
                    mail = _shard_rows(block, Shard(postings), query.value, slop).to_pylist()
                    yield from _result(meta, body, mail, names, keep_text, min_items, arrow).to_batches()
                    bs.release()

        return index.mapInArrow(search, schema)
    hits = None
    for query in pieces:
        one = find(index, query, slop)
        hits = one if hits is None else hits.unionByName(one)
    hits = hits.groupBy("block", "row").agg(F.first("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.sum("n_near").alias("n_near"))
    # a shard's hits travel as one row to its block
    mail = hits.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("row", "n_words", "spans", "items", "n_near"))).alias("mail"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for meta, body, mail in zip(*(batch.column(c).to_pylist() for c in ("meta", "body", "mail"))):
                yield from _result(meta, body, mail, names, keep_text, min_items, arrow).to_batches()

    return index.select("block", "meta", "body").join(mail, "block").mapInArrow(run, schema)


def _result(meta, body, mail, names, keep_text, min_items, arrow) -> pa.Table:
    rest = Block.__new__(Block)
    z = zstandard.ZstdDecompressor()
    table = pa.ipc.open_stream(z.decompress(meta)).read_all().combine_chunks()
    columns = [table.column(c) for c in names]
    if keep_text:
        rest = Block(meta, body)
        columns.append(pa.chunked_array([pa.array([None if null else t.decode() for null, t in zip(rest.null, rest.texts())], pa.string())]))
    items, spans = [m["items"] for m in mail], [_union_spans(m["spans"]) for m in mail]
    n_items = [len(x) for x in items]
    more = [[m["n_words"] for m in mail], [sum(x[1::2]) - sum(x[::2]) for x in spans], n_items, [m["n_near"] for m in mail], [hashlib.sha256(",".join(x).encode()).hexdigest() for x in items], [x >= min_items for x in n_items], spans]
    columns += [pa.chunked_array([pa.array(x, t.type)]) for x, t in zip(more, list(arrow)[len(columns) :])]
    return pa.Table.from_arrays([c.cast(t.type) for c, t in zip(columns, arrow)], schema=arrow)


def digest(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The columns of ``op9``."""
    found = decontaminate(docs.select("doc_id", "text"), items.select("item_id", "text"), keep_text=False)
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
