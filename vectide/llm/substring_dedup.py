"""Sliding sentence spans: remove sentences of any non-first repeated span.

A sentence ends after ``.``, ``!`` or ``?`` before white space, at a line end, or
with the text; one without a word is no part of a run. A run has two sentences or
more and ``min_words`` words or more (0: any two sentences). Every run of several
consecutive sentences counts, but only the shortest one from each first sentence
on and the shortest one up to each last sentence are hashed and joined over all
texts: together they cover every longer repeated run to both ends, as the last
start whose run still ends inside it is the start of the run that ends with it.
Words are runs of non-white-space with A-Z lower-cased, so spacing does not
matter. Runs are equal if two 64-bit hashes of their words, made apart, agree.
The first occurrence is the one with the smallest (doc_id, position). What
repeats inside one sentence stays.

Defined cases: a null text has no sentences and stays null; an empty text stays
as it is; a null doc_id sorts last; rows that repeat a doc_id count as separate
texts in (doc_id, block, row) order; other columns pass through, under the name
``in_<name>`` if an added column has theirs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import bytescan as bs
from .blocks import Block, answer, ask, deliver, frame, pack, per_block, split_parts, text_bytes, unframe
from .scratch import materialise, parts_of, set_aside

MIN_WORDS = 12
SENTENCE_ENDS = b".!?"
#: Bytes of text of a hash part.
PART_BYTES = 16 << 20
ADDED = ("n_sentences", "n_removed", "removed_bytes")
U = np.uint64


def sentences(buf: np.ndarray, offs: np.ndarray):
    """(starts, ends, row): a sentence ends after an end mark that white space follows, at a line end, or with the text."""
    n = len(buf)
    if not n:
        e = np.zeros(0, np.int64)
        return e, e, e
    nxt = np.full(n, 0x20, np.uint8)
    nxt[:-1] = buf[1:]
    end = np.zeros(256, bool)
    end[list(SENTENCE_ENDS + b"\n")] = True
    cut = end[buf] & ((buf == 0x0A) | (nxt == 0x20) | ((nxt >= 9) & (nxt <= 13)))
    ends = np.flatnonzero(cut) + 1
    ends = bs.distinct(np.concatenate([ends, offs[1:][offs[1:] > 0]]))
    starts = np.concatenate([[0], ends[:-1]])
    return starts, ends, np.searchsorted(offs, starts, "right") - 1


def runs(b: Block, min_words: int):
    """(hash, second hash, first sentence, last sentence) of every run, and the sentences; idx: those with a word."""
    h, at, _, _ = bs.token_hashes(b.buf, b.offs, bs.WORDS_LOWER)
    s, e, row = sentences(b.buf, b.offs)
    lo, hi = np.searchsorted(at, s), np.searchsorted(at, e)
    full = hi > lo
    idx = np.flatnonzero(full)
    lo, hi, r = lo[full], hi[full], row[full]
    m = len(idx)
    if not m:
        return np.zeros(0, U), np.zeros(0, U), idx, idx, (s, e, row, idx)
    here = np.arange(m)
    last = np.maximum(np.searchsorted(hi, lo + min_words, "left"), here + 1)
    start = np.minimum(np.searchsorted(lo, hi - min_words, "right") - 1, here - 1)
    i, j = np.concatenate([here, start]), np.concatenate([last, here])
    ok = (i >= 0) & (j < m)
    i, j = i[ok], j[ok]
    ok = r[i] == r[j]
    i, j = np.divmod(bs.distinct(i[ok] * m + j[ok]), m)  # a run that both ways find counts once
    size = (hi[j] - lo[i]).astype(U)
    one, two = (bs.mix(bs.span_hash(bs.prefix(x >> U(8)), lo[i], hi[j]) + size) for x in (h, bs.mix(h + U(0xD6E8FEB86659FD93))))
    return one, two, i, j, (s, e, row, idx)


def _groups(b: Block, id_col: str, min_words: int):
    """The distinct runs of a block with their first (doc_id, place) there."""
    h, h2, i, j, sent = runs(b, min_words)
    ids = b.ids(id_col)[sent[2][sent[3]]][i] if len(h) else np.zeros(0, np.int64)
    order = np.lexsort((i, ids, h2, h))
    h, h2, i, j, ids = h[order], h2[order], i[order], j[order], ids[order]
    first = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (h2[1:] != h2[:-1])]) if len(h) else np.zeros(0, np.int64)
    return h, h2, i, j, ids, first, sent


def covered(blocks: DataFrame, id_col: str, min_words: int, parts: int) -> DataFrame:
    """The exchange: for each block and run that stands in other blocks too, is the first there elsewhere?"""

    def question(b: Block):
        z = zstandard.ZstdCompressor(1)
        h, h2, _, _, ids, first, _ = _groups(b, id_col, min_words)
        order, sorted_h, bounds = split_parts(h[first], parts)
        for p in np.flatnonzero(np.diff(bounds)):
            at = slice(bounds[p], bounds[p + 1])
            yield int(p), frame(bs.pack_ints(bs.deltas(sorted_h[at]), z), bs.pack_ints(h2[first][order[at]], z), bs.pack_ints(ids[first][order[at]].view(U), z))

    return answer(ask(blocks, question), _reply)


def _reply(bodies: list[bytes]) -> list[bytes | None]:
    z, c = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(1)
    got = [unframe(x) for x in bodies]
    hs = [np.cumsum(bs.unpack_ints(x[0], z), dtype=U) for x in got]
    h, h2, d = np.concatenate(hs), np.concatenate([bs.unpack_ints(x[1], z) for x in got]), np.concatenate([bs.unpack_ints(x[2], z).view(np.int64) for x in got])
    who = np.repeat(np.arange(len(hs)), [len(x) for x in hs])
    order = np.lexsort((who, d, h2, h))  # equal ids: the earlier block is first
    new = np.r_[True, (h[order][1:] != h[order][:-1]) | (h2[order][1:] != h2[order][:-1])]
    later = np.empty(len(h), bool)
    later[order] = ~new
    out, at = [], 0
    for x in hs:
        mark = later[at : at + len(x)]
        at += len(x)
        out.append(c.compress(np.packbits(mark).tobytes()) if mark.any() else None)
    return out


def _decide(b: Block, mail: dict[int, bytes], id_col: str, min_words: int, parts: int):
    """Sentences to remove, as a mark for each, and the sentences."""
    z = zstandard.ZstdDecompressor()
    h, _, i, j, _, first, (s, e, row, idx) = _groups(b, id_col, min_words)
    order, _, bounds = split_parts(h[first], parts)
    elsewhere = np.zeros(len(first), bool)
    for p, body in mail.items():
        n = bounds[p + 1] - bounds[p]
        elsewhere[order[bounds[p] : bounds[p + 1]]] = np.unpackbits(np.frombuffer(z.decompress(body), np.uint8), count=n).astype(bool)
    later = np.ones(len(h), bool)
    later[first] = elsewhere
    edge = np.zeros(len(idx) + 1, np.int64)
    np.add.at(edge, i[later], 1)
    np.add.at(edge, j[later] + 1, -1)
    gone = np.zeros(len(s), bool)
    gone[idx] = np.cumsum(edge[:-1]) > 0
    word = np.zeros(len(s), bool)
    word[idx] = True
    return gone, word, s, e, row


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with the text that is left and n_sentences (those with a word), n_removed, removed_bytes (long) of each row."""
    docs, name = set_aside(docs, ADDED)
    id_col, text_col = name(id_col), name(text_col)
    blocks = pack(docs, text_col, "sentences")
    parts = parts_of(text_bytes(blocks), PART_BYTES)
    mail = materialise(covered(blocks, id_col, min_words, parts), "sentence-runs")
    names = [x for x in docs.columns if x != text_col]
    schema = T.StructType([docs.schema[x] for x in names] + [T.StructField(text_col, T.StringType())] + [T.StructField(x, T.LongType()) for x in ADDED])
    arrow = to_arrow_schema(schema)

    def out(b: Block, found: dict[int, bytes]) -> pa.Table:
        gone, word, s, e, row = _decide(b, found, id_col, min_words, parts)
        n = len(b.offs) - 1
        keep = np.ones(len(b.buf), bool)
        for x, y in zip(s[gone], e[gone]):
            keep[x:y] = False
        texts = [None if null else b.buf[i:j][keep[i:j]].tobytes().decode() for null, i, j in zip(b.null, b.offs[:-1], b.offs[1:])]
        more = [np.bincount(row[word], minlength=n), np.bincount(row[gone], minlength=n), np.bincount(row[gone], weights=(e - s)[gone], minlength=n).astype(np.int64)]
        columns = [b.rest.column(x) for x in names] + [pa.array(texts, pa.string())] + [pa.array(x, pa.int64()) for x in more]
        return pa.Table.from_arrays([x.cast(t.type) for x, t in zip(columns, arrow)], schema=arrow)

    return per_block(deliver(blocks, mail), out, schema)


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_sentences, n_removed, removed_bytes, kept_sha256 for ``op7``."""
    from pyspark.sql import functions as F

    found = substring_dedup(docs.select("doc_id", "text"))
    return found.select("doc_id", "n_sentences", "n_removed", "removed_bytes", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


__all__ = ["MIN_WORDS", "digest", "runs", "sentences", "substring_dedup"]
