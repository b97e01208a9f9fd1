"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over the last bytes cuts texts into chunks, so passages that
texts share give the same chunks wherever they stand. A distinct chunk is
encoded once and its ids are used for each copy. A cut may fall inside a word:
the ids of a chunk are those between its first and its last safe place, white
space after another character, where splitting patterns end a word and look no
further back. Around each cut the bytes between two safe places, and the words
next to them on either side, are encoded again as one window, and the ids of the
whole must agree with the window's to both its ends. If they don't, the window
is widened, twice as many words each time, until its outer words have the ids
that stand there already, or it is the whole text. Every text is decoded; if the
bytes differ from the text's, the library encodes and decodes it as a whole.

Chunks are shared within a Python worker, across the texts of all its tasks, in
a table of bounded size that starts afresh when full; so are the words between
safe places of which a new chunk is made. Windows are always encoded by the library. The README
says what sharing them across workers would cost.

Defined cases: a null text is empty and stays null; an empty text has no ids;
very long texts and texts without white space are encoded like others; other
columns pass through, under the name ``in_<name>`` if an added column has theirs.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import bytescan as bs
from .scratch import set_aside

U = np.uint64
VOCABULARY = "byte_bpe_50k.json"
ROLL = 16
#: One place in so many is a cut, on average.
CHUNK_BYTES = 256
#: Bounds of a table: 24 bytes a key and 2 bytes an id, twice that while it grows.
MOST_KEYS, MOST_IDS = 1 << 21, 16 << 20
#: Bytes of unknown words that the library encodes as one text.
JOINED_BYTES = 1 << 16
ADDED = ("n_tokens", "ids_sha256", "decoded_sha256")


class Table:
    """Ids by 64-bit key, in sorted arrays; starts afresh when full."""

    def __init__(self):
        self.keys, self.start, self.count, self.ids = np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint16)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in the table, found)."""
        if not len(self.keys):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return at, self.keys[at] == keys

    def add(self, keys: np.ndarray, count: np.ndarray, ids: np.ndarray) -> None:
        """keys: sorted and new."""
        if len(self.keys) + len(keys) > MOST_KEYS or len(self.ids) + len(ids) > MOST_IDS:
            self.__init__()
        at = np.searchsorted(self.keys, keys)
        start = np.cumsum(count) - count + len(self.ids)
        self.keys, self.start, self.count = np.insert(self.keys, at, keys), np.insert(self.start, at, start), np.insert(self.count, at, count)
        self.ids = np.concatenate([self.ids, ids])


def spans(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... of each span, one after the other."""
    return np.repeat(start - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))


def safe_places(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Starts of texts, and white space after a character that surely is none."""
    white = (buf == 0x20) | ((buf >= 0x09) & (buf <= 0x0D))
    lead = np.maximum.accumulate(np.where((buf & 0xC0) != 0x80, np.arange(len(buf)), 0))
    first = buf[lead]
    solid = ((first > 0x20) & (first < 0x7F)) | ((first >= 0xC3) & ~((first >= 0xE1) & (first <= 0xE3)))
    ok = np.zeros(len(buf), bool)
    ok[1:] = white[1:] & solid[:-1]
    ok[offs[:-1][offs[:-1] < len(buf)]] = True
    return np.flatnonzero(ok)


def cut_places(buf: np.ndarray, offs: np.ndarray, every: int) -> np.ndarray:
    """Starts of texts, and places before which the last ``ROLL`` bytes of the text hash to 0 modulo ``every``."""
    starts = offs[:-1][np.diff(offs) > 0]
    if len(buf) <= ROLL:
        return starts
    pre = bs.prefix(buf)
    h = bs.mix((pre[ROLL:-1] - pre[: -1 - ROLL]) * bs.powers(len(pre))[1][: len(buf) - ROLL])
    at = np.flatnonzero(h % U(every) == 0) + ROLL
    at = at[(buf[at] & 0xC0) != 0x80]
    at = at[at - starts[np.searchsorted(starts, at, "right") - 1] >= ROLL]
    return np.sort(np.concatenate([starts, at]))  # a cut is never a start


class Codec:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        added = {x["id"]: x["content"].encode() for x in spec["added_tokens"]}
        back = {c: b for b, c in _byte_letters().items()}
        words = {i: bytes(back[c] for c in w) for w, i in spec["model"]["vocab"].items() if i not in added} | added
        table = [words.get(i, b"") for i in range(max(words) + 1)]
        self.size = np.array([len(x) for x in table], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(table), np.uint8)
        assert len(table) <= 1 << 16
        self.table, self.words = Table(), Table()
        self.met = self.encoded = self.repaired = 0

    def by_library(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray, joins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each span, all ids), by the library.

        joins: does the span begin at a safe place and end before one? Such spans go one after the other as one text: each
        begins at a safe place there too.
        """
        count = np.zeros(len(start), np.int64)
        lone = np.flatnonzero(~joins)
        joined = np.flatnonzero(joins)
        size = end[joined] - start[joined]
        data = buf[spans(start[joined], size)]
        bounds = np.r_[0, np.cumsum(size)]
        cuts = bounds[np.flatnonzero(np.r_[True, np.diff(bounds[:-1] // JOINED_BYTES) > 0])] if len(joined) else bounds[:0]
        texts = [data[i:j].tobytes().decode() for i, j in zip(cuts, np.r_[cuts[1:], len(data)])]
        ids = self._ids(texts)
        place = np.r_[0, np.cumsum(self.size[ids])]
        at = np.searchsorted(place, bounds)
        if not np.array_equal(place[at], bounds):  # a vocabulary that splits otherwise: every span by itself
            lone, joined, ids, at = np.arange(len(start)), joined[:0], ids[:0], at[:1]
        count[joined] = np.diff(at)
        got = [e.ids for e in self.library.encode_batch_fast([buf[i:j].tobytes().decode() for i, j in zip(start[lone].tolist(), end[lone].tolist())], add_special_tokens=False)]
        count[lone] = [len(x) for x in got]
        both = np.concatenate([ids, np.fromiter(itertools.chain.from_iterable(got), np.uint16, int(count[lone].sum()))])
        where = np.empty(len(start), np.int64)
        where[joined] = at[:-1]
        where[lone] = len(ids) + np.cumsum(count[lone]) - count[lone]
        return count, both[spans(where, count)]

    def _ids(self, texts: list[str]) -> np.ndarray:
        got = [np.array(e.ids, np.uint16) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        return np.concatenate([np.zeros(0, np.uint16), *got])

    def lookup(self, table: Table, buf: np.ndarray, pre: np.ndarray, start: np.ndarray, end: np.ndarray, encode) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each span, all ids); ``encode(start, end)`` gives those of the spans that the table hasn't."""
        key = bs.mix(bs.span_hash(pre, start, end) + (end - start).astype(U))
        distinct, first, inverse = np.unique(key, return_index=True, return_inverse=True)
        at, found = table.find(distinct)
        count = np.zeros(len(distinct), np.int64)
        count[found] = table.count[at[found]]
        old = table.ids[spans(table.start[at[found]], count[found])]
        new = np.flatnonzero(~found)
        count[new], fresh = encode(start[first[new]], end[first[new]])
        ids = np.concatenate([old, fresh])
        place = np.empty(len(distinct), np.int64)
        place[found] = np.cumsum(count[found]) - count[found]
        place[new] = len(old) + np.cumsum(count[new]) - count[new]
        table.add(distinct[new], count[new], fresh)
        return count[inverse], ids[spans(place[inverse], count[inverse])]

    def encode(self, buf: np.ndarray, offs: np.ndarray, every: int) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each text, all ids)."""
        if not len(buf):
            return np.zeros(len(offs) - 1, np.int64), np.zeros(0, np.uint16)
        pre = bs.prefix(buf)
        safe = safe_places(buf, offs)
        text = np.searchsorted(offs, safe, "right") - 1
        end = np.r_[safe[1:], len(buf)]  # of the stretch from each safe place to the next
        joins = np.zeros(len(buf) + 1, bool)  # safe places after a character, not starts of texts
        joins[safe] = True
        joins[offs] = False

        def whole_spans(start: np.ndarray, end: np.ndarray):
            return self.by_library(buf, start, end, joins[start] & joins[end])

        def by_words(start: np.ndarray, stop: np.ndarray):
            """The ids of spans between safe places, word by word: words met before aren't encoded again."""
            self.encoded += len(start)
            lo, hi = np.searchsorted(safe, start), np.searchsorted(safe, stop)
            at = spans(lo, hi - lo)
            n, ids = self.lookup(self.words, buf, pre, safe[at], end[at], whole_spans)
            return np.bincount(np.repeat(np.arange(len(lo)), hi - lo), weights=n, minlength=len(lo)).astype(np.int64), ids

        cut = cut_places(buf, offs, every)
        cut_end = np.r_[cut[1:], len(buf)]
        # a chunk's own part: its stretches, without one that goes beyond its end
        lo, hi = np.searchsorted(safe, cut), np.searchsorted(safe, cut_end)
        lo, hi = lo[hi > lo], hi[hi > lo]
        start, stop = safe[lo], np.where(end[hi - 1] <= cut_end[np.searchsorted(cut, safe[hi - 1], "right") - 1], end[hi - 1], safe[hi - 1])
        start, stop = start[stop > start], stop[stop > start]
        self.met += len(start)
        own, ids = self.lookup(self.table, buf, pre, start, stop, by_words)
        # windows around the cuts inside texts: the stretch that a cut divides, if one, and those beside it
        inner = cut[offs[np.searchsorted(offs, cut, "right") - 1] != cut]
        t = np.searchsorted(safe, inner) - 1
        t, first = np.unique(t, return_index=True)
        divided = end[t] > inner[first]
        before = np.where(divided & (t > 0), t - 1, t)
        left = np.where(text[before] == text[t], before, t)
        after = np.minimum(t + 1, len(safe) - 1)
        right = np.where(text[after] == text[t], after, t)
        x, y = safe[left], end[right]
        size, window = self.by_library(buf, x, y, joins[x] & joins[y])
        # a divided stretch takes its ids from the middle of its window
        place = np.r_[0, np.cumsum(self.size[window])]
        base = place[np.cumsum(size) - size]
        want = np.stack([base + safe[t] - x, base + end[t] - x])[:, divided]
        i, j = np.searchsorted(place, want)
        whole = (place[i] == want[0]) & (place[j] == want[1])
        d = t[divided]
        alone, alone_ids = whole_spans(safe[d[~whole]], end[d[~whole]])
        join, source = j - i, len(ids) + i
        join[~whole], source[~whole] = alone, len(ids) + len(window) + np.cumsum(alone) - alone
        order = np.argsort(np.concatenate([start, safe[d]]), kind="stable")
        out = np.concatenate([ids, window, alone_ids])[spans(np.concatenate([np.cumsum(own) - own, source])[order], np.concatenate([own, join])[order])]
        # the ids of the whole must be those of every window
        place = np.r_[0, np.cumsum(self.size[out])]
        i, j = np.searchsorted(place, x), np.searchsorted(place, y)
        agree = (place[i] == x) & (place[j] == y) & (j - i == size)
        k = np.flatnonzero(agree)
        differs = out[spans(i[k], size[k])] != window[spans((np.cumsum(size) - size)[k], size[k])]
        agree[k] = np.bincount(np.repeat(np.arange(len(k)), size[k]), weights=differs, minlength=len(k)) == 0
        bounds = np.searchsorted(place, offs)
        if agree.all():
            return np.diff(bounds), out
        texts = [out[p:q] for p, q in zip(bounds[:-1], bounds[1:])]
        for n in np.flatnonzero(~agree):
            row = text[t[n]]
            own_safe = np.r_[safe[text == row], offs[row + 1]] - offs[row]
            texts[row] = self.repair(buf[offs[row] : offs[row + 1]], own_safe, int(t[n] - np.searchsorted(text, row)), texts[row])
        return np.array([len(x) for x in texts], np.int64), np.concatenate(texts)

    def repair(self, buf: np.ndarray, safe: np.ndarray, t: int, ids: np.ndarray) -> np.ndarray:
        """The ids of a text, with a window around its stretch t encoded again: wider until its outer stretches agree."""
        self.repaired += 1
        wide = 2
        while True:
            lo, hi = max(0, t - wide), min(len(safe) - 1, t + 1 + wide)
            x, y = safe[lo], safe[hi]
            new = np.array(self.library.encode(buf[x:y].tobytes().decode(), add_special_tokens=False).ids, np.uint16)
            if not lo and hi == len(safe) - 1:
                return new
            place, inside = np.r_[0, np.cumsum(self.size[ids])], x + np.r_[0, np.cumsum(self.size[new])]

            def same(p: int, q: int) -> bool:
                """Do both have the same ids from byte p to byte q?"""
                a, b = np.searchsorted(place, [p, q]), np.searchsorted(inside, [p, q])
                return [*place[a], *inside[b]] == [p, q, p, q] and np.array_equal(ids[a[0] : a[1]], new[b[0] : b[1]])

            if (not lo or same(x, safe[lo + 1])) and (hi == len(safe) - 1 or same(safe[hi - 1], y)):
                i, j = np.searchsorted(place, [x, y])
                return np.concatenate([ids[:i], new, ids[j:]])
            wide *= 2

    def decode(self, ids: np.ndarray) -> np.ndarray:
        return self.bytes[spans(self.start[ids], self.size[ids])]


def _byte_letters() -> dict[int, str]:
    """The letters that stand for bytes in byte-level vocabularies: printable ones for themselves, the rest from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}


_codecs: dict[str, Codec] = bs.kept_by("bpe_codec")


def codec(path: str | None) -> Codec:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode_batch(c: Codec, column, every: int) -> Iterator[tuple[np.ndarray, np.ndarray, bytes]]:
    """(ids, own bytes, decoded bytes) of every text."""
    buf, offs = bs.flat(column)
    for i, j in bs.slices(offs):
        piece, at = buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        count, ids = c.encode(piece, at, every)
        bounds = np.r_[0, np.cumsum(count)]
        decoded = c.decode(ids)
        size = np.r_[0, np.cumsum(c.size[ids])][bounds]
        agree = len(decoded) == len(piece) and np.array_equal(size, at) and np.array_equal(decoded, piece)
        for k in range(j - i):
            own, text = ids[bounds[k] : bounds[k + 1]], piece[at[k] : at[k + 1]].tobytes()
            back = decoded[size[k] : size[k + 1]].tobytes()
            if not agree and back != text:
                whole = c.library.encode(text.decode(), add_special_tokens=False).ids
                own, back = np.array(whole, np.uint16), c.library.decode(whole, skip_special_tokens=False).encode()
            yield own, back
        bs.release("bpe_codec")


def encode(docs: DataFrame, text_col: str = "text", vocabulary: str | None = None, every: int = CHUNK_BYTES, with_ids: bool = True) -> DataFrame:
    """``docs`` with n_tokens, ids_sha256, decoded_sha256, and token_ids (array<int>) if ``with_ids``."""
    docs, name = set_aside(docs, (*ADDED, "token_ids") if with_ids else ADDED)
    text_col = name(text_col)
    extra = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    if with_ids:
        extra.append(T.StructField("token_ids", T.ArrayType(T.IntegerType())))
    schema = T.StructType([*docs.schema.fields, *extra])
    arrow, at = to_arrow_schema(schema), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary)
        for batch in batches:
            n, ids_sha, text_sha, held = [], [], [], []
            for ids, back in encode_batch(c, batch.column(at), every):
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                text_sha.append(hashlib.sha256(back).hexdigest())
                if with_ids:
                    held.append(ids)
            more = [pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            if with_ids:
                flat = np.concatenate(held).astype(np.int32) if held else np.zeros(0, np.int32)
                more.append(pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)].astype(np.int32)), pa.array(flat)))
            columns = [x.cast(t.type) for x, t in zip([*batch.columns, *more], arrow)]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return docs.mapInArrow(run, schema)


def decode(encoded: DataFrame, ids_col: str = "token_ids", vocabulary: str | None = None, text_col: str = "decoded") -> DataFrame:
    """``encoded`` with the text of its ids; null ids give a null text."""
    encoded, name = set_aside(encoded, (text_col,))
    ids_col = name(ids_col)
    schema = T.StructType([*encoded.schema.fields, T.StructField(text_col, T.StringType())])
    arrow, at = to_arrow_schema(schema), encoded.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary)
        for batch in batches:
            out = [None if x is None else c.decode(np.array(x, np.int64)).tobytes().decode("utf-8", "replace") for x in batch.column(at).to_pylist()]
            columns = [x.cast(t.type) for x, t in zip([*batch.columns, pa.array(out, pa.string())], arrow)]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return encoded.mapInArrow(run, schema)


def digest(docs: DataFrame) -> DataFrame:
    """The columns of ``op10``."""
    return encode(docs.select("doc_id", "text"), with_ids=False).drop("text")
