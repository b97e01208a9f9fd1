"""N-gram Jaccard join: MinHash bands for candidates, full n-gram sets for the verdict.

1. Each text becomes the set of its word n-grams (all its words, if fewer), a
   key of that set, and ``bands`` hashes of ``rows`` minima each. Texts with
   equal sets form a class and go on as one row with a count.
2. Classes are shuffled on their band hashes. The classes of a band hash, all of
   them candidates of each other, meet in a cell: that of the least class which
   the band's own least class meets. So the bands of a group of near copies share
   one cell, a text goes to few cells, and a cell ends after two such steps: links
   that were never verified don't chain classes into one large component.
3. The n-gram sets of each cell are compared: small cells whole, large ones cut
   into pieces, and each pair of pieces in a task of its own. All pairs at or over
   the threshold count as links, in the least cell that both have. A task returns
   counts for each text and a spanning forest of its links, so no pair is written out.
4. Components of the verified links are the classes of near-duplicates.

``rows`` and ``bands`` come from the threshold and the target recall: the
largest number of rows whose number of bands stays within ``MOST_BANDS``.
Cells hold pairs without a common band too, and find the links among those.

Defined cases: null and empty texts, and texts without words, have no links and
are their own class; texts are compared by sets, so repeated n-grams count once;
rows that repeat an id are separate documents; a null id takes part, and is the
class id only if the class has no other id; carried columns come back under the
name ``in_<name>`` if an added column has theirs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bytescan as bs
from .components import components
from .scratch import few, materialise, parts_of, set_aside, spread_join

U = np.uint64
WORDS, THRESHOLD, RECALL = 5, 0.8, 0.9999
MOST_BANDS = 36
#: Distinct texts, and their n-grams, of a cell that are compared with as many others at once.
PIECE, PIECE_GRAMS = 1024, 1 << 20
#: Numbers of a matrix of sets by members.
SLAB = 2 << 20
#: Bytes of n-gram hashes of a hash part.
PART_BYTES = 16 << 20
ADDED = ("class_id", "n_links", "set_key")
#: Most rows of six numbers that are broadcast: 24 MB.
BROADCAST_ROWS = 1 << 19
SEED = 7


def bands_for(threshold: float, recall: float, most: int = MOST_BANDS) -> tuple[int, int]:
    """(bands, rows): as many rows a band as the target recall at the threshold allows."""
    best = (most, 1)
    for rows in range(1, 33):
        bands = math.ceil(math.log(1 - recall) / math.log1p(-(threshold**rows)))
        if bands > most:
            break
        best = (bands, rows)
    return best


def _sets(column, n: int):
    """(distinct n-gram hashes, row) over some texts, sorted by row and hash."""
    buf, offs = bs.flat(column)
    for i, j in bs.slices(offs):
        piece, at = buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        h, _, _, row = bs.token_hashes(piece, at, bs.WORDS_LOWER)
        s, r = bs.shingles(h, row, j - i, n)
        order = np.lexsort((s, r))
        s, r = s[order], r[order]
        first = np.r_[True, (s[1:] != s[:-1]) | (r[1:] != r[:-1])] if len(s) else np.zeros(0, bool)
        yield i, j, s[first], r[first]


def _set_key(s: np.ndarray, r: np.ndarray, n: int) -> np.ndarray:
    """A key of each row's set."""
    bounds = bs.row_bounds(r, n)
    pre = np.zeros(len(s) + 1, U)
    np.cumsum(bs.mix(s + U(0x632BE59BD9B4E019)), out=pre[1:])
    return bs.mix((pre[bounds[1:]] - pre[bounds[:-1]]) * U(bs.BASE) + np.diff(bounds).astype(U))


_OWN = "vectide_id bigint, vectide_key bigint, vectide_size bigint, vectide_bands array<bigint>"


def signatures(docs: DataFrame, id_col: str, text_col: str, n: int, bands: int, rows: int, carry: list[str]) -> DataFrame:
    """The columns ``carry`` and vectide_id, vectide_key (null without words), vectide_size, vectide_bands."""
    rng = np.random.default_rng(SEED)
    a = (rng.integers(0, 1 << 32, bands * rows, dtype=np.uint64) | 1).astype(np.uint32)
    b = rng.integers(0, 1 << 32, bands * rows, dtype=np.uint64).astype(np.uint32)
    salt = rng.integers(0, 1 << 63, bands, dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bs.release()
        for batch in batches:
            for i, j, s, r in _sets(batch.column(1), n):
                m = j - i
                key = _set_key(s, r, m)
                bounds = bs.row_bounds(r, m)
                some = np.flatnonzero(np.diff(bounds))
                out = np.zeros((m, bands), np.int64)
                if len(some):
                    x = (bs.mix(s) >> U(32)).astype(np.uint32)
                    at = bounds[:-1][some]
                    for band in range(bands):
                        h = np.full(len(some), salt[band], U)
                        for k in range(band * rows, (band + 1) * rows):
                            v = x * a[k] + b[k]
                            v ^= v >> np.uint32(15)
                            h = (h ^ np.minimum.reduceat(v, at)) * U(bs.BASE)
                            h ^= h >> U(29)
                        out[some, band] = bs.mix(h).view(np.int64)
                empty = np.diff(bounds) == 0
                flat = out.ravel()
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (m + 1) * bands, bands, dtype=np.int32)), pa.array(flat))
                own = [batch.column(0)[i:j].cast(pa.int64()), pa.array(key.view(np.int64), mask=empty), pa.array(np.diff(bounds)), lists]
                yield pa.RecordBatch.from_arrays([batch.column(2 + c)[i:j] for c in range(len(carry))] + own, names=names)
            bs.release()

    held = [docs.schema[c] for c in carry]
    schema = T.StructType([*held, *T._parse_datatype_string(_OWN).fields])
    names = schema.names
    return docs.select(F.col(id_col), F.col(text_col), *[F.col(c).alias(f"carried{k}") for k, c in enumerate(carry)]).mapInArrow(run, schema)


def _common(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The number of common members of every set of ``left`` and of ``right``, as a matrix."""
    size = np.array([len(x) for x in sets])
    used = bs.distinct(np.r_[left, right])
    member = np.concatenate([sets[i] for i in used])
    owner = np.repeat(used, size[used])
    _, col = np.unique(member, return_inverse=True)
    many = np.bincount(col) > 1  # what one set only has meets nothing
    number = np.cumsum(many) - 1
    owner, col = owner[many[col]], number[col[many[col]]]
    width = int(many.sum())
    place_l = np.full(len(sets), -1)
    place_l[left] = np.arange(len(left))
    place_r = np.full(len(sets), -1)
    place_r[right] = np.arange(len(right))
    common = np.zeros((len(left), len(right)), np.float32)
    step = max(256, SLAB // max(len(left), len(right), 1))
    order = np.argsort(col, kind="stable")
    owner, col = owner[order], col[order]
    for at in range(0, width, step):
        x = slice(*np.searchsorted(col, [at, at + step]))
        o, c = owner[x], col[x] - at
        dense = []
        for place, n in ((place_l, len(left)), (place_r, len(right))):
            m = np.zeros((n, min(step, width - at)), np.float32)
            here = place[o] >= 0
            m[place[o[here]], c[here]] = 1
            dense.append(m)
        common += dense[0] @ dense[1].T
    return common


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least member of each one's component, for links i - j."""
    root = np.arange(n)
    while True:
        low = root.copy()
        np.minimum.at(low, i, root[j])
        np.minimum.at(low, j, root[i])
        low = low[low]
        if (low == root).all():
            return root
        root = low


def _verify(sets: list[np.ndarray], count: np.ndarray, lesser: list[np.ndarray], left: np.ndarray, right: np.ndarray, threshold: float):
    """(links of each set to other classes' documents, least member of its component) among the pairs of left x right.

    lesser: the cells of each that come before this one; pairs that share one of them are counted there.
    """
    size = np.array([len(x) for x in sets])
    common = _common(sets, left, right)
    found = common >= threshold * (size[left][:, None] + size[right][None, :] - common) - 1e-6
    if left is right:
        found &= np.arange(len(left))[:, None] < np.arange(len(left))[None, :]
    i, j = np.nonzero(found)
    root = _roots(len(sets), left[i], right[j])
    if any(len(x) for x in lesser):
        own = _common(lesser, left, right)[i, j] == 0
        i, j = i[own], j[own]
    i, j = left[i], right[j]
    links = np.bincount(i, weights=count[j], minlength=len(sets)) + np.bincount(j, weights=count[i], minlength=len(sets))
    return links.astype(np.int64), root


def similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL, carry: list[str] | None = None) -> DataFrame:
    """Per document: the columns ``carry`` (default: the id) and class_id (least id of its class), n_links, set_key
    (equal for equal sets)."""
    bands, rows = bands_for(threshold, recall)
    docs, name = set_aside(docs, [*ADDED, *(f"vectide_{c}" for c in ("id", "key", "size", "bands", "class_id", "n_links"))])
    id_col, text_col, carry = name(id_col), name(text_col), [name(c) for c in carry or [id_col]]
    rows_of = materialise(signatures(docs, id_col, text_col, n, bands, rows, carry), "signatures")
    of = _classes(docs, rows_of, id_col, text_col, n, threshold, bands).select(*[F.col(c).alias(f"vectide_{c}") for c in ("key", "class_id", "n_links")], F.col("count").alias("n"))
    own = spread_join(rows_of.where("vectide_key IS NOT NULL"), materialise(of, "classes-of"), "vectide_key", rows_of.count())
    lone = rows_of.where("vectide_key IS NULL").withColumns({"vectide_class_id": F.col("vectide_id"), "vectide_n_links": F.lit(0).cast("long")})
    return own.unionByName(lone).select(*carry, F.col("vectide_class_id").alias("class_id"), F.col("vectide_n_links").alias("n_links"), F.col("vectide_key").alias("set_key"))


def _cells(rows_of: DataFrame, classes: DataFrame, total: int) -> DataFrame:
    """key, cell, cells (all of the key's), first_id, count, grams: one row a class and cell of two classes or more."""
    band = rows_of.where("vectide_key IS NOT NULL").select(F.col("vectide_key").alias("key"), F.explode("vectide_bands").alias("band")).distinct()
    least = band.groupBy("band").agg(F.min("key").alias("low"), F.max("key").alias("high"), F.count("*").alias("n")).where("low < high").drop("high")
    met = materialise(spread_join(band, least, "band", total).select("key", "low").distinct(), "met")
    # the least class that each one meets; of those, the ones that are the least of a band name its cell
    first = met.groupBy("key").agg(F.min("low").alias("cell"))
    follow = met.groupBy("low").agg(F.count("*").alias("n"))
    first = follow.join(first, follow["low"] == first["key"]).select("low", "n", "cell")
    cell = spread_join(met, first, "low", met.count()).select("key", "cell").distinct()
    cells = cell.groupBy("key").agg(F.sort_array(F.collect_set("cell")).alias("cells"))  # at most one a band
    return cells.join(classes, "key").withColumn("cell", F.explode("cells"))


def _classes(docs: DataFrame, rows_of: DataFrame, id_col: str, text_col: str, n: int, threshold: float, bands: int) -> DataFrame:
    """key, v (key of the class), first_id, count, class_id, n_links of every distinct set."""
    total = rows_of.count()
    classes = rows_of.where("vectide_key IS NOT NULL").groupBy(F.col("vectide_key").alias("key")).agg(F.min("vectide_id").alias("first_id"), F.count("*").alias("count"), F.max("vectide_size").alias("grams"))
    classes = materialise(classes, "classes")
    member = materialise(_cells(rows_of, classes, total * bands), "cells")

    # large cells go in pieces, each pair of pieces to one task
    size = member.groupBy("cell").agg(F.greatest(F.ceil(F.count("*") / PIECE), F.ceil(F.sum("grams") / PIECE_GRAMS)).cast("int").alias("pieces"), F.count("*").alias("n"))
    member = spread_join(member, size, "cell", member.count()).withColumn("piece", F.pmod(F.xxhash64("key"), F.col("pieces")).cast("int"))
    member = materialise(member.select("key", "cell", "cells", "pieces", "piece", "first_id", "count", "grams"), "members")
    parts = parts_of(int(member.agg(F.sum(F.col("grams") * F.col("pieces"))).first()[0] or 0) * 8, PART_BYTES)
    text = docs.select(F.col(id_col).cast("bigint").alias("first_id"), F.col(text_col).alias("text"))
    own = few(member.withColumnRenamed("first_id", "of_id"), BROADCAST_ROWS)
    full = text.join(own, text["first_id"].eqNullSafe(own["of_id"])).select("key", "cell", "cells", "pieces", "piece", "count", "text")
    others = F.transform(
        F.sequence(F.lit(0), F.col("pieces") - 1),
        lambda x: F.struct(F.least(x, "piece").alias("a"), F.greatest(x, "piece").alias("b"), F.when(x == F.col("piece"), 2).when(F.col("piece") < x, 0).otherwise(1).alias("side")),
    )
    dealt = full.withColumn("o", F.explode(others)).select("key", "cell", F.filter("cells", lambda x: x < F.col("cell")).alias("lesser"), "count", "text", F.col("o.a").alias("a"), F.col("o.b").alias("b"), F.col("o.side").alias("side"))
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("cell", "a", "b"), F.lit(parts)).cast("int"))

    def compare(table: pa.Table) -> pa.Table:
        bs.release()
        table = table.sort_by([(c, "ascending") for c in ("cell", "a", "b", "key", "side")])
        key, cell, a, b, side, count = (table.column(c).to_numpy() for c in ("key", "cell", "a", "b", "side", "count"))
        keys, links, roots = [], [], []
        new = np.flatnonzero(np.r_[True, (cell[1:] != cell[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1]), True]) if len(key) else []
        for lo, hi in zip(new[:-1], new[1:]):
            sets: dict[int, tuple[int, np.ndarray]] = {}
            at = lo
            for chunk in table.column("text").slice(lo, hi - lo).chunks:
                for i, j, s, r in _sets(chunk, n):
                    bounds = bs.row_bounds(r, j - i)
                    for k, own in enumerate(_set_key(s, r, j - i).view(np.int64).tolist()):
                        if own == key[at + k]:  # of rows that repeat an id, the one with this set
                            sets.setdefault(own, (at + k, s[bounds[k] : bounds[k + 1]]))
                    at += j - i
            at = np.array([x for x, _ in sets.values()], np.int64)
            lesser = [np.array(x, np.int64) for x in table.column("lesser").take(pa.array(at)).to_pylist()]
            own = side[at]
            left = np.flatnonzero(own != 1)
            right = left if (own == 2).all() else np.flatnonzero(own == 1)
            found, root = _verify([x for _, x in sets.values()], count[at], lesser, left, right, threshold)
            some = (found > 0) | (root != np.arange(len(root)))
            keys.append(key[at][some]), links.append(found[some]), roots.append(key[at][root][some])
        bs.release()
        one = lambda x: pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64())
        return pa.table({"key": one(keys), "links": one(links), "to": one(roots)})

    checked = materialise(dealt.groupBy("part").applyInArrow(compare, "key bigint, links bigint, to bigint"), "verified")
    links = checked.groupBy("key").agg(F.sum("links").alias("links")).where("links > 0")
    found = components(checked.select(F.col("key").alias("u"), F.col("to").alias("v")))
    root = classes.join(found.withColumnRenamed("u", "key"), "key", "left").withColumn("v", F.coalesce("v", "key"))
    root = materialise(root.join(links, "key", "left"), "roots")
    first = root.groupBy("v").agg(F.min("first_id").alias("class_id"), F.count("*").alias("n"))
    of = spread_join(root, first, "v", total)
    return of.select("key", "v", "first_id", "count", "class_id", (F.coalesce("links", F.lit(0)) + F.col("count") - 1).alias("n_links"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """``docs`` with one document of each class, one with the least id; all documents without words stay.

    What goes is joined to the texts, not what stays: copies are fewer, and no text
    is shuffled while they are few enough to broadcast.
    """
    bands, rows = bands_for(threshold, recall)
    columns = docs.columns
    docs = docs.toDF(*[f"c{k}" for k in range(len(columns))])  # no name of theirs meets one of ours
    id_col, text_col = (f"c{columns.index(c)}" for c in (id_col, text_col))
    rows_of = materialise(signatures(docs, id_col, text_col, n, bands, rows, docs.columns), "signatures")
    of = materialise(_classes(docs, rows_of, id_col, text_col, n, threshold, bands), "classes-of")
    lowest = F.lit(-(1 << 63))
    # the one set of each class that stays: of those with the least id, the one of least key
    stays = of.where(F.col("first_id").eqNullSafe(F.col("class_id"))).groupBy("v").agg(F.min("key").alias("key"))
    whole = of.join(stays.select(F.col("key").alias("kept")), F.col("key") == F.col("kept"), "left")
    small = rows_of.where(F.col("vectide_key").isNotNull()).select(F.col("vectide_key").alias("key"), F.coalesce("vectide_id", lowest).alias("id"))
    marked = spread_join(small, whole.select("key", "kept", F.coalesce("class_id", lowest).alias("class_id"), F.col("count").alias("n")), "key", rows_of.count())
    goes = marked.where(F.col("kept").isNull() | (F.col("id") != F.col("class_id"))).select("key", "id").distinct()
    goes = materialise(goes, "copies").withColumnsRenamed({"key": "vectide_go_key", "id": "vectide_go_id"})
    same = (F.col("vectide_key") == F.col("vectide_go_key")) & (F.coalesce("vectide_id", lowest) == F.col("vectide_go_id"))
    left = rows_of.join(few(goes, BROADCAST_ROWS), same, "left_anti")
    # rows that repeat both the id and the set: one of them
    twice = small.groupBy("key", "id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("key").alias("vectide_go_key"), F.col("id").alias("vectide_go_id"))
    twice = materialise(twice, "repeated")
    if twice.isEmpty():
        return left.select(*docs.columns).toDF(*columns)
    once = left.join(few(twice, BROADCAST_ROWS), same, "left_anti").select(*docs.columns)
    repeated = left.join(few(twice, BROADCAST_ROWS), same, "left_semi").dropDuplicates(["vectide_key", "vectide_id"])
    return once.unionByName(repeated.select(*docs.columns)).toDF(*columns)


def digest(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, class_id, n_links, set_key."""
    return similar(docs.select("doc_id", "text"))
