"""Approximate search over segments: one task for each segment, merged to a global top k.

Nodes of any origin are brought together by segment, which shuffles them for every
block of queries. A store's segments are files of their own (``search_files``): a task
reads them whole and searches in place, and only candidates are shuffled.

Who wants hits only doesn't pay for a walk of every query through every segment, most of
which find nothing of the global top k. A bound for each query comes first: the distance
of the k-th hit of those walks that can meet one of the 2 k nearest vectors. Then a walk
starts only where a product of matrices finds a vector within the bound, and ends when it
has visited all of these, so the hits are exactly those of all walks. A query whose walks
miss too many has no bound, and walks everywhere. Counters need all walks.
"""

from __future__ import annotations

import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import graph, knn, pq

_FOUND = "qid bigint, segment_id bigint, vec_id bigint, dist double, visited int, pq_distances int, latency_ms double"
_HIT = "qid bigint, vec_id bigint, dist double"


def build_nodes(vectors: DataFrame, config: graph.BuildConfig, codebook: DataFrame | None = None) -> DataFrame:
    """Nodes of the segments of (segment_id, vec_id, embedding): local ids by vec_id, neighbours, codes, entry."""
    book = None if codebook is None else pq.codebook_array(codebook)
    sent = vectors.sparkSession.sparkContext.broadcast(book)

    def run(table: pa.Table) -> pa.Table:
        if table.num_rows > knn.SEGMENT_LIMIT:
            raise ValueError(f"a segment has {table.num_rows} vectors; at most {knn.SEGMENT_LIMIT}")
        table = table.sort_by("vec_id")
        x = knn.matrix(table.column("embedding"))
        neighbors, entry = graph.build(x, config)
        codes = pa.nulls(len(x), pa.list_(pa.int16())) if sent.value is None else pa.array(list(pq.codes_of(x, sent.value).astype(np.int16)), pa.list_(pa.int16()))
        return pa.table(
            {
                "segment_id": table.column("segment_id"),
                "local_id": pa.array(np.arange(len(x), dtype=np.int32)),
                "vec_id": table.column("vec_id"),
                "embedding": table.column("embedding").cast(pa.list_(pa.float32())),  # elements may be marked not null
                "neighbors": pa.array(list(neighbors.astype(np.int32)), pa.list_(pa.int32())),
                "pq_code": codes,
                "is_entry": pa.array(np.arange(len(x)) == entry),
            }
        )

    rows = vectors.select(F.col("segment_id").cast("bigint").alias("segment_id"), F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<float>").alias("embedding"))
    return rows.groupBy("segment_id").applyInArrow(run, "segment_id bigint, local_id int, vec_id bigint, embedding array<float>, neighbors array<int>, pq_code array<smallint>, is_entry boolean")


_NODE = ["segment_id", "local_id", "vec_id", "embedding", "neighbors", "pq_code", "is_entry"]


def ann_search(nodes: DataFrame, queries: DataFrame, config: graph.SearchConfig = graph.SearchConfig(), codebook: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(hits, stats): qid, rk, vec_id, dist; and counters of each query and segment.

    The bounds of the hits take passes of their own over the nodes: write or persist nodes that are dear to make.
    """
    rows = nodes.select(*_NODE).groupBy("segment_id")

    def scan(sent) -> DataFrame:
        return rows.applyInArrow(lambda table: _search_segment(table, *sent.value, config), _FOUND)

    def bounded(sent) -> DataFrame:
        return rows.applyInArrow(lambda table: _hits_within(table, *sent.value, config), _HIT)

    _, stats = summaries(_found(nodes, queries, codebook, scan), config.top_k)
    return _bounded_hits(nodes, queries, codebook, bounded, config.top_k), stats


def _bounded_hits(vectors: DataFrame, queries: DataFrame, codebook: DataFrame | None, scan, k: int) -> DataFrame:
    """The hits of all queries by passes of ``scan``, whose broadcast has a bound for each query; ``vectors`` are those of the segments."""
    book = None if codebook is None else pq.codebook_array(codebook)
    spark, out = vectors.sparkSession, None
    own = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding")
    for ids, q in knn.query_blocks(queries, "qid", "embedding") if k >= 1 else ():
        near = knn.scan_block(spark.sparkContext.broadcast((ids, q)), own, 2 * k)
        reach = _bounds(near, ids, 2 * k)
        if not np.isinf(reach).all():
            reach = _bounds(scan(spark.sparkContext.broadcast((ids, q, book, reach))), ids, k)
        found = scan(spark.sparkContext.broadcast((ids, q, book, reach)))
        out = found if out is None else out.unionByName(found)
    return knn.top_k(spark.createDataFrame([], _HIT) if out is None else out, k).select("qid", "rk", "vec_id", "dist")


def _bounds(hits: DataFrame, ids: np.ndarray, k: int) -> np.ndarray:
    """The distance of the k-th hit of each of ``ids``, infinite without one: a number a query comes to the driver."""
    t = knn.top_k(hits, k).where(F.col("rk") == k).select("qid", "dist").toArrow()
    order = np.argsort(t.column("qid").to_numpy())
    qid, dist = t.column("qid").to_numpy()[order], t.column("dist").to_numpy()[order]
    out = np.full(len(ids), np.inf)
    if len(qid):
        at = np.minimum(np.searchsorted(qid, ids), len(qid) - 1)
        out = np.where((qid[at] == ids) & ~np.isnan(dist[at]), dist[at], np.inf)
    return out


def search_files(files: DataFrame, queries: DataFrame, config: graph.SearchConfig = graph.SearchConfig(), codebook: DataFrame | None = None) -> DataFrame:
    """The rows that ``summaries`` takes, of segments that are a Parquet file each: ``content`` has a file's bytes.

    A file that is not one whole segment is an error.
    """

    return _found(files, queries, codebook, lambda sent: _scan_files(files, lambda table: _search_segment(table, *sent.value, config), _FOUND))


def hits_of_files(files: DataFrame, vectors: DataFrame, queries: DataFrame, config: graph.SearchConfig = graph.SearchConfig(), codebook: DataFrame | None = None) -> DataFrame:
    """The hits alone, of the same files; ``vectors``: (vec_id, embedding) of all of them."""

    def scan(sent) -> DataFrame:
        return _scan_files(files, lambda table: _hits_within(table, *sent.value, config), _HIT)

    return _bounded_hits(vectors, queries, codebook, scan, config.top_k)


def _scan_files(files: DataFrame, search, schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for body in batch.column(0):
                table = pa.parquet.read_table(pa.BufferReader(body.as_buffer()), columns=_NODE)
                if not table.num_rows:
                    continue
                local = np.sort(table.column("local_id").to_numpy())
                if (local != np.arange(len(local))).any() or not table.column("is_entry").to_numpy().any():
                    raise ValueError(f"a file has a part of segment {table.column('segment_id')[0]} only")
                yield from search(table).to_batches()

    return files.select("content").mapInArrow(run, schema)


def _found(data: DataFrame, queries: DataFrame, codebook: DataFrame | None, scan) -> DataFrame:
    """Candidates and counters of all queries: a pass of ``scan`` for each block of them."""
    book = None if codebook is None else pq.codebook_array(codebook)
    spark, out = data.sparkSession, None
    for ids, q in knn.query_blocks(queries, "qid", "embedding"):
        found = scan(spark.sparkContext.broadcast((ids, q, book)))
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], _FOUND) if out is None else out


def summaries(found: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """(hits, stats) of the candidates; who reads both keeps ``found`` first, or the search runs twice."""
    hits = knn.top_k(found.where(F.col("vec_id").isNotNull()).select("qid", "vec_id", "dist"), k).select("qid", "rk", "vec_id", "dist")
    stats = found.groupBy("qid", "segment_id").agg(F.max("visited").alias("visited"), F.max("pq_distances").alias("pq_distances"), F.max("visited").alias("exact_reads"), F.max("latency_ms").alias("latency_ms"))
    return hits, stats


def _open(table: pa.Table, q: np.ndarray, book: np.ndarray | None):
    """A segment's vectors, ids, neighbours, entry and codes."""
    table = table.sort_by("local_id")
    x = knn.matrix(table.column("embedding"))
    if q.shape[1] != x.shape[1]:
        raise ValueError(f"dimensions differ: {q.shape[1]} and {x.shape[1]}")
    neighbors = knn.matrix(table.column("neighbors")).astype(np.int64)
    entry = int(np.flatnonzero(table.column("is_entry").to_numpy(zero_copy_only=False))[0])
    codes = None if book is None else knn.matrix(table.column("pq_code")).astype(np.int64)
    return x, table.column("vec_id").to_numpy(), neighbors, entry, codes


def _adc(own: np.ndarray, book: np.ndarray | None, codes: np.ndarray | None):
    if book is None:
        return None
    d = book.shape[2]
    return np.stack([pq.sub_distances(own[None, m * d : (m + 1) * d], book[m])[0] for m in range(len(book))]), codes


def _search_segment(table: pa.Table, ids: np.ndarray, q: np.ndarray, book: np.ndarray | None, config: graph.SearchConfig) -> pa.Table:
    x, vec, neighbors, entry, codes = _open(table, q, book)
    segment = table.column("segment_id")[0].as_py()
    columns: list[list] = [[] for _ in range(6)]
    for i, own in zip(ids.tolist(), q):
        began = time.perf_counter()
        rows, dist, visited, n_pq = graph.beam_search(x, neighbors, entry, own, config, _adc(own, book, codes))
        ms = (time.perf_counter() - began) * 1000
        found = vec[rows].tolist() or [None]
        for c, v in zip(columns, ([i] * len(found), found, dist.tolist() or [None], [visited] * len(found), [n_pq] * len(found), [ms] * len(found))):
            c.extend(v)
    types = (pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.float64())
    qid, vid, dist, visited, n_pq, ms = (pa.array(c, t) for c, t in zip(columns, types))
    return pa.table({"qid": qid, "segment_id": pa.array([segment] * len(qid), pa.int64()), "vec_id": vid, "dist": dist, "visited": visited, "pq_distances": n_pq, "latency_ms": ms})


def _hits_within(table: pa.Table, ids: np.ndarray, q: np.ndarray, book: np.ndarray | None, reach: np.ndarray, config: graph.SearchConfig) -> pa.Table:
    """What walks find within each query's bound; where a segment has nothing within it, there is no walk."""
    x, vec, neighbors, entry, codes = _open(table, q, book)
    columns: list[list] = [[] for _ in range(3)]
    for i, row, col in knn.within(q, x, reach):
        for r in np.unique(row).tolist():
            own = q[i + r]
            wanted = None if np.isinf(reach[i + r]) else set(col[np.searchsorted(row, r) : np.searchsorted(row, r, "right")].tolist())
            rows, dist, _, _ = graph.beam_search(x, neighbors, entry, own, config, _adc(own, book, codes), wanted)
            keep = ~(dist > reach[i + r])
            for c, v in zip(columns, ([int(ids[i + r])] * int(keep.sum()), vec[rows[keep]].tolist(), dist[keep].tolist())):
                c.extend(v)
    return pa.table({n: pa.array(c, t) for n, c, t in zip(("qid", "vec_id", "dist"), columns, (pa.int64(), pa.int64(), pa.float64()))})
