"""Product quantisation: training, codes, asymmetric distances, two-stage search.

A codebook has at most 256 centroids for each of at most ``dim`` parts, so it is
always small enough to send to every worker.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import l2_squared, subvector
from ..schema import check_pq, dimension
from . import knn


def first_rows_codebook(vectors: DataFrame, parts: int, codes: int) -> DataFrame:
    """m, k, centroid: the subvectors of the ``codes`` vectors with the least ids."""
    d_sub = check_pq(dimension(vectors), parts, codes)
    first = vectors.orderBy("vec_id").limit(codes).select("vec_id", "embedding")
    rows = first.orderBy("vec_id").collect()  # at most 256
    data = [(m, k, [float(x) for x in r.embedding[m * d_sub : (m + 1) * d_sub]]) for k, r in enumerate(rows) for m in range(parts)]
    return vectors.sparkSession.createDataFrame(data, "m int, k int, centroid array<float>")


def codebook_array(codebook: DataFrame) -> np.ndarray:
    """The codebook as an array [m, k, j]."""
    rows = codebook.orderBy("m", "k").collect()  # parts x codes, both bounded
    parts, codes = max(r.m for r in rows) + 1, max(r.k for r in rows) + 1
    if len(rows) != parts * codes:
        raise ValueError("the codebook has gaps")
    return np.array([r.centroid for r in rows], np.float64).reshape(parts, codes, -1)


def codebook_frame(spark, book: np.ndarray) -> DataFrame:
    data = [(m, k, [float(x) for x in book[m, k]]) for m in range(book.shape[0]) for k in range(book.shape[1])]
    return spark.createDataFrame(data, "m int, k int, centroid array<float>")


def sub_distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared L2 of all rows of x to all centroids, dimension by dimension."""
    out = np.zeros((len(x), len(centroids)))
    for j in range(x.shape[1]):
        out += (x[:, j, None] - centroids[None, :, j]) ** 2
    return out


def codes_of(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Nearest centroid of each part; ties take the lowest."""
    d = book.shape[2]
    return np.stack([sub_distances(x[:, m * d : (m + 1) * d], book[m]).argmin(1) for m in range(len(book))], axis=1)


def encode(vectors: DataFrame, codebook: DataFrame) -> DataFrame:
    """vec_id, pq_code."""
    book = vectors.sparkSession.sparkContext.broadcast(codebook_array(codebook))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = codes_of(knn.matrix(batch.column(1)), book.value) if batch.num_rows else np.zeros((0, 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(codes.astype(np.int16)), pa.list_(pa.int16()))], names=["vec_id", "pq_code"])

    return vectors.select(F.col("vec_id").cast("bigint"), "embedding").mapInArrow(run, "vec_id bigint, pq_code array<smallint>")


def decode(codes: DataFrame, codebook: DataFrame) -> DataFrame:
    """vec_id, decoded: the chosen centroids, one after the other."""
    book = codes.sparkSession.sparkContext.broadcast(codebook_array(codebook))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                code = knn.matrix(batch.column(1)).astype(np.int64)
                x = np.concatenate([book.value[m][code[:, m]] for m in range(code.shape[1])], axis=1).astype(np.float32)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(x), pa.list_(pa.float32()))], names=["vec_id", "decoded"])

    return codes.select(F.col("vec_id").cast("bigint"), "pq_code").mapInArrow(run, "vec_id bigint, decoded array<float>")


def error(vectors: DataFrame, codebook: DataFrame, codes: DataFrame | None = None) -> DataFrame:
    """vec_id, error: distance of each vector to its decoded code.

    Without ``codes`` (vec_id, pq_code) each vector is encoded in the same pass, and nothing is shuffled; with them,
    codes are joined, not decoded vectors.
    """
    book = vectors.sparkSession.sparkContext.broadcast(codebook_array(codebook))
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding")
    rows = rows if codes is None else rows.join(codes.select("vec_id", "pq_code"), "vec_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = knn.matrix(batch.column(1))
            code = codes_of(x, book.value) if batch.num_columns < 3 else knn.matrix(batch.column(2)).astype(np.int64)
            off = x - np.concatenate([book.value[m][code[:, m]] for m in range(code.shape[1])], axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array((off**2).sum(1))], names=["vec_id", "error"])

    return rows.mapInArrow(run, "vec_id bigint, error double")


def adc_tables(queries: DataFrame, codebook: DataFrame, d_sub: int) -> DataFrame:
    """qid, m, k, dist: distance of each query's m-th subvector to each centroid."""
    joined = queries.join(F.broadcast(codebook))
    return joined.select("qid", "m", "k", l2_squared(subvector(F.col("embedding"), F.col("m"), d_sub), F.col("centroid")).alias("dist"))


def adc_search(queries: DataFrame, codes: DataFrame, codebook: DataFrame, k: int, places: int | None = None) -> DataFrame:
    """qid, rk, vec_id, dist: the k nearest codes by asymmetric distance; the codes are scanned, vectors never.

    Queries go to the workers in blocks; a task makes the tables of a few queries at a time. With ``places``, distances
    are rounded before they are compared, so that equal codes tie.
    """
    book = codebook_array(codebook)
    out = None
    for ids, q in knn.query_blocks(queries, "qid", "embedding"):
        sent = codes.sparkSession.sparkContext.broadcast((ids, q, book))

        def scan(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, q, book = sent.value
            held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
            for batch in batches:
                if batch.num_rows:
                    found = _nearest_codes(q, batch.column(0).to_numpy(), knn.matrix(batch.column(1)).astype(np.int64), book, k, places)
                    held = knn.best(*(np.concatenate(x) for x in zip(held, found)), k)
            yield pa.RecordBatch.from_arrays([pa.array(ids[held[0]]), pa.array(held[1]), pa.array(held[2])], names=["qid", "vec_id", "dist"])

        hits = codes.select(F.col("vec_id").cast("bigint"), "pq_code").mapInArrow(scan, "qid bigint, vec_id bigint, dist double")
        out = hits if out is None else out.unionByName(hits)
    if out is None:
        return codes.sparkSession.createDataFrame([], "qid bigint, rk int, vec_id bigint, dist double")
    return knn.top_k(out, k).select("qid", "rk", "vec_id", "dist")


def _nearest_codes(q: np.ndarray, vec: np.ndarray, code: np.ndarray, book: np.ndarray, k: int, places: int | None):
    """(row of q, id, distance) of the k nearest codes; tables and distances have at most ``TILE`` numbers."""
    parts, _, d = book.shape
    high = max(1, knn.TILE // max(len(vec), book.shape[0] * book.shape[1]))
    out = []
    for i in range(0, len(q), high):
        own = q[i : i + high]
        dist = np.zeros((len(own), len(vec)))
        for m in range(parts):
            dist += sub_distances(own[:, m * d : (m + 1) * d], book[m])[:, code[:, m]]
        if places is not None:
            dist = np.round(dist, places)
        n = min(k, len(vec))
        row, col = np.nonzero(dist <= np.partition(dist, n - 1, axis=1)[:, n - 1 : n])
        row, ids, own = knn.best(row, vec[col], dist[row, col], k)
        out.append((row + i, ids, own))
    return tuple(np.concatenate(x) for x in zip(*out))


def rerank(candidates: DataFrame, queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """qid, rk, vec_id, dist: the candidates ordered by exact distance; only their vectors are joined."""
    joined = candidates.select("qid", "vec_id").join(vectors.select("vec_id", "embedding"), "vec_id")
    joined = joined.join(queries.select("qid", F.col("embedding").alias("query")), "qid")
    exact = joined.select("qid", "vec_id", l2_squared(F.col("query"), F.col("embedding")).alias("dist"))
    return knn.top_k(exact, k).select("qid", "rk", "vec_id", "dist")


def assign(vectors: DataFrame, codebook: DataFrame, parts: int, d_sub: int) -> DataFrame:
    """vec_id, m, k, dist: nearest centroid of every subvector, ties to the lowest k."""
    book = vectors.sparkSession.sparkContext.broadcast(codebook_array(codebook))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, x = batch.column(0).to_numpy(), knn.matrix(batch.column(1))
            for m in range(parts):
                dist = sub_distances(x[:, m * d_sub : (m + 1) * d_sub], book.value[m])
                k = dist.argmin(1)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.full(len(k), m, np.int32)), pa.array(k.astype(np.int32)), pa.array(dist[np.arange(len(k)), k])], names=["vec_id", "m", "k", "dist"])

    return vectors.select(F.col("vec_id").cast("bigint"), "embedding").mapInArrow(run, "vec_id bigint, m int, k int, dist double")


def partial_sums(vectors: DataFrame, book: np.ndarray) -> DataFrame:
    """m, k, n, sums, far, far_id, point of each task's part of a cluster; what meets is bounded by the codebook's size."""
    sent = vectors.sparkSession.sparkContext.broadcast(book)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _partial(batches, sent.value)

    return vectors.select(F.col("vec_id").cast("bigint"), "embedding").mapInArrow(run, "m int, k int, n bigint, sums array<double>, far double, far_id bigint, point array<double>")


def lloyd_step(vectors: DataFrame, codebook: DataFrame, parts: int, d_sub: int) -> DataFrame:
    """m, k, j, mean, n: the mean of each non-empty cluster, dimension by dimension."""
    found = partial_sums(vectors, codebook_array(codebook)).groupBy("m", "k").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[j]).alias(f"s{j}") for j in range(d_sub)])
    means = F.array(*[F.col(f"s{j}") / F.col("n") for j in range(d_sub)])
    return found.select("m", "k", F.posexplode(means).alias("j", "mean"), "n")


def train(vectors: DataFrame, parts: int = 64, codes: int = 256, iterations: int = 25, seed: int = 42) -> DataFrame:
    """m, k, centroid by k-means of each part, over all vectors.

    Each iteration scans the vectors once; a task returns sums, counts and its
    farthest points, so what meets is bounded by the codebook's size. An empty
    cluster takes the farthest point of its part, the next one the next farthest.
    """
    d_sub = check_pq(dimension(vectors), parts, codes)
    spark = vectors.sparkSession
    start = vectors.orderBy(F.xxhash64(F.lit(seed), "vec_id"), "vec_id").limit(codes).select("embedding").toArrow()
    x = knn.matrix(start.column(0))
    x = x[np.arange(codes) % len(x)]
    book = np.stack([x[:, m * d_sub : (m + 1) * d_sub] for m in range(parts)])
    for _ in range(iterations):
        found = partial_sums(vectors, book).groupBy("m", "k").agg(
            F.sum("n").alias("n"),
            *[F.sum(F.col("sums")[j]).alias(f"s{j}") for j in range(d_sub)],
            F.max(F.struct("far", (-F.col("far_id")).alias("neg"), "point")).alias("f"),
        )
        book = _updated(book, found.collect())  # one row a centroid
    return codebook_frame(spark, book)


def _partial(batches: Iterator[pa.RecordBatch], book: np.ndarray) -> Iterator[pa.RecordBatch]:
    parts, codes, d = book.shape
    n, sums = np.zeros((parts, codes), np.int64), np.zeros(book.shape)
    far = np.full((parts, codes), -1.0)
    far_id, point = np.zeros((parts, codes), np.int64), np.zeros(book.shape)
    for batch in batches:
        if not batch.num_rows:
            continue
        ids, x = batch.column(0).to_numpy(), knn.matrix(batch.column(1))
        for m in range(parts):
            sub = x[:, m * d : (m + 1) * d]
            dist = sub_distances(sub, book[m])
            k = dist.argmin(1)
            own = dist[np.arange(len(k)), k]
            n[m] += np.bincount(k, minlength=codes)
            for j in range(d):
                sums[m, :, j] += np.bincount(k, weights=sub[:, j], minlength=codes)
            order = np.lexsort((-ids, own))  # the last of a cluster is its farthest, the lowest id of equals
            last = np.full(codes, -1)
            last[k[order]] = order
            for c in np.flatnonzero(last >= 0):
                i = last[c]
                if (own[i], -ids[i]) > (far[m, c], -far_id[m, c]):
                    far[m, c], far_id[m, c], point[m, c] = own[i], ids[i], sub[i]
    m, k = np.nonzero(n)
    yield pa.RecordBatch.from_arrays(
        [pa.array(m.astype(np.int32)), pa.array(k.astype(np.int32)), pa.array(n[m, k]), pa.array(list(sums[m, k])), pa.array(far[m, k]), pa.array(far_id[m, k]), pa.array(list(point[m, k]))],
        names=["m", "k", "n", "sums", "far", "far_id", "point"],
    )


def _updated(book: np.ndarray, found: list) -> np.ndarray:
    out = book.copy()
    parts, codes, d = book.shape
    taken = np.zeros((parts, codes), bool)
    far: list[list] = [[] for _ in range(parts)]
    for r in found:
        out[r.m, r.k] = [r[f"s{j}"] / r.n for j in range(d)]
        taken[r.m, r.k] = True
        far[r.m].append((-r.f.far, -r.f.neg, r.f.point))
    for m in range(parts):
        spare = sorted(far[m], key=lambda x: x[:2])
        for k, (_, _, point) in zip(np.flatnonzero(~taken[m]), spare):
            out[m, k] = point
    return out
