"""Tables of the engine, and checks of their invariants."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VECTORS = "vec_id bigint, embedding array<float>"
HITS = "qid bigint, rk int, vec_id bigint, dist double"
CODEBOOK = "m int, k int, centroid array<float>"
NODES = "segment_id bigint, local_id int, vec_id bigint, embedding array<float>, neighbors array<int>, pq_code array<smallint>"
STATS = "qid bigint, segment_id bigint, visited int, pq_distances int, exact_reads int, latency_ms double"


def dimension(vectors: DataFrame, column: str = "embedding") -> int:
    """The one dimension of all vectors; raises if it is 0, differs, or a vector is null."""
    r = vectors.agg(F.min(F.size(column)).alias("lo"), F.max(F.size(column)).alias("hi"), F.count_if(F.col(column).isNull()).alias("nulls")).first()
    if r.lo is None or r.nulls or r.lo != r.hi or r.lo < 1:
        raise ValueError(f"vectors must have one dimension of at least 1, and no nulls (found {r.lo} to {r.hi}, {r.nulls} nulls)")
    return r.lo


def check_same_dimension(a: int, b: int) -> None:
    if a != b:
        raise ValueError(f"dimensions differ: {a} and {b}")


def check_pq(dim: int, parts: int, codes: int) -> int:
    """Dimensions of a subvector; raises unless parts divide dim and a code fits a byte."""
    if not 1 <= parts <= dim or dim % parts:
        raise ValueError(f"{parts} parts don't divide {dim} dimensions")
    if not 1 <= codes <= 256:
        raise ValueError(f"{codes} centroids don't fit a byte")
    return dim // parts
