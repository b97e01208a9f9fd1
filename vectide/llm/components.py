"""Connected components of an edge table, without bringing it to the driver.

Alternates the large-star and small-star steps: each vertex's larger neighbours,
then its smaller ones, are linked to the least vertex that it knows. Edges never
grow in number, a vertex's neighbours are aggregated with map-side combining and
never listed in one row, and the number of rounds grows with the logarithm of
the longest path. A vertex with very many
neighbours is spread over all tasks. Every round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import discard, materialise, spread_join


def _star(edges: DataFrame, large: bool, total: int) -> DataFrame:
    """edges: (u, v) with u > v, distinct."""
    if large:
        # v in N(u), v > u: link to the least of u and N(u)
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        ahead = edges.select(F.col("v").alias("u"), F.col("u").alias("w"))  # w > u
        linked = spread_join(ahead, least, "u", 2 * total).select(F.col("w").alias("u"), F.col("m").alias("v"))
    else:
        # v in N(u), v <= u: link v and u to the least of them
        least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        linked = spread_join(edges, least, "u", total).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return linked.where(F.col("u") != F.col("v")).distinct()


def _state(edges: DataFrame):
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(u, v): every vertex of an edge but the least of its component, and that least one."""
    now = edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where(F.col("u") != F.col("v")).distinct()
    now = materialise(now, "edges")
    state = _state(now)
    while True:
        half = _star(now, True, state[0])
        then = materialise(_star(half, False, state[0]), "edges")
        found = _state(then)
        discard(now)
        now = then
        if found == state:
            return now
        state = found
