"""Vector arithmetic on array columns, in higher-order functions that Catalyst sees through.

Distances are squared L2, summed in double precision from the first dimension on.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def l2_squared(a: Column, b: Column) -> Column:
    """Squared L2 distance of two arrays of equal length; null if either is null."""
    squares = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.aggregate(squares, F.lit(0.0), lambda s, x: s + x)


def subvector(v: Column, m: Column | int, d_sub: int) -> Column:
    """The m-th stretch of d_sub dimensions."""
    m = F.lit(m) if isinstance(m, int) else m
    return F.slice(v, m * d_sub + 1, d_sub)


def subvectors(v: Column, parts: int, d_sub: int) -> Column:
    """All stretches, in order."""
    return F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda m: subvector(v, m, d_sub))


def adc_table(query: Column, centroids: Column, d_sub: int) -> Column:
    """T[m][k] = distance of the m-th subvector to centroids[m][k]; centroids: an array of arrays of arrays."""
    return F.transform(centroids, lambda row, m: F.transform(row, lambda c: l2_squared(subvector(query, m, d_sub), c)))


def adc_distance(table: Column, code: Column) -> Column:
    """Sum over m of table[m][code[m]]."""
    return F.aggregate(F.zip_with(table, code, lambda row, c: F.get(row, c.cast("int"))), F.lit(0.0), lambda s, x: s + x)


def pad_neighbors(neighbors: Column, own_id: Column, degree: int) -> Column:
    """Exactly ``degree`` ids: the list, cut or filled with the node's own id."""
    cut = F.slice(neighbors, 1, degree)
    return F.concat(cut, F.array_repeat(own_id, F.greatest(F.lit(0), F.lit(degree) - F.size(cut))))


def widen_bytes(v: Column) -> Column:
    """Unsigned bytes, given as integers, as floats."""
    return F.transform(v, lambda x: x.cast("float"))


def register_sql(spark: SparkSession) -> None:
    """``l2_squared`` and ``adc_distance`` for SQL text."""
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION l2_squared(a ARRAY<FLOAT>, b ARRAY<FLOAT>) RETURNS DOUBLE RETURN "
        "aggregate(zip_with(a, b, (x, y) -> (double(x) - double(y)) * (double(x) - double(y))), 0D, (s, x) -> s + x)"
    )
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION adc_distance(t ARRAY<ARRAY<DOUBLE>>, c ARRAY<SMALLINT>) RETURNS DOUBLE RETURN "
        "aggregate(zip_with(t, c, (r, i) -> get(r, int(i))), 0D, (s, x) -> s + x)"
    )
