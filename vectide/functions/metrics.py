"""Ratios, percentiles and coercions of the evaluation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0: hit rates, queries per second, speed-ups."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def nearest_rank(value: str, p: float) -> Column:
    """Aggregate: the value at rank ceil(p * n)."""
    return F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {value})")


def floor_rank(n: Column, p: float) -> Column:
    """Rank, from 1, of the percentile by the floor rule: min(floor(p * n), n - 1) + 1."""
    return F.least(F.floor(F.lit(p) * n) + 1, n)


def tolerant_double(text: Column, default: float | None = None) -> Column:
    """Text as double; blank or unreadable text gives ``default``."""
    found = F.nullif(F.trim(text), F.lit("")).try_cast("double")
    return found if default is None else F.coalesce(found, F.lit(float(default)))


def cache_weight(is_metadata: Column, accesses: Column) -> Column:
    """Eviction weight of a cache entry: 1000 x (3 metadata, 2 hot, 1 cold) + accesses up to 999."""
    kind = F.when(is_metadata, 3).when(accesses >= 5, 2).otherwise(1)
    return kind * 1000 + F.least(accesses, F.lit(999))
