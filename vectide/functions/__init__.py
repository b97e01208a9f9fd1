"""Column functions."""

from .metrics import cache_weight, floor_rank, nearest_rank, safe_ratio, tolerant_double
from .vectors import adc_distance, adc_table, l2_squared, pad_neighbors, register_sql, subvector, subvectors, widen_bytes

__all__ = [
    "adc_distance",
    "adc_table",
    "cache_weight",
    "floor_rank",
    "l2_squared",
    "nearest_rank",
    "pad_neighbors",
    "register_sql",
    "safe_ratio",
    "subvector",
    "subvectors",
    "tolerant_double",
    "widen_bytes",
]
