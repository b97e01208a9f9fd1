"""Retrieval quality, latencies, sweeps and their summaries, as DataFrame plans."""

from __future__ import annotations

import csv
import itertools
import time

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import floor_rank, safe_ratio

#: True neighbours that count, at most.
DEPTH = 100
#: Ranges of a group's values that are counted before they are sorted.
RANGES = 64


def recall(hits: DataFrame, truth: DataFrame, ks: tuple[int, ...] = (1, 10, 100), queries: DataFrame | None = None) -> DataFrame:
    """qid and recall_k for each k: found among the first k / k; 0 for a query with fewer than k results.

    queries: the qids that were run; truths of others don't count. Without it all queries of ``truth`` were run.
    """
    if max(ks) > DEPTH:
        raise ValueError(f"recall counts at most {DEPTH} true neighbours, not {max(ks)}")
    n = hits.groupBy("qid").agg(F.count("*").alias("n"))
    of = truth.select("qid", "vec_id", F.col("rk").alias("true_rk"))
    both = hits.select("qid", "vec_id", "rk").join(of, ["qid", "vec_id"])
    found = both.groupBy("qid").agg(*[F.count_if((F.col("rk") <= k) & (F.col("true_rk") <= k)).alias(f"c_{k}") for k in ks])
    ran = truth.select("qid").distinct()
    ran = ran if queries is None else ran.join(queries.select("qid").distinct(), "qid")
    rows = ran.join(n, "qid", "left").join(found, "qid", "left")
    return rows.select("qid", *[F.when(F.coalesce("n", F.lit(0)) < k, 0.0).otherwise(F.coalesce(f"c_{k}", F.lit(0)) / k).alias(f"recall_{k}") for k in ks])


def mean_recall(per_query: DataFrame) -> DataFrame:
    return per_query.agg(*[F.avg(c).alias(c) for c in per_query.columns if c.startswith("recall_")])


def _match(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``a`` joined with ``b`` on keys that may be null; the keys of ``a`` stay."""
    b = b.withColumnsRenamed({k: f"_of_{k}" for k in keys})
    on = [a[k].eqNullSafe(b[f"_of_{k}"]) for k in keys]
    return a.join(b, on, how).drop(*[f"_of_{k}" for k in keys])


def _in_ranges(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """``rows`` with ``_range``: which of some ``RANGES`` ranges of its group's values a value lies in; equal values share one."""
    cuts = rows.groupBy(*by).agg(F.array_distinct(F.percentile_approx(value, [i / RANGES for i in range(1, RANGES)], 100 * RANGES)).alias("_cuts"))
    at = F.size(F.filter("_cuts", lambda c: c < F.col(value)))
    return _match(rows, cuts, by).withColumn("_range", at).drop("_cuts")


def _at_ranks(values: DataFrame, column: str, by: list[str], ranks: dict[str, Column]) -> DataFrame:
    """by, and the value at each rank (a function of the group's ``n``); no task sorts a whole group.

    Ranges of values are counted first; only those that hold a rank are sorted, each by itself.
    """
    rows = values.where(F.col(column).isNotNull()).select(*by, F.col(column).alias("_v"))
    rows = _in_ranges(rows, "_v", by)
    own = Window.partitionBy(*by)
    counts = rows.groupBy(*by, "_range").agg(F.count("*").alias("_c"))  # at most RANGES rows a group
    counts = counts.withColumns({"_before": F.sum("_c").over(own.orderBy("_range")) - F.col("_c"), "n": F.sum("_c").over(own)})
    wanted = F.array(*[F.struct(F.lit(name).alias("name"), rank.cast("long").alias("rank")) for name, rank in ranks.items()])
    inside = F.filter(wanted, lambda x: (x["rank"] > F.col("_before")) & (x["rank"] <= F.col("_before") + F.col("_c")))
    picked = counts.select(*by, "_range", F.explode(inside).alias("w"), "_before").select(*by, "_range", "w.name", (F.col("w.rank") - F.col("_before")).alias("_at"))
    picked = picked.groupBy(*by, "_range").agg(F.map_from_entries(F.collect_list(F.struct("name", "_at"))).alias("_at"))
    found = _match(rows, picked, [*by, "_range"]).withColumn("_rn", F.row_number().over(Window.partitionBy(*by, "_range").orderBy("_v")))
    return found.groupBy(*by).agg(*[F.max(F.when(F.col("_rn") == F.col("_at")[name], F.col("_v"))).alias(name) for name in ranks])


def _grouped(values: DataFrame, by: list[str]) -> tuple[DataFrame, list[str]]:
    return (values, by) if by else (values.withColumn("_all", F.lit(0)), ["_all"])


def latency_nearest_rank(values: DataFrame, column: str, by: list[str], ps: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """Count, mean and percentiles at rank ceil(p * n)."""
    values, keys = _grouped(values, by)
    total = values.groupBy(*keys).agg(F.count(column).alias("n"), F.avg(column).alias("mean"))
    names = {f"p{round(p * 100)}": F.greatest(F.ceil(F.lit(p) * F.col("n")), F.lit(1)) for p in ps}
    return _match(total, _at_ranks(values, column, keys, names), keys, "left").select(*by, "n", "mean", *names)


def latency_floor_rank(values: DataFrame, column: str, by: list[str], ps: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """Percentiles at rank min(floor(p * n), n - 1) + 1."""
    values, keys = _grouped(values, by)
    names = {f"p{round(p * 100)}": floor_rank(F.col("n"), p) for p in ps}
    return _at_ranks(values, column, keys, names).select(*by, *names)


def heatmap(runs: DataFrame, row: str, column: str, value: str, columns: list | None = None) -> DataFrame:
    """One row for each value of ``row``, one column for each of ``columns`` (default: all values of ``column``, sorted)."""
    return runs.groupBy(row).pivot(column, columns).agg(F.first(value))


def pareto(runs: DataFrame, cost: str, gain: str, within: list[str] | None = None) -> DataFrame:
    """The runs that no run of at most their cost equals or beats: gain over the largest before.

    Ranges of cost are folded to their largest gain first, so no task sorts all runs.
    """
    rows, keys = _grouped(runs, within or [])
    rows = _in_ranges(rows, cost, keys)
    folded = rows.groupBy(*keys, "_range").agg(F.max(gain).alias("_top"))  # at most RANGES rows a group
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    folded = folded.withColumn("_earlier", F.max("_top").over(earlier)).drop("_top")
    w = Window.partitionBy(*keys, "_range").orderBy(F.col(cost), F.col(gain).desc()).rowsBetween(Window.unboundedPreceding, -1)
    best = _match(rows, folded, [*keys, "_range"]).withColumn("_best", F.greatest(F.max(gain).over(w), "_earlier"))
    return best.where(F.col("_best").isNull() | (F.col(gain) > F.col("_best"))).select(*runs.columns)


def speedup(runs: DataFrame, rate: str, scale: str, order: str, within: list[str]) -> DataFrame:
    """speedup and ideal_speedup against the first run of each series."""
    w = Window.partitionBy(*within).orderBy(order)
    return runs.withColumns({"speedup": safe_ratio(F.col(rate), F.first(rate).over(w)), "ideal_speedup": safe_ratio(F.col(scale), F.first(scale).over(w))})


def interval_rate(samples: DataFrame, total: str, at: str, within: list[str]) -> DataFrame:
    """The increase of a running total since the sample before (from 0 at the first)."""
    w = Window.partitionBy(*within).orderBy(at)
    return samples.withColumn("rate", F.col(total) - F.coalesce(F.lag(total).over(w), F.lit(0)))


def running_peak(samples: DataFrame, value: str, at: str, within: list[str]) -> DataFrame:
    return samples.withColumn("peak", F.max(value).over(Window.partitionBy(*within).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)))


def on_off_ratio(runs: DataFrame, switch: Column, value: str, keys: list[str]) -> DataFrame:
    """value with the switch on, off, and their ratio, for each configuration."""
    both = runs.groupBy(*keys).agg(F.max(F.when(switch, F.col(value))).alias("on_value"), F.max(F.when(~switch, F.col(value))).alias("off_value"))
    return both.where("on_value IS NOT NULL AND off_value IS NOT NULL").withColumn("ratio", safe_ratio(F.col("on_value"), F.col("off_value")))


def report(hits: DataFrame, stats: DataFrame, truth: DataFrame, seconds: float, ks: tuple[int, ...] = (1, 10, 100), settings: dict | None = None) -> DataFrame:
    """One row: recall, latency, rate and counters of a run over the queries that ``stats`` has, and its settings.

    Nothing is fetched ahead of the search, so prefetch_hits are 0.
    """
    stats = stats.withColumn("prefetch_hits", F.lit(0)).withColumnRenamed("pq_distances", "pq_dist")
    counters = ("visited", "pq_dist", "exact_reads", "prefetch_hits")
    per_query = stats.groupBy("qid").agg(*[F.sum(c).alias(c) for c in (*counters, "latency_ms")])
    lat = latency_nearest_rank(per_query, "latency_ms", []).select(F.col("mean").alias("lat_avg_ms"), *[F.col(p).alias(f"lat_{p}_ms") for p in ("p50", "p95", "p99")])
    total = per_query.agg(*[F.sum(c).alias(f"total_{c}") for c in counters], *[F.avg(c).alias(f"avg_{c}") for c in counters], F.count("*").alias("num_queries"))
    total = total.withColumn("qps", safe_ratio(F.col("num_queries"), F.lit(seconds)))
    out = mean_recall(recall(hits, truth, ks, stats)).join(lat).join(total)  # one row each
    return out.withColumns({k: F.lit(v) for k, v in (settings or {}).items()})


def write_csv(rows: list[dict], path: str, fields: list[str]) -> None:
    """The rows' ``fields`` as CSV; what a row lacks is empty, other keys are left out."""
    with open(path, "w", newline="", encoding="utf-8") as f:
        out = csv.DictWriter(f, fields, extrasaction="ignore")
        out.writeheader()
        out.writerows(rows)


def sweep(run, grid: dict[str, list]) -> list[dict]:
    """``run(**point)`` at every point of the grid; each returns a DataFrame of one row, collected with the point and its seconds."""
    out = []
    for point in itertools.product(*grid.values()):
        values = dict(zip(grid, point))
        began = time.perf_counter()
        row = run(**values).first().asDict()
        out.append(values | row | {"seconds": time.perf_counter() - began})
    return out
