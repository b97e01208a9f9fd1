"""Commands on a store: train-pq, build, query, eval, insert, stress; and experiments: sweep, ablation, cache-sweep,
thread-sweep, write-bench.

``threads`` runs that many blocks of queries at once, each a job of its own. ``cache`` above 0 keeps the segments in
Spark's storage (its size is Spark's setting); ``prefetch`` is only reported: Parquet is read ahead by the reader.
Experiments write their rows as CSV to ``output``. ``build --segment`` names a folder that gets the segments as files
of the segment format, too.

Options come from the command line, then ``--config`` (a flat JSON object), then
``--dataset profile`` of ``--catalog``, then the defaults below.
"""

from __future__ import annotations

import argparse
import functools
import random
import threading
import time
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sources
from .operators import evaluate, graph, knn, pq, search
from .operators.store import Store
from .session import ship

_BUILD = {"degree": 32, "builder": "auto", "build-beam": 64, "alpha": 1.2, "max-build-visits": 5000}
_EVAL = {"ks": "1,10,100", "beam": 8, "max-visits": 1000, "limit": 0, "threads": 1, "cache": 0, "prefetch": "off"}
#: (defaults, role of the data set that is the input) of each command.
COMMANDS: dict[str, tuple[dict, str]] = {
    "train-pq": ({"pq-m": 64, "pq-k": 256, "pq-iters": 25, "limit": 100_000}, "learn"),
    "build": ({"output": "data", "segment": "", "limit": 0} | _BUILD, "base"),
    "query": ({"topk": 10, "beam": 8, "max-visits": 1000, "limit": 0, "threads": 1, "cache": 0, "prefetch": "off"}, "query"),
    "eval": (_EVAL | {"format": "table"}, "query"),
    "insert": ({"output": "data", "flush": 0, "limit": 0} | _BUILD, "base"),
    "stress": ({"output": "data_stress", "limit": 0, "cache": 0, "duration": 30, "read-threads": 4, "write-threads": 1, "read-batch-size": 16, "write-batch-size": 100, "write-limit": 0, "beam": 8, "max-visits": 1000} | _BUILD, "query"),
    "sweep": (_EVAL | {"beams": "4,8,16,32", "visits": "500,1000,2000", "limit": 1000, "threads": 4, "output": "sweep.csv"}, "query"),
    "ablation": (_EVAL | {"caches": "0,200", "thread-counts": "1,4", "prefetches": "off,on", "limit": 1000, "output": "ablation.csv"}, "query"),
    "cache-sweep": (_EVAL | {"caches": "0,2,20,80,200", "limit": 1000, "threads": 4, "output": "cache_sweep.csv"}, "query"),
    "thread-sweep": (_EVAL | {"thread-counts": "1,2,4,8,16", "limit": 1000, "output": "thread_sweep.csv"}, "query"),
    "write-bench": ({"flush-sizes": "0,1000,5000", "write-limit": 10_000, "output": "write_bench.csv"} | _BUILD, "base"),
}
KNOWN = ("input", "output", "codebook", "manifest", "groundtruth", "write-input", "config", "dataset", "catalog", "store")


def options(argv: list[str]) -> tuple[str, dict]:
    """(command, its options by precedence); unknown options are an error."""
    names = sorted({*KNOWN, *(k for d, _ in COMMANDS.values() for k in d)})
    parser = argparse.ArgumentParser(prog="vectide", description=__doc__)
    parser.add_argument("command", choices=sorted(COMMANDS))
    for n in names:
        parser.add_argument(f"--{n}")
    given = {k.replace("_", "-"): v for k, v in vars(parser.parse_args(argv)).items()}
    command = given.pop("command")
    defaults, role = COMMANDS[command]
    config = sources.load_config(given["config"]) if given.get("config") else {}
    profile = {}
    if name := given.get("dataset") or config.get("dataset"):
        profile = sources.load_catalog(given.get("catalog") or config["catalog"])[name]
    found = sources.resolve(given, config, profile, role, defaults)
    for k, v in defaults.items():
        if k in found and not isinstance(found[k], type(v)):
            found[k] = type(v)(found[k])
    return command, found


def _build_config(o: dict) -> graph.BuildConfig:
    return graph.BuildConfig(degree=o["degree"], builder=o["builder"], beam=o["build-beam"], alpha=o["alpha"], max_visits=o["max-build-visits"])


def _codebook(spark: SparkSession, o: dict) -> DataFrame | None:
    path = o.get("codebook")
    if not path:
        return None
    return spark.read.parquet(path) if path.endswith(".parquet") else sources.read_codebook(spark, path)


def _queries(spark: SparkSession, o: dict) -> DataFrame:
    return sources.load_vectors(spark, o["input"], o["limit"] if "limit" in o else 0).select(F.col("vec_id").alias("qid"), "embedding")


def _truth(spark: SparkSession, path: str) -> DataFrame:
    rows = sources.load_vectors(spark, path, kind="ivecs" if path.endswith(".ivecs") else None)
    if dict(rows.dtypes).get("embedding", "").startswith("array"):
        return rows.select(F.col("vec_id").alias("qid"), F.posexplode("embedding").alias("pos", "v")).select("qid", (F.col("pos") + 1).alias("rk"), F.col("v").cast("bigint").alias("vec_id"))
    return rows


def run(spark: SparkSession, argv: list[str]) -> DataFrame:
    """Run a command; its report as a DataFrame."""
    ship(spark)
    command, o = options(argv)
    if command == "train-pq":
        book = pq.train(sources.load_vectors(spark, o["input"], o["limit"]), o["pq-m"], o["pq-k"], o["pq-iters"])
        book.write.mode("overwrite").parquet(o["output"]) if o["output"].endswith(".parquet") else sources.write_codebook(book, o["output"])
        return book
    if command == "write-bench":
        return write_bench(spark, o)
    store = Store(spark, o.get("manifest") or o["output"])
    if command == "build":
        book = _codebook(spark, o)
        store.build(sources.load_vectors(spark, o["input"], o["limit"]), _build_config(o), book)
        if o["segment"]:
            sources.write_segments(store.nodes(), o["segment"], book)
        return store.manifest()
    if command == "insert":
        store.insert(sources.load_vectors(spark, o["input"], o["limit"]), o["flush"], _build_config(o), _codebook(spark, o))
        return store.manifest()
    if command == "query":
        hits, _ = search_blocks(spark, store, _queries(spark, o), o, o["topk"])
        return hits
    if command == "stress":
        return stress(spark, store, o)
    if command == "eval":
        return evaluated(spark, store, o)
    return experiment(spark, store, command, o)


def search_blocks(spark: SparkSession, store: Store, q: DataFrame, o: dict, k: int) -> tuple[DataFrame, DataFrame]:
    """(hits, stats) of the queries in ``threads`` blocks that run at once, kept in Spark's storage."""
    config, book = graph.SearchConfig(k, o["beam"], o["max-visits"]), _codebook(spark, o)
    files = store.files().persist() if o["cache"] else store.files()

    def one(b: int) -> tuple[DataFrame, DataFrame]:
        part = q if o["threads"] <= 1 else q.where(F.pmod(F.xxhash64("qid"), F.lit(o["threads"])) == b)
        found = search.search_files(files, part, config, book).persist()
        found.count()
        return search.summaries(found, k)

    with ThreadPoolExecutor(max(1, o["threads"])) as pool:
        blocks = list(pool.map(one, range(max(1, o["threads"]))))
    if o["cache"]:
        files.unpersist()
    return tuple(functools.reduce(DataFrame.unionByName, x) for x in zip(*blocks))


def evaluated(spark: SparkSession, store: Store, o: dict) -> DataFrame:
    """One row: quality, latencies and counters of the queries, and the settings of the run."""
    ks = tuple(int(k) for k in str(o["ks"]).split(","))
    began = time.perf_counter()
    hits, stats = search_blocks(spark, store, _queries(spark, o), o, max(ks))
    settings = {"num_threads": o["threads"], "beam": o["beam"], "max_visits": o["max-visits"], "prefetch": int(o["prefetch"] == "on"), "cache_mb": o["cache"]}
    return evaluate.report(hits, stats, _truth(spark, o["groundtruth"]), time.perf_counter() - began, ks, settings)


_REPORT = ["recall_1", "recall_10", "recall_100", "lat_avg_ms", "lat_p50_ms", "lat_p95_ms", "lat_p99_ms", "qps", "avg_visited", "avg_exact_reads", "avg_pq_dist", "avg_prefetch_hits"]


def experiment(spark: SparkSession, store: Store, command: str, o: dict) -> DataFrame:
    """``eval`` at every point of the command's grid, written as CSV and returned."""
    ints = lambda name: [int(x) for x in str(o[name]).split(",")]
    grids = {
        "sweep": lambda: {"beam": ints("beams"), "max-visits": ints("visits")},
        "ablation": lambda: {"cache": ints("caches"), "threads": ints("thread-counts"), "prefetch": o["prefetches"].split(",")},
        "cache-sweep": lambda: {"cache": ints("caches")},
        "thread-sweep": lambda: {"threads": ints("thread-counts")},
    }
    rows = evaluate.sweep(lambda **point: evaluated(spark, store, o | point), grids[command]())
    for r in rows:
        r["config"] = f"cache{r['cache_mb']}_t{r['num_threads']}" + ("_pf" if r["prefetch"] in (1, "on") else "")
    keys = ["beam", "max_visits", "num_threads", "prefetch", "cache_mb", "num_queries", "seconds", "config"]
    fields = [c for c in _REPORT + keys if c in rows[0]]
    evaluate.write_csv(rows, o["output"], fields)
    return spark.createDataFrame([tuple(r[c] for c in fields) for r in rows], fields)


def write_bench(spark: SparkSession, o: dict) -> DataFrame:
    """Insert the input into a new store for each flush size: segments, merges, seconds and vectors a second, also as CSV."""
    x = sources.load_vectors(spark, o["input"], o["write-limit"]).persist()
    rows = []
    for flush in (int(f) for f in str(o["flush-sizes"]).split(",")):
        store, began = Store(spark, f"{o['store'].rstrip('/')}/flush-{flush or 'all'}-{uuid.uuid4().hex}"), time.perf_counter()
        version = store.insert(x, flush, _build_config(o))
        seconds, n = time.perf_counter() - began, x.count()
        rows.append({"flush": flush, "vectors": n, "segments": len(store.segments()), "compactions": version - 1, "time_s": seconds, "throughput_vec_s": n / seconds})
    x.unpersist()
    evaluate.write_csv(rows, o["output"], list(rows[0]))
    return spark.createDataFrame([tuple(r.values()) for r in rows], "flush long, vectors long, segments long, compactions long, time_s double, throughput_vec_s double")


def stress(spark: SparkSession, store: Store, o: dict) -> DataFrame:
    """Readers search random queries in the newest snapshot while writers insert batches.

    One row a second (kind "interval": reads a second since the last one, percentiles and recall of all reads so far),
    then one of kind "summary".
    """
    q, truth = _queries(spark, o).persist(), _truth(spark, o["groundtruth"]) if o.get("groundtruth") else None
    config, book = graph.SearchConfig(10, o["beam"], o["max-visits"]), _codebook(spark, o)
    new = sources.load_vectors(spark, o["write-input"], o["write-limit"])
    total, size, n_q = new.count(), o["write-batch-size"], q.count()
    lock, publish = threading.Lock(), threading.Lock()
    done, failed, began = threading.Event(), [], time.time()
    latencies, recalls, counts = [], [], {"next": 0, "writes": 0, "visited": 0, "exact_reads": 0}

    snapshot: dict[int, DataFrame] = {}

    def newest() -> DataFrame:
        """The files of the newest snapshot; with a cache, they are kept until the next one."""
        with lock:
            version = store.version()
            if version not in snapshot:
                for old in snapshot.values():
                    old.unpersist()
                snapshot.clear()
                snapshot[version] = store.files(version).persist() if o["cache"] else store.files(version)
            return snapshot[version]

    def write() -> None:
        while not done.is_set():
            with lock:
                first, counts["next"] = counts["next"], counts["next"] + size
            if first >= total:
                return
            part = new.where((F.col("vec_id") >= first) & (F.col("vec_id") < first + size))
            with publish:  # one writer publishes at a time
                store.insert(part, config=_build_config(o), codebook=book)
            with lock:
                counts["writes"] += min(size, total - first)

    def read(seed: int) -> None:
        rng = random.Random(seed)
        while not done.is_set() or not latencies:
            at, wide = rng.randrange(n_q), max(1, o["read-batch-size"])
            some = q.where(F.pmod(F.col("qid") - at, F.lit(n_q)) < wide)
            rows_of = search.search_files(newest(), some, config, book).persist()
            hits, stats = search.summaries(rows_of, config.top_k)
            stats = stats.groupBy("qid").agg(F.sum("latency_ms").alias("ms"), F.sum("visited").alias("v"), F.sum("exact_reads").alias("e")).collect()  # a batch of queries
            found = [r[0] for r in evaluate.recall(hits, truth, (10,), some).select("recall_10").collect()] if truth is not None else []
            rows_of.unpersist()
            with lock:
                latencies.extend(r.ms for r in stats)
                recalls.extend(found)
                counts["visited"] += sum(r.v for r in stats)
                counts["exact_reads"] += sum(r.e for r in stats)

    def guarded(f, *args) -> None:
        try:
            f(*args)
        except Exception as e:  # shown by the main thread
            failed.append(e)
            done.set()

    threads = [threading.Thread(target=guarded, args=(write,)) for _ in range(o["write-threads"])]
    threads += [threading.Thread(target=guarded, args=(read, seed)) for seed in range(max(1, o["read-threads"]))]
    for t in threads:
        t.start()
    rows, seen, last = [], 0, began

    def sample(kind: str, since: float, reads: int) -> tuple:
        with lock:
            lat, rec, writes = sorted(latencies), list(recalls), counts["writes"]
            per = max(1, len(lat))
            totals = (counts["visited"] / per, counts["exact_reads"] / per)
        rank = lambda p: lat[min(int(p * len(lat)), len(lat) - 1)] if lat else 0.0
        now = time.time()
        return kind, now - began, (len(lat) - reads) / max(now - since, 1e-9), rank(0.5), rank(0.95), rank(0.99), writes, sum(rec) / len(rec) if rec else None, len(lat), sum(lat) / per, *totals

    while time.time() < began + o["duration"] and not done.wait(1):
        rows.append(sample("interval", last, seen))
        seen, last = rows[-1][8], time.time()
    done.set()
    for t in threads:
        t.join()
    if failed:
        raise failed[0]
    q.unpersist()
    for files in snapshot.values():
        files.unpersist()
    rows.append(sample("summary", began, 0))
    return spark.createDataFrame(rows, "kind string, time double, read_qps double, p50_ms double, p95_ms double, p99_ms double, write_ops long, recall10 double, reads long, avg_ms double, avg_visited double, avg_exact_reads double")


def exact_truth(spark: SparkSession, base: str, queries: str, k: int = 100) -> DataFrame:
    """Ground truth by exact search of two files."""
    b = sources.load_vectors(spark, base)
    return knn.exact_knn(sources.load_vectors(spark, queries).select(F.col("vec_id").alias("qid"), "embedding"), b, k)


def main(argv: list[str] | None = None) -> None:
    spark = SparkSession.builder.appName("vectide").getOrCreate()
    command, o = options(argv)
    out = run(spark, argv)
    if o.get("format") == "csv":
        print(out.toPandas().to_csv(index=False))
    else:
        out.show(truncate=False)
