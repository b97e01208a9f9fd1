"""Segments on disk, a versioned manifest, ingestion and compaction.

A store is a folder: ``segments/<uuid>`` is one immutable Parquet table of a
segment's nodes; ``manifest/<version>.json`` lists the segments of a snapshot and
the last batch of a stream that is in it. A change writes new segments, then
publishes the next version by giving a finished file its name, which fails if
another writer published that version first: by a hard link on local disks, by a
rename on file systems whose rename refuses an existing name (HDFS and its like).
Object stores without such a rename are not for manifests. Old segments are
deleted only after that, and only by ``vacuum``.

Segments that one merge has made are a run. Levels count runs, so a merge always
leaves fewer of them, however many segments of ``SEGMENT_SIZE`` a run has.
"""

from __future__ import annotations

import json
import math
import uuid
from dataclasses import asdict, dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import check_same_dimension, dimension
from . import graph, search

#: Segments of a level that start a compaction when exceeded.
LEVEL_ZERO, LEVEL_HIGHER = 4, 2
SEGMENT_SIZE = 50_000


@dataclass(frozen=True)
class Segment:
    segment_id: int
    path: str
    id_offset: int
    count: int
    dim: int
    degree: int
    level: int = 0
    has_pq: bool = False
    run: int = -1  # -1: a run of its own

    @property
    def run_id(self) -> int:
        return self.segment_id if self.run < 0 else self.run


def over_threshold(level: str = "level", n: str = "n"):
    """Does a level have too many segments?"""
    return F.col(n) > F.when(F.col(level) == 0, LEVEL_ZERO).otherwise(LEVEL_HIGHER)


def level_counts(manifest: DataFrame) -> DataFrame:
    """level, n: the runs of each level; without a column of runs every segment is one."""
    n = F.count_distinct(F.when(F.col("run") < 0, F.col("segment_id")).otherwise(F.col("run"))) if "run" in manifest.columns else F.count("*")
    return manifest.groupBy("level").agg(n.alias("n"))


def compaction_plan(manifest: DataFrame) -> DataFrame:
    """The segments to merge: those of the lowest level that has too many."""
    due = level_counts(manifest).where(over_threshold()).agg(F.min("level").alias("due_level"))
    return manifest.join(F.broadcast(due), F.col("level") == F.col("due_level")).drop("due_level")


def after_compaction(manifest: DataFrame, merged_id: int) -> DataFrame:
    """The manifest with the planned segments replaced by one of the next level."""
    plan = compaction_plan(manifest)
    rest = manifest.join(plan.select("segment_id"), "segment_id", "left_anti").select("segment_id", "id_offset", "count", "level")
    new = plan.agg(F.lit(merged_id).cast("bigint").alias("segment_id"), F.min("id_offset").alias("id_offset"), F.sum("count").alias("count"), (F.max("level") + 1).cast("int").alias("level"))
    return rest.unionByName(new.where("count IS NOT NULL"))


def next_id(manifest: DataFrame) -> DataFrame:
    return manifest.agg(F.coalesce(F.max(F.col("id_offset") + F.col("count")), F.lit(0)).alias("next_id"))


def assign_segments(vectors: DataFrame, size: int) -> DataFrame:
    """segment_id and local_id of dense ids."""
    return vectors.withColumns({"segment_id": F.expr(f"vec_id div {size}"), "local_id": F.col("vec_id") % size})


def ingest_batches(vectors: DataFrame, flush: int) -> DataFrame:
    """batch of each vector when every ``flush`` vectors are flushed, in id order (0: one batch).

    Ranks are made without one task that sorts all rows: ids are counted in
    ranges first.
    """
    if flush <= 0:
        return vectors.withColumn("batch", F.lit(0).cast("bigint"))
    return dense_rank_ids(vectors, "vec_id").withColumn("batch", F.floor(F.col("row") / flush)).drop("row")


def range_of(value: Column, cuts: list) -> Column:
    """How many of the sorted ``cuts`` are below a value: steps of about the root of their number, then the cuts of one step."""
    if not cuts:
        return F.lit(0)
    step = math.isqrt(len(cuts) - 1) + 1
    below = lambda some: F.size(F.filter(some, lambda c: c < value))
    whole = below(F.lit(cuts[step - 1 :: step])) * step
    return (whole + below(F.slice(F.lit(cuts), whole + 1, step))).cast("int")


def dense_rank_ids(df: DataFrame, by: str) -> DataFrame:
    """``row``: 0, 1, 2, ... in the order of ``by``, nulls last; one window a range of values, offsets from their counts.

    The ranges are approximate quantiles, so outliers don't put all rows in one.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) * 4
    cuts = df.agg(F.percentile_approx(by, [i / parts for i in range(1, parts)], 10 * parts)).first()[0]
    cuts = sorted(set(cuts or []))
    ranged = df.withColumn("_range", F.when(F.col(by).isNull(), len(cuts) + 1).otherwise(range_of(F.col(by), cuts)))
    counts = ranged.groupBy("_range").agg(F.count("*").alias("n")).orderBy("_range").collect()  # one row a range
    total, offsets = 0, []
    for r in counts:
        offsets.append((r._range, total))
        total += r.n
    at = df.sparkSession.createDataFrame(offsets, "_range int, _offset bigint")
    inner = F.row_number().over(Window.partitionBy("_range").orderBy(F.asc_nulls_last(by))) - 1
    return ranged.withColumn("row", inner).join(F.broadcast(at), "_range").withColumn("row", (F.col("row") + F.col("_offset")).cast("bigint")).drop("_range", "_offset")


class Store:
    """A folder of segments and manifests, on any file system that Spark writes."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    # manifest

    def version(self) -> int:
        folder = self._path(f"{self.path}/manifest")
        if not self._fs.exists(folder):
            return 0
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return max([0, *(int(n[:-5]) for n in names if n.endswith(".json"))])

    def _read(self, version: int | None) -> dict:
        version = self.version() if version is None else version
        if not version:
            return {"segments": [], "batch": -1}
        return json.loads("\n".join(r.value for r in self.spark.read.text(f"{self.path}/manifest/{version:08d}.json").collect()))

    def segments(self, version: int | None = None) -> list[Segment]:
        return [Segment(**x) for x in self._read(version)["segments"]]

    def last_batch(self, version: int | None = None) -> int:
        """The number of the last batch of a stream in the snapshot; -1 without one."""
        return self._read(version)["batch"]

    def manifest(self, version: int | None = None) -> DataFrame:
        rows = [tuple(asdict(s).values()) for s in self.segments(version)]
        return self.spark.createDataFrame(rows, "segment_id bigint, path string, id_offset bigint, count bigint, dim int, degree int, level int, has_pq boolean, run bigint")

    def commit(self, segments: list[Segment], base: int, batch: int | None = None) -> int:
        """Publish the version after ``base``, with the rows up to ``batch`` of a stream; fails if it exists."""
        batch = self.last_batch(base) if batch is None else batch
        done = self._path(f"{self.path}/manifest/{base + 1:08d}.json")
        held = self._path(f"{self.path}/manifest/.{uuid.uuid4().hex}.tmp")
        out = self._fs.create(held, False)
        out.write(bytearray(json.dumps({"segments": [asdict(s) for s in segments], "batch": batch}, indent=1).encode()))
        out.close()
        if not self._publish(held, done):
            self._fs.delete(held, False)
            raise RuntimeError(f"version {base + 1} was published by another writer")
        return base + 1

    def _publish(self, held, done) -> bool:
        if self._fs.getScheme() != "file":
            return not self._fs.exists(done) and self._fs.rename(held, done)
        jvm = self.spark.sparkContext._jvm
        try:  # a second link of the same name is refused by the file system
            jvm.java.nio.file.Files.createLink(*(jvm.java.io.File(p.toUri().getPath()).toPath() for p in (done, held)))
        except Py4JJavaError:
            return False
        self._fs.delete(held, False)
        return True

    # data

    def nodes(self, version: int | None = None) -> DataFrame:
        """All nodes of a snapshot, with the manifest's segment ids."""
        segments = self.segments(version)
        if not segments:
            raise ValueError("the store is empty")
        return self.spark.read.parquet(*[s.path for s in segments])

    def files(self, version: int | None = None) -> DataFrame:
        """The snapshot's segments as files, one row (``content``) each, which no task splits."""
        segments = self.segments(version)
        if not segments:
            raise ValueError("the store is empty")
        return self.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load([s.path for s in segments]).select("content")

    def vectors(self, version: int | None = None) -> DataFrame:
        return self.nodes(version).select("vec_id", "embedding")

    def next_id(self) -> int:
        return max([0, *(s.id_offset + s.count for s in self.segments())])

    def node(self, segment_id: int, local_id: int, version: int | None = None) -> DataFrame:
        """The node of a segment by its local id: no row if the segment has no such node; only its table is read."""
        found = [s for s in self.segments(version) if s.segment_id == segment_id]
        if not found:
            raise ValueError(f"the snapshot has no segment {segment_id}")
        return self.spark.read.parquet(found[0].path).where(F.col("local_id") == local_id)

    def _write(self, vectors: DataFrame, config: graph.BuildConfig, codebook: DataFrame | None, level: int, first_segment: int, one_run: bool = False) -> list[Segment]:
        """Write (segment_id, vec_id, embedding) as segments, numbered from ``first_segment``: a folder of the table each."""
        dim = dimension(vectors)
        path = f"{self.path}/segments/{uuid.uuid4().hex}"
        nodes = search.build_nodes(vectors.withColumn("segment_id", F.col("segment_id") + first_segment), config, codebook)
        nodes.withColumn("part", F.col("segment_id")).write.option("maxRecordsPerFile", 0).partitionBy("part").parquet(path)  # a file a segment
        found = self.spark.read.parquet(path).groupBy("segment_id").agg(F.min("vec_id").alias("lo"), F.count("*").alias("n")).orderBy("segment_id").collect()
        return [Segment(int(r.segment_id), f"{path}/part={r.segment_id}", int(r.lo), int(r.n), dim, config.degree, level, codebook is not None, first_segment if one_run else -1) for r in found]

    def build(self, vectors: DataFrame, config: graph.BuildConfig = graph.BuildConfig(), codebook: DataFrame | None = None, size: int = SEGMENT_SIZE) -> int:
        """A first snapshot from vectors with dense ids."""
        base = self.version()
        if self.segments(base):
            raise ValueError("the store has segments; use insert")
        rows = assign_segments(vectors.select("vec_id", "embedding"), size).drop("local_id")
        return self.commit(self._write(rows, config, codebook, 0, 0), base)

    def insert(self, vectors: DataFrame, flush: int = 0, config: graph.BuildConfig = graph.BuildConfig(), codebook: DataFrame | None = None, compact: bool = True, order: str = "vec_id", batch: int | None = None) -> int:
        """Append vectors with new ids, one level-0 segment for each ``flush`` of them; then compact.

        batch: the number of a stream's batch, published with its rows.
        """
        base = self.version()
        old = self.segments(base)
        if old:
            check_same_dimension(dimension(vectors), old[0].dim)
            if any(s.has_pq for s in old) and codebook is None:
                raise ValueError("the store has codes; give its codebook")
        first = self.next_id()
        rows = dense_rank_ids(vectors.select(F.col(order).alias("_by"), "embedding"), "_by")
        rows = rows.select((F.col("row") + first).alias("vec_id"), "embedding", F.floor(F.col("row") / (flush or SEGMENT_SIZE)).alias("segment_id"))
        number = max([-1, *(s.segment_id for s in old)]) + 1
        version = self.commit(old + self._write(rows, config, codebook, 0, number), base, batch)
        return self.compact(config, codebook) if compact else version

    def compact(self, config: graph.BuildConfig = graph.BuildConfig(), codebook: DataFrame | None = None) -> int:
        """Merge the lowest level that has too many segments, again and again."""
        while True:
            base = self.version()
            old = self.segments(base)
            many = {lv: [s for s in old if s.level == lv] for lv in sorted({s.level for s in old})}
            due = next((v for lv, v in many.items() if len({s.run_id for s in v}) > (LEVEL_HIGHER if lv else LEVEL_ZERO)), None)
            if due is None:
                return base
            number = max(s.segment_id for s in old) + 1
            rows = dense_rank_ids(self.spark.read.parquet(*[s.path for s in due]).select("vec_id", "embedding"), "vec_id")
            rows = rows.select("vec_id", "embedding", F.floor(F.col("row") / SEGMENT_SIZE).alias("segment_id"))
            new = self._write(rows, config, codebook if any(s.has_pq for s in due) else None, due[0].level + 1, number, True)
            gone = {s.segment_id for s in due}
            self.commit([s for s in old if s.segment_id not in gone] + new, base)

    def vacuum(self) -> int:
        """Delete segments that the newest snapshot doesn't name; their number."""
        used = {"/".join(s.path.rsplit("/", 2)[1:]) for s in self.segments()}
        folder = self._path(f"{self.path}/segments")
        gone = 0
        for table in self._fs.listStatus(folder) if self._fs.exists(folder) else []:
            parts = [p.getPath() for p in self._fs.listStatus(table.getPath()) if p.isDirectory()]
            left = [p for p in parts if f"{table.getPath().getName()}/{p.getName()}" in used]
            for p in [table.getPath()] if not left else [p for p in parts if p not in left]:
                self._fs.delete(p, True)
            gone += len(parts) - len(left)
        return gone

    def search(self, queries: DataFrame, config: graph.SearchConfig = graph.SearchConfig(), codebook: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        """(hits, stats); each is a search of its own, and only stats need the walks that find nothing."""
        _, stats = search.summaries(search.search_files(self.files(), queries, config, codebook), config.top_k)
        return search.hits_of_files(self.files(), self.vectors(), queries, config, codebook), stats
