"""Tables written to the shared folder that the cluster names, to cut lineage.

A lost executor then costs only the tasks that it ran: what earlier steps made
is read again from the shared folder.
"""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; in local mode, where it may be unset, a folder of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="vectide-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


_made: set[str] = set()


def own_dir(spark: SparkSession) -> str:
    """This application's folder in the shared one; it is deleted when the application ends."""
    path = f"{shared_dir(spark)}/vectide-{spark.sparkContext.applicationId}"
    if path not in _made:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        fs = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        fs.mkdirs(at)
        fs.deleteOnExit(at)
        _made.add(path)
    return path


#: Tables of the running ``passing`` blocks.
_held: list[list[str]] = []


@contextlib.contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Deletes, at the end of the block, the tables that ``materialise`` wrote inside it, but not those of ``keep``."""
    _held.append([])
    try:
        yield
    finally:
        for path in _held.pop():
            remove(spark, path)


def keep(df: DataFrame, name: str) -> DataFrame:
    """``materialise`` for the result of a ``passing`` block: the table outlives the block."""
    out = materialise(df, name)
    if _held:
        _held[-1].remove(out._vectide_path)
    return out


def set_aside(docs: DataFrame, added) -> tuple[DataFrame, Callable[[str], str]]:
    """``docs`` with its columns that have the name of an added one renamed, and the names that its columns have now.

    ``in_`` goes before such a name, as often as it takes to be free.
    """
    clash = {a.lower() for a in added}
    taken = clash | {c.lower() for c in docs.columns}
    names = {}
    for c in docs.columns:
        if c.lower() in clash:
            new = c
            while new.lower() in taken:
                new = f"in_{new}"
            taken.add(new.lower())
            names[c] = new
    return docs.withColumnsRenamed(names), lambda c: names.get(c, c)


def few(df: DataFrame, most: int) -> DataFrame:
    """A hint by a count: rows of a few numbers are broadcast up to ``most`` of them, and joined by shuffle beyond."""
    return F.broadcast(df) if df.count() <= most else df.hint("merge")


#: Most keys that ``spread_join`` treats as hot.
HOT_KEYS = 4096


def spread_join(rows: DataFrame, stats: DataFrame, on: str, total: int) -> DataFrame:
    """``rows`` joined with ``stats``, which has one row a key and the number ``n`` of its rows; no key goes to one task.

    Keys with more than a share of 1 / ``HOT_KEYS`` of the ``total`` rows are fewer than ``HOT_KEYS``: they are
    broadcast. The others are joined by shuffle.
    """
    limit = max(64, total // HOT_KEYS)
    hot, cold = stats.where(F.col("n") > limit).drop("n"), stats.where(F.col("n") <= limit).drop("n")
    spread = rows.join(F.broadcast(hot), on)
    rest = rows.join(F.broadcast(hot.select(on)), on, "left_anti").join(cold.hint("merge"), on)
    return spread.unionByName(rest)


#: Spark's setting that deletes the shuffle files of a query as soon as it ends, not when the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back; the shuffle files of the write go when it ends."""
    spark = df.sparkSession
    path = f"{own_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._vectide_path = path
    if _held:
        _held[-1].append(path)
    return out


def discard(df: DataFrame) -> None:
    """Delete a table of ``materialise`` that no later step reads."""
    if path := getattr(df, "_vectide_path", None):
        remove(df.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def parts_of(total: int, part: int) -> int:
    """Number of hash parts of an exchange: one for each ``part`` bytes, by the data alone, so that a part's size doesn't grow."""
    return max(8, -(-total // part))
