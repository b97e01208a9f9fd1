"""A stream of vectors into a store: every micro-batch is one flush.

``foreachBatch`` commits a snapshot a batch. The manifest that publishes a batch's
rows has its number too, so a batch that Spark runs again after a failure is
skipped if, and only if, its rows are in. Readers use the newest published snapshot and never see half a batch.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..operators import graph
from ..operators.store import Store


class StreamWriter:
    """The body of ``foreachBatch``."""

    def __init__(self, store: Store, config: graph.BuildConfig = graph.BuildConfig(), codebook: DataFrame | None = None, flush: int = 0):
        self.store, self.config, self.codebook, self.flush = store, config, codebook, flush
        self.log: list[dict] = []

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        if batch_id <= self.store.last_batch() or batch.isEmpty():
            return
        began = time.time()
        version = self.store.insert(batch, self.flush, self.config, self.codebook, batch=batch_id)
        self.log.append({"batch_id": batch_id, "version": version, "segments": len(self.store.segments(version)), "seconds": time.time() - began})


def ingest_stream(stream: DataFrame, store: Store, checkpoint: str, config: graph.BuildConfig = graph.BuildConfig(), codebook: DataFrame | None = None, flush: int = 0, available_now: bool = True) -> tuple[StreamingQuery, StreamWriter]:
    """Start the query; ``stream`` has vec_id (the order of arrival) and embedding."""
    writer = StreamWriter(store, config, codebook, flush)
    out = stream.select("vec_id", "embedding").writeStream.foreachBatch(writer).option("checkpointLocation", checkpoint)
    out = out.trigger(availableNow=True) if available_now else out.trigger(processingTime="1 second")
    return out.start(), writer


def rate_samples(events: DataFrame, seconds: int = 1, late: str = "10 minutes") -> DataFrame:
    """Events and mean value of each interval of event time; works on streams, with a watermark, and on tables."""
    w = F.window("ts", f"{seconds} seconds")
    source = events.withWatermark("ts", late) if events.isStreaming else events
    return source.groupBy(w.alias("w")).agg(F.count("*").alias("n"), F.avg("value").alias("mean_value")).select(F.col("w.start").alias("at"), "n", (F.col("n") / seconds).alias("rate"), "mean_value")
