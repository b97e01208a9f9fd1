"""Quality by importance resampling of hashed n-gram models.

Two generative models of hashed words and word pairs are counted: one over the
target texts, those labelled good, and one over all texts. A text's log weight
is the sum over its n-grams of the logarithm of the ratio of their
probabilities. Gumbel top-k draws the sample: the k texts with the largest log
weight plus Gumbel noise, which is a draw without replacement in proportion to
the weights. The noise comes from a hash of the id and the text, so a rerun draws
the same sample. By default k is the share of good labels times the number of
texts.

The threshold is found exactly by counting keys in ever finer bins; no task sorts
all keys.

Defined cases: null and empty texts have weight 0 (log); rows with the same id
and text have the same key, and of rows that tie with the threshold so many are
drawn that the sample has k; of repeated labels of an id the larger holds, null
labels are ignored; without good labels both models are the same; an empty table
gives an empty result. The result has the id and the columns below; no other
column is read, so names of other columns don't matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytescan as bs
from .scratch import few, materialise

U = np.uint64
BUCKETS = 1 << 15
SMOOTH = 0.5
SEED = 20240101
BINS = 4096
#: Most ids of labelled texts that are broadcast: 16 MB.
BROADCAST_IDS = 1 << 21


def ngrams(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, row) of every word and every pair of neighbouring words."""
    h, _, _, row = bs.token_hashes(buf, offs, bs.WORDS_LOWER)
    pair = row[1:] == row[:-1]
    two = bs.mix(h[:-1] * U(bs.BASE) + h[1:])[pair] if len(h) else h
    return (np.concatenate([h, two]) % U(BUCKETS)).astype(np.int64), np.concatenate([row, row[1:][pair]])


def counts(texts: DataFrame, text_col: str) -> np.ndarray:
    """Number of n-grams in each bucket, over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            buf, offs = bs.flat(batch.column(0))
            for i, j in bs.slices(offs):
                total += np.bincount(ngrams(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i])[0], minlength=BUCKETS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["bucket", "n"])

    out = np.zeros(BUCKETS, np.int64)
    for r in texts.select(text_col).mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def threshold(keys: DataFrame, k: int) -> float:
    """The k-th largest value of the column ``key``."""
    lo, hi = keys.agg(F.min("key"), F.max("key")).first()
    above = 0  # keys over hi
    while lo < hi:
        width = (hi - lo) / BINS
        if width <= 0 or lo + width == lo:
            break
        bin_of = F.least(F.floor((F.col("key") - lo) / width), F.lit(BINS - 1))
        found = keys.where(F.col("key").between(lo, hi)).groupBy(bin_of.alias("b")).agg(F.count("*").alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi")).collect()
        for r in sorted(found, key=lambda r: -r.b):
            if above + r.n >= k:
                lo, hi = r.lo, r.hi
                break
            above += r.n
        if above + 1 == k:
            return hi
    return lo


def weigh(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, seed: int) -> DataFrame:
    """Per row: id, log_weight, key."""
    good = labels.groupBy(id_col).agg(F.max(label_col).alias("y")).where(F.col("y") == 1).select(id_col)
    # the ids of good labels are sent to all workers while they are few, and joined by shuffle beyond that
    target = counts(docs.select(id_col, text_col).join(few(good, BROADCAST_IDS), id_col, "left_semi"), text_col)
    raw = counts(docs, text_col)
    ratio = np.log((target + SMOOTH) / (target.sum() + SMOOTH * BUCKETS)) - np.log((raw + SMOOTH) / (raw.sum() + SMOOTH * BUCKETS)) if target.sum() else np.zeros(BUCKETS)
    model = docs.sparkSession.sparkContext.broadcast(ratio)
    rows = docs.select(F.col(id_col), F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)).alias("h"), F.col(text_col).alias("t"))
    id_type = rows.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs = bs.flat(batch.column(2))
            out = []
            for i, j in bs.slices(offs):
                bucket, row = ngrams(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                out.append(np.bincount(row, weights=model.value[bucket], minlength=j - i))
            weight = np.concatenate(out) if out else np.zeros(0)
            u = ((batch.column(1).to_numpy().view(U) >> U(11)).astype(float) + 0.5) / (1 << 53)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(weight), pa.array(weight - np.log(-np.log(u)))], names=["id", "log_weight", "key"])
            bs.release()

    return rows.mapInArrow(run, f"id {id_type}, log_weight double, key double")


def resample(docs: DataFrame, labels: DataFrame, share: float | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", seed: int = SEED) -> DataFrame:
    """Per row: id, log_weight, key, selected: is it among the k largest keys?"""
    keys = weigh(docs, labels, id_col, text_col, label_col, seed).withColumn("row", F.monotonically_increasing_id().cast("double"))
    keys = materialise(keys, "weights").withColumnRenamed("id", id_col)
    if share is None:
        share = labels.groupBy(id_col).agg(F.max(label_col).alias("y")).agg(F.avg("y")).first()[0]
        share = 1.0 if share is None else float(share)
    k = math.ceil(share * keys.count())
    if not k:
        return keys.withColumn("selected", F.lit(False)).drop("row")
    least = threshold(keys, k)
    drawn = F.col("key") > least
    ties, over = keys.where(F.col("key") == least), keys.where(drawn).count()
    if ties.count() > k - over:  # the same id and text more than once: as many of them as make k
        tied = F.col("row") >= threshold(ties.select(F.col("row").alias("key")), k - over)
    else:
        tied = F.lit(True)
    return keys.withColumn("selected", drawn | (F.col("key") == least) & tied).drop("row")


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, log_weight, key, selected."""
    return resample(docs.select("doc_id", "text"), labels.select("doc_id", "quality"))
