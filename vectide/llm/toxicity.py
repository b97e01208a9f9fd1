"""Toxicity by multiple-instance learning: labels of documents train scores of sentences.

A sentence is toxic with probability ``sigmoid(w . x + b)``, where x marks its
hashed words and word beginnings. A document is toxic if any sentence is (noisy
or): ``P = 1 - prod(1 - p)``. The gradient of the document's likelihood reaches
the sentences through that product, so the sentences that explain the label get
the weight; the scorer returns them with the document.

Training reads at most ``SAMPLE`` labelled documents of each class, those with
the least hash of the id, of at most ``SAMPLE_BYTES`` together (a text that would
exceed that is passed over, not cut); scoring reads every text whole. Features that stand in
fewer than ``LEAST_DOCS`` sampled documents, or about as often in either class,
weigh nothing.

Defined cases: null and empty texts, and texts without words, have no sentence
and score 0; a null id counts as the empty string in the split; of repeated
labels of an id the larger holds, null labels and labels of unknown ids are
ignored; without labels of either class every score is 0. Repeated rows are
scored one by one. The result has the id and the columns below; no other column
of the documents is read, so names of other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import bytescan as bs
from .scratch import materialise
from .substring_dedup import sentences

U = np.uint64
BUCKET_BITS = 20
PREFIXES = (4, 5)
SAMPLE, SAMPLE_BYTES = 3000, 8 << 20
LEAST_DOCS = 4
#: Features whose shares of toxic and clean documents differ by fewer standard errors weigh nothing.
LEAST_Z = 4.0
ROUNDS = 120
RATE, DECAY = 0.3, 2e-4
THRESHOLD = 0.7
OFFENDING = 0.5


def features(buf: np.ndarray, offs: np.ndarray):
    """(bucket, sentence) pairs without repeats; (starts, ends, row) of the sentences."""
    x, start, end, _ = bs.tokens(buf, offs, bs.ALNUM_LOWER)
    s, e, row = sentences(buf, offs)
    pre = bs.prefix(x)
    sent = np.searchsorted(s, start, "right") - 1
    found = [bs.mix(bs.span_hash(pre, start, end))]
    where = [sent]
    for k in PREFIXES:
        long = end - start >= k
        found.append(bs.mix(bs.span_hash(pre, start[long], start[long] + k) + U(k)))
        where.append(sent[long])
    bucket = (np.concatenate(found) >> U(64 - BUCKET_BITS)).astype(np.int64)
    pair = bs.distinct(np.concatenate(where) << BUCKET_BITS | bucket)
    return pair & ((1 << BUCKET_BITS) - 1), pair >> BUCKET_BITS, (s, e, row)


def noisy_or(z: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """Sum of log(1 - p) of the sentences of each document."""
    return np.bincount(row, weights=-np.logaddexp(0, z), minlength=n)


def fit(bucket: np.ndarray, sent: np.ndarray, doc_of: np.ndarray, y: np.ndarray, stands_for: tuple[float, float] = (1.0, 1.0)) -> tuple[np.ndarray, float]:
    """Weights and bias of maximal likelihood, by Adam over the whole sample.

    stands_for: the labelled documents that one of the sample stands for, clean and toxic.
    """
    n_docs, n_sent = len(y), len(doc_of)
    seen = bs.distinct(bucket * n_docs + doc_of[sent])
    seen, doc = seen // n_docs, seen % n_docs
    toxic, clean = (np.bincount(seen, weights=y[doc] == k, minlength=1 << BUCKET_BITS) for k in (1, 0))
    # score of the difference between two shares, by the pooled share
    n1, n0 = (y == 1).sum(), (y == 0).sum()
    pooled = (toxic + clean) / n_docs
    z = (toxic / n1 - clean / n0) / np.sqrt(np.maximum(pooled * (1 - pooled), 1e-12) * (1 / n1 + 1 / n0))
    used = ((toxic + clean >= LEAST_DOCS) & (np.abs(z) >= LEAST_Z))[bucket]
    names, f = np.unique(bucket[used], return_inverse=True)
    sent = sent[used]
    weight = np.where(y == 1, stands_for[1], stands_for[0])
    weight = weight / weight.mean()
    w, b = np.zeros(len(names)), -4.0
    m, v = np.zeros(len(names) + 1), np.zeros(len(names) + 1)
    for t in range(1, ROUNDS + 1):
        z = np.bincount(sent, weights=w[f], minlength=n_sent) + b
        p = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
        log_none = np.minimum(noisy_or(z, doc_of, n_docs), -1e-9)
        pull = np.where(y == 1, -1 / np.expm1(-log_none), 1.0)  # -(1 - P) / P, or 1
        g = p * (weight * pull)[doc_of] / n_docs
        grad = np.r_[np.bincount(f, weights=g[sent], minlength=len(names)) + DECAY * w / max(1, len(names)) ** 0.5, g.sum()]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        step = RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        w, b = w - step[:-1], b - step[-1]
    full = np.zeros(1 << BUCKET_BITS, np.float32)
    full[names] = w
    return full, float(b)


def split_of(id_col: str, modulus: int = 3, remainder: int = 1):
    """Is the row held out?"""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def train(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample: int) -> tuple[np.ndarray, float] | None:
    """Weights learned from at most ``sample`` labelled documents of each class."""
    marked = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~split_of(id_col)).groupBy(id_col).agg(F.max(label_col).cast("int").alias("y"))
    count = {r.y: r["count"] for r in marked.where(F.col("y").isin(0, 1)).groupBy("y").count().collect()}
    some = None
    for y in (0, 1):
        part = marked.where(F.col("y") == y).orderBy(F.xxhash64(id_col), id_col).limit(sample)
        some = part if some is None else some.unionByName(part)
    # at most 2 * sample rows of a few numbers, here and below: a proven bound
    sized = docs.select(id_col, F.octet_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("size")).join(F.broadcast(materialise(some, "toxic-sample")), id_col)
    sized = sized.groupBy(id_col, "y").agg(F.sum("size").alias("size")).orderBy(F.xxhash64(id_col), id_col).collect()
    taken, chosen = [0, 0], []
    for r in sized:
        if taken[r.y] + r["size"] <= SAMPLE_BYTES:
            taken[r.y] += r["size"]
            chosen.append((r[id_col], r.y))
    # in the loss each class has the share that it has among all training labels
    stands_for = tuple(max(1.0, count.get(y, 0) / max(1, sum(c == y for _, c in chosen))) for y in (0, 1))
    chosen = docs.sparkSession.createDataFrame(chosen, T.StructType([docs.schema[id_col], T.StructField("y", T.IntegerType())]))
    texts = docs.select(id_col, text_col).join(F.broadcast(chosen), id_col).select(id_col, text_col, "y")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs = bs.flat(batch.column(1))
            out = []
            for i in range(batch.num_rows):
                piece = buf[offs[i] : offs[i + 1]]
                bucket, sent, _ = features(piece, np.array([0, len(piece)]))
                _, sent = np.unique(sent, return_inverse=True)
                out.append((sent.astype(np.int64) << BUCKET_BITS | bucket).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(2), pa.array(out, pa.binary())], names=["id", "y", "pairs"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        table = pa.Table.from_batches(held) if held else None
        if table is not None and table.num_rows:
            table = table.sort_by([("id", "ascending"), ("pairs", "ascending")])
            y = table.column("y").to_numpy()
            pairs = [np.frombuffer(x, np.int64) for x in table.column("pairs").to_pylist()]
            many = np.array([int(p[-1] >> BUCKET_BITS) + 1 if len(p) else 0 for p in pairs])
            base = np.cumsum(many) - many
            pair = np.concatenate(pairs)
            sent = (pair >> BUCKET_BITS) + np.repeat(base, [len(p) for p in pairs])
            if {0, 1} <= set(y.tolist()) and len(pair):
                w, b = fit(pair & ((1 << BUCKET_BITS) - 1), sent, np.repeat(np.arange(len(y)), many), y, stands_for)
                yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()], pa.binary()), pa.array([b])], names=["w", "b"])

    model = texts.mapInArrow(extract, "id bigint, y int, pairs binary").repartition(1).mapInArrow(learn, "w binary, b double").collect()
    return (np.frombuffer(bytes(model[0].w), np.float32), model[0].b) if model else None


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """Per row: id, held_out, score, predicted, n_sentences, and offending: (start, end, score) in bytes of toxic sentences."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, id_col, text_col, label_col, sample))
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType())])
    rows = docs.select(F.col(id_col), split_of(id_col).alias("held_out"), F.col(text_col).alias("\0text"))
    schema = T.StructType([*rows.schema.fields[:2], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("n_sentences", T.LongType()), T.StructField("offending", T.ArrayType(span))])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs = bs.flat(batch.column(2))
            p, n, bad = [], [], []
            for i, j in bs.slices(offs):
                piece, at = buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
                bucket, sent, (s, e, row) = features(piece, at)
                live = bs.distinct(sent)
                n.append(np.bincount(row[live], minlength=j - i))
                if model.value is None:
                    p.append(np.zeros(j - i))
                    bad += [[]] * (j - i)
                    continue
                w, b = model.value
                z = (np.bincount(sent, weights=w[bucket], minlength=len(s)) + b)[live]
                p.append(-np.expm1(noisy_or(z, row[live], j - i)))
                own = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
                found: list[list[dict]] = [[] for _ in range(j - i)]
                for k in np.flatnonzero(own >= OFFENDING):
                    r = row[live[k]]
                    found[r].append({"start": int(s[live[k]] - at[r]), "end": int(e[live[k]] - at[r]), "score": float(own[k])})
                bad += found
            p = np.clip(np.concatenate(p), 0, 1) if p else np.zeros(0)
            columns = [batch.column(0), batch.column(1), pa.array(p), pa.array((p >= threshold).astype(np.int32)), pa.array(np.concatenate(n) if n else np.zeros(0, np.int64), pa.int64()), pa.array(bad, arrow.field("offending").type)]
            yield pa.RecordBatch.from_arrays([x.cast(t.type) for x, t in zip(columns, arrow)], schema=arrow)
            bs.release()

    return rows.mapInArrow(run, schema)


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The columns of ``op5``, and the number of offending sentences."""
    return score(docs, labels).select("doc_id", "held_out", "score", "predicted", F.size("offending").alias("n_offending"))
