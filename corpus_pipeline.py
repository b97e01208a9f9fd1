"""A training corpus from raw documents: five stages, each one of the operators of ``vectide.llm``.

Documents that break the quality rules go, one document of each group of near
copies stays, byte strings that an earlier document has are cut out, documents
with benchmark passages go, and the rest is encoded. All but the last stage return
the columns of their documents, whatever their names.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectide.llm import bpe_codec, decontaminate, ngram_join, quality_rules, suffix_dedup
from vectide.llm.scratch import discard, keep, passing

#: What the stages read; other columns go through them under names of our own, so that no operator's column meets them.
READ = ("doc_id", "text", "lang", "source")


def _apart(docs: DataFrame):
    """``docs`` with its other columns renamed, and the function that gives a stage's result the columns of ``docs``."""
    names = {c: f"carried_{k}" for k, c in enumerate(docs.columns) if c not in READ}
    return docs.toDF(*[names.get(c, c) for c in docs.columns]), lambda out: out.select(*[F.col(names.get(c, c)).alias(c) for c in docs.columns])


def _stage(f):
    """The stage with its result written: what it wrote on the way is deleted then, and nothing else is."""

    @functools.wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        with passing(spark):
            return keep(f(spark, docs, sf_dir), f"stage-{f.__name__}")

    return run_stage


@_stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that pass the base rules and the adaptive limits."""
    inner, back = _apart(docs)
    return back(quality_rules.quality_rules(inner).where("kept"))


@_stage
def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    return ngram_join.deduplicate(docs)


@_stage
def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of 50 bytes that an earlier document has; n_chars, if there is one, follows the text."""
    inner, back = _apart(docs)
    out = back(suffix_dedup.suffix_dedup(inner))
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


@_stage
def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    inner, back = _apart(docs)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return back(decontaminate.decontaminate(inner, items).where("n_items = 0"))


@_stage
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' ids, sizes and checksums as tokens."""
    found = bpe_codec.encode(docs.select(*READ), with_ids=False)
    return found.select("doc_id", "lang", "source", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_copies),
    ("suffix-array dedup", repeats),
    ("benchmark decontamination", leaks),
    ("BPE encoding", tokens),
]

#: The stages hash, sketch and tokenise in ways that SQL can't express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; each stage's rows are written and read again, and deleted after the next stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        before, docs = docs, stage(spark, docs, sf_dir)
        discard(before)
    return docs
