"""The pipeline against a brute-force version of its stages, and the contracts in SQL."""

import hashlib
import time
import tracemalloc

import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from test_llm import ITEM, SCHEMA, WHITE, contaminated, corpus, jaccard_classes, kept_by_rules  # noqa: E402

from vectide.llm import bpe_codec, ngram_join, scratch  # noqa: E402
from vectide.llm import bytescan as bs  # noqa: E402


def rows_of():
    """The fixture's rows with ids, long enough to pass the rules."""
    return [r for r in corpus(3) if r[0] is not None]


def one_of_each(rows):
    seen, out = set(), []
    for (i, c, _), r in zip(jaccard_classes(rows), rows):
        if i == c and c not in seen:
            seen.add(c)
            out.append(r)
    return out


def without_repeats(rows):
    first = {}
    for r in rows:
        t = r[1].encode()
        for p in range(len(t) - 49):
            first[t[p : p + 50]] = min(first.get(t[p : p + 50], r[0]), r[0])
    out = []
    for r in rows:
        t = r[1].encode()
        mark = bytearray(len(t))
        for p in range(len(t) - 49):
            if first[t[p : p + 50]] < r[0]:
                mark[p : p + 50] = b"\1" * 50
        out.append((r[0], bytes(c for c, m in zip(t, mark) if not m).decode("utf-8", "ignore"), *r[2:]))
    return out


def test_pipeline_brute_force(spark, tmp_path):
    rows = rows_of()
    items = [(1, " ".join(rows[61][1].split()[25:60])), (2, " ".join(rows[12][1].split()[:20]))]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    want = without_repeats(one_of_each([rows[k] for k in sorted(kept_by_rules(rows))]))
    want = [r for r, (_, found) in zip(want, contaminated(want, items)) if not found[2]]
    library = bpe_codec.codec(None).library
    expected = {}
    for r in want:
        ids = library.encode(r[1], add_special_tokens=False).ids
        expected[r[0]] = (r[2], r[3], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(r[1].encode()).hexdigest())
    got = {r.doc_id: tuple(r)[1:] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert len(expected) > 20 and got == expected


def test_stages_keep_the_columns(spark, tmp_path):
    rows = rows_of()
    docs = spark.createDataFrame(rows, SCHEMA)
    spark.createDataFrame([(1, "no such words in there at all my friend")], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.dtypes == docs.dtypes, name
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name


def test_stages_give_back_columns_of_any_name(spark, tmp_path):
    names = ["n_words", "kept", "n_items", "n_bytes", "n_tokens", "vectide_key", "class_id", "_t_lang", "carried_9", "in_kept"]
    rows = [(*r, *(f"{c}-{r[0]}" for c in names)) for r in corpus(3)]
    docs = spark.createDataFrame(rows, SCHEMA + "".join(f", {c} string" for c in names))
    spark.createDataFrame([(1, "no such words in there at all my friend")], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        got = out.collect()
        assert got and all(r[c] == f"{c}-{r.doc_id}" for r in got for c in names), name


def test_results_of_stages_outlive_other_stages(spark, tmp_path):
    docs = spark.createDataFrame(rows_of(), SCHEMA)
    spark.createDataFrame([(1, "no such words in there at all my friend")], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    first = [stage(spark, docs, str(tmp_path)) for _, stage in corpus_pipeline.STAGES]
    second = [stage(spark, docs.limit(20), str(tmp_path)) for _, stage in corpus_pipeline.STAGES]
    counts = [x.count() for x in first]
    assert counts[2] == counts[4] == len(rows_of()) and 0 < counts[1] < counts[3] <= len(rows_of())
    assert all(x.count() <= 20 for x in second)


def test_shuffle_files_go_with_their_write(spark):
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {f for f in (str(x.getPath()) for x in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(disk.getAllFiles())) if "/shuffle_" in f}
    before, was = files(), spark.conf.get(scratch.CLEANUP)
    rows = spark.range(20000).repartition(3).selectExpr("id", "id % 100 AS k")
    out = scratch.materialise(rows.join(rows.groupBy("k").count(), "k").distinct(), "shuffled")
    end = time.time() + 5
    while (left := files() - before) and time.time() < end:
        time.sleep(0.1)
    assert not left and spark.conf.get(scratch.CLEANUP) == was
    assert out.count() == 20000


def test_workers_keep_little_between_operators():
    bs.powers(3 << 20)
    c = bpe_codec.codec(None)
    bs.release("bpe_codec")
    assert len(bs._powers.get("p", ())) <= bs.POWERS and bpe_codec.codec(None) is c
    bs.release()
    assert not bpe_codec._codecs
    h = bs.powers(100)
    assert (h[0] * h[1] == 1).all()


def test_members_of_a_large_group_are_compared_in_slabs():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 20000, 40)) for _ in range(1024)]
    every = np.arange(1024)
    tracemalloc.start()
    got = ngram_join._common(sets, every, every)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert all(got[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(0, 1024, 64) for j in range(1, 1024, 32))
    assert peak < 48 << 20


def test_words_of_the_contracts():
    assert WHITE.findall(b"a\x0bb\x1cc\x00") == [b"a", b"b\x1cc\x00"]
    assert ITEM.findall("a-b9é_c".encode()) == [b"a", b"b9\xc3\xa9", b"c"]
