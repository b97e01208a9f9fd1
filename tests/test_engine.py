"""The vector engine: pure functions, properties, files, store, stream, commands."""

import json
import struct

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vectide import cli, schema, sources
from vectide.functions import l2_squared, register_sql
from vectide.operators import evaluate, graph, knn, pq, search, store
from vectide.streaming import ingest_stream, rate_samples


def frame(spark, x, first=0):
    return spark.createDataFrame([(first + i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id bigint, embedding array<float>")


def blobs(seed=42, n=20, each=100, d=16):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n, d)) * 5
    return (np.repeat(centres, each, axis=0) + rng.normal(size=(n * each, d))).astype(np.float32).astype(float)


def as_queries(df):
    return df.withColumnRenamed("vec_id", "qid")


# distances and exact search


def test_ties_rank_by_distance_then_id(spark):
    grid = [(x, y) for x in range(5) for y in range(5)]
    df = frame(spark, grid)
    hits = knn.exact_knn(as_queries(df), df, 6).collect()
    by = {}
    for h in hits:
        by.setdefault(h.qid, []).append((h.dist, h.vec_id))
    x = np.array(grid, float)
    for q, found in by.items():
        d = ((x - x[q]) ** 2).sum(1)
        assert found == sorted(zip(d.tolist(), range(25)))[:6]
    sql = {(h.qid, h.rk): h.vec_id for h in knn.exact_knn_sql(as_queries(df), df, 6).collect()}
    assert sql == {(h.qid, h.rk): h.vec_id for h in hits}


def test_exact_knn_in_several_query_blocks(spark, monkeypatch):
    x = np.random.default_rng(0).normal(size=(120, 8))
    df = frame(spark, x)
    whole = sorted(map(tuple, knn.exact_knn(as_queries(df), df, 3).collect()))
    monkeypatch.setattr(knn, "BLOCK_BYTES", 1000)
    assert sorted(map(tuple, knn.exact_knn(as_queries(df), df.repartition(3), 3).collect())) == whole


def test_exact_knn_edges(spark):
    df = frame(spark, np.eye(3))
    assert knn.exact_knn(as_queries(df), df, 0).count() == 0
    assert knn.exact_knn(as_queries(df), df, 9).count() == 9
    assert knn.exact_knn(as_queries(df.limit(0)), df, 2).count() == 0
    assert knn.exact_knn(as_queries(df), df.limit(0), 2).count() == 0


def test_sql_function(spark):
    register_sql(spark)
    r = spark.sql("SELECT l2_squared(array(1f, 2f), array(4f, 6f)) AS d, adc_distance(array(array(1D, 2D), array(3D, 4D)), array(1S, 0S)) AS a").first()
    assert (r.d, r.a) == (25.0, 5.0)


def test_schema_checks(spark):
    df = frame(spark, np.eye(3))
    assert schema.dimension(df) == 3
    for bad in (df.limit(0), df.unionByName(frame(spark, np.eye(2))), df.unionByName(spark.sql("SELECT 9L AS vec_id, CAST(NULL AS array<float>) AS embedding"))):
        with pytest.raises(ValueError):
            schema.dimension(bad)
    for args in ((64, 0, 4), (64, 7, 4), (64, 8, 257), (64, 8, 0)):
        with pytest.raises(ValueError):
            schema.check_pq(*args)


# graphs


@pytest.mark.parametrize("n", [1, 2, 8, 9])
def test_padding_of_tiny_graphs(spark, n):
    df = frame(spark, np.arange(n * 2).reshape(n, 2))
    for g in (knn.knn_graph(df, 8), knn.knn_graph(df.withColumn("s", F.lit(0)), 8, "s")):
        for r in g.collect():
            assert len(r.neighbors) == 8
            real = [v for v in r.neighbors if v != r.vec_id]
            assert len(real) == min(8, n - 1) and r.neighbors[len(real) :] == [r.vec_id] * (8 - len(real))


def test_robust_prune_rules():
    x = np.array([[0.0], [1.0], [2.0], [-3.0]])
    assert graph.robust_prune(x, 0, [0, 1, 2, 3], 8, 1.0) == [1, 3]
    assert graph.robust_prune(x, 0, [3, 2, 1, 1], 1, 1.0) == [1]
    assert graph.robust_prune(x, 0, [0], 8, 1.0) == []
    assert len(graph.robust_prune(x, 0, [1, 2, 3], 8, 0.1)) >= len(graph.robust_prune(x, 0, [1, 2, 3], 8, 10.0))
    assert len(graph.robust_prune(x, 0, [1, 2, 3], 8, 10.0, "standard")) >= len(graph.robust_prune(x, 0, [1, 2, 3], 8, 1.0, "standard"))


def test_beam_search_by_hand():
    x = np.array([[0.0], [1.0], [2.0], [3.0], [4.0], [9.0]])
    line = np.array([[1, 0], [0, 2], [1, 3], [2, 4], [3, 3], [5, 5]])
    rows, dist, visited, n_pq = graph.beam_search(x, line, 0, np.array([4.0]), graph.SearchConfig(2, 0, 100))
    assert rows.tolist() == [4, 3] and dist.tolist() == [0.0, 1.0] and visited == 5 and n_pq == 0
    assert graph.beam_search(x, line, 0, np.array([4.0]), graph.SearchConfig(2, 0, 0))[2] == 0
    assert graph.beam_search(x, line, 0, np.array([4.0]), graph.SearchConfig(2, 0, 1))[0].tolist() == [0]
    assert graph.beam_search(x, line, 5, np.array([4.0]), graph.SearchConfig(3, 8, 100))[0].tolist() == [5]
    twice = np.array([[1, 1], [2, 2], [3, 3], [4, 4], [4, 4], [5, 5]])
    for dedupe in (True, False):
        assert graph.beam_search(x, twice, 0, np.array([4.0]), graph.SearchConfig(1, 1, 100, dedupe))[0].tolist() == [4]
    out = np.array([[1, 99], [0, -1], [1, 3], [2, 4], [3, 3], [5, 5]])
    assert graph.beam_search(x, out, 0, np.array([1.0]), graph.SearchConfig(2, 4, 10))[0].tolist() == [1, 0]


def test_unlimited_beam_on_a_connected_graph_is_exact():
    x = np.random.default_rng(3).normal(size=(60, 6))
    n, entry = graph.build(x, graph.BuildConfig(degree=59, builder="brute"))
    for q in x[:5] + 0.1:
        want = np.lexsort((np.arange(60), ((x - q) ** 2).sum(1)))[:7]
        assert graph.beam_search(x, n, entry, q, graph.SearchConfig(7, 0, 60))[0].tolist() == want.tolist()


def test_build_refuses_bad_input():
    for c in (graph.BuildConfig(builder="other"), graph.BuildConfig(degree=0)):
        with pytest.raises(ValueError):
            graph.build(np.eye(3), c)


@pytest.mark.parametrize("builder", ["brute", "vamana"])
def test_recall_on_clusters(spark, builder):
    x = blobs(n=8, each=50)
    df = frame(spark, x)
    q = as_queries(df.where("vec_id % 20 = 0"))
    config = graph.BuildConfig(degree=24, builder=builder, beam=32, max_visits=200, prune="standard")
    nodes = search.build_nodes(store.assign_segments(df, 200), config).persist()
    assert nodes.where(F.size("neighbors") != 24).count() == 0
    hits, stats = search.ann_search(nodes, q, graph.SearchConfig(10, 64, 400))
    recall = evaluate.mean_recall(evaluate.recall(hits, knn.exact_knn(q, df, 10), (1, 10))).first()
    assert recall.recall_1 >= (0.8 if builder == "vamana" else 0.1)
    assert recall.recall_10 >= (0.8 if builder == "vamana" else 0.1)
    r = stats.agg(F.max("visited"), F.count("*"), F.sum("pq_distances")).first()
    assert r[0] <= 200 and r[1] == 20 * 2 and r[2] == 0
    nodes.unpersist()


def test_search_refuses_other_dimensions(spark):
    nodes = search.build_nodes(store.assign_segments(frame(spark, np.eye(4)), 10), graph.BuildConfig(degree=2))
    with pytest.raises(Exception, match="dimensions differ"):
        search.ann_search(nodes, as_queries(frame(spark, np.eye(3))))[0].count()


# product quantisation


def test_codes_and_distances(spark):
    x = blobs(n=4, each=30, d=8)
    df = frame(spark, x)
    book = pq.train(df, 4, 16, 4)
    codes = pq.encode(df, book)
    q = as_queries(df.where("vec_id < 3"))
    decoded = pq.decode(codes, book)
    direct = decoded.join(q.withColumnRenamed("embedding", "query")).select("qid", "vec_id", l2_squared(F.col("query"), F.col("decoded")).alias("d"))
    want = {(r.qid, r.vec_id): r.d for r in direct.collect()}
    for h in pq.adc_search(q, codes, book, 10).collect():
        assert abs(want[(h.qid, h.vec_id)] - h.dist) < 1e-9
    exact = {(r.qid, r.rk): r.vec_id for r in knn.exact_knn(q, df, 5).collect()}
    found = pq.rerank(pq.adc_search(q, codes, book, 120), q, df, 5)
    assert {(r.qid, r.rk): r.vec_id for r in found.collect()} == exact


def test_error_falls_with_more_centroids(spark):
    df = frame(spark, blobs(n=6, each=30, d=8))
    errors = []
    for k in (2, 8, 32):
        book = pq.train(df, 2, k, 5)
        one, other = pq.error(df, book), pq.error(df, book, pq.encode(df, book))
        assert sorted(one.collect()) == sorted(other.collect())
        assert "Exchange" not in one._jdf.queryExecution().executedPlan().toString()
        errors.append(one.agg(F.avg("error")).first()[0])
    assert errors == sorted(errors, reverse=True)


def test_ties_take_the_lowest_code_and_empty_clusters_are_filled(spark):
    df = frame(spark, [[0.0, 0.0]] * 4 + [[5.0, 5.0]])
    book = np.zeros((1, 3, 2))
    assert pq.codes_of(np.zeros((2, 2)), book).ravel().tolist() == [0, 0]
    trained = pq.codebook_array(pq.train(df, 1, 3, 3))
    assert {tuple(c) for c in trained[0]} == {(0.0, 0.0), (5.0, 5.0)}


# evaluation


@pytest.mark.parametrize("n", [1, 10, 101])
def test_two_percentile_rules(spark, n):
    v = sorted(np.random.default_rng(n).normal(size=n).tolist())
    df = spark.createDataFrame([(0, x) for x in v], "g int, x double")
    near = evaluate.latency_nearest_rank(df, "x", ["g"]).first()
    floor = evaluate.latency_floor_rank(df, "x", ["g"]).first()
    for p in (0.5, 0.95, 0.99):
        name = f"p{round(p * 100)}"
        assert near[name] == v[int(np.ceil(p * n)) - 1]
        assert floor[name] == v[min(int(p * n), n - 1)]


def test_recall_counts_missing_queries_as_zero(spark):
    truth = spark.createDataFrame([(0, 1, 5), (0, 2, 6), (1, 1, 7), (1, 2, 8)], "qid bigint, rk int, vec_id bigint")
    hits = spark.createDataFrame([(0, 1, 6), (0, 2, 5)], "qid bigint, rk int, vec_id bigint")
    got = {r.qid: (r.recall_1, r.recall_2) for r in evaluate.recall(hits, truth, (1, 2)).collect()}
    assert got == {0: (0.0, 1.0), 1: (0.0, 0.0)}


def test_recall_of_the_queries_that_ran(spark):
    truth = spark.createDataFrame([(q, r, 10 * q + r) for q in range(10) for r in (1, 2)], "qid bigint, rk int, vec_id bigint")
    hits = truth.where("qid = 3")
    ran = spark.createDataFrame([(3,), (77,)], "qid bigint")
    assert evaluate.mean_recall(evaluate.recall(hits, truth, (1, 2), ran)).first() == (1.0, 1.0)
    assert evaluate.mean_recall(evaluate.recall(hits, truth, (1, 2))).first() == (0.1, 0.1)
    with pytest.raises(ValueError):
        evaluate.recall(hits, truth, (200,))


def test_frontier_and_percentiles_with_null_groups_and_ties(spark):
    rng = np.random.default_rng(0)
    rows = [(None if i % 3 else "g", float(rng.integers(0, 40)), int(rng.integers(0, 60))) for i in range(900)]
    df = spark.createDataFrame(rows, "g string, cost double, gain int").repartition(4)
    for g in (None, "g"):
        own = [r for r in rows if r[0] == g]
        want = sorted((c, x) for _, c, x in own if not any(d < c and y >= x or d == c and y > x for _, d, y in own))
        got = sorted((r.cost, r.gain) for r in evaluate.pareto(df, "cost", "gain", ["g"]).collect() if r.g == g)
        assert sorted(set(got)) == sorted(set(want))
        v = sorted(c for _, c, _ in own)
        near = next(r for r in evaluate.latency_nearest_rank(df, "cost", ["g"]).collect() if r.g == g)
        assert (near.n, near.p50, near.p99) == (len(v), v[int(np.ceil(0.5 * len(v))) - 1], v[int(np.ceil(0.99 * len(v))) - 1])
    assert evaluate.latency_floor_rank(df, "cost", []).first().p50 == sorted(r[1] for r in rows)[450]


def test_exact_search_in_tiles_and_cells(spark, monkeypatch):
    x = np.random.default_rng(2).integers(0, 4, (150, 3)).astype(float)  # many ties
    q, ids = x[:40], np.arange(150)
    whole = knn.nearest(q, x, ids, 7, ids[:40])
    df = frame(spark, x)
    graph_rows = sorted(map(tuple, knn.knn_edges(df, 5).collect()))
    monkeypatch.setattr(knn, "TILE", 64)
    assert all(np.array_equal(a, b) for a, b in zip(whole, knn.nearest(q, x, ids, 7, ids[:40])))
    monkeypatch.setattr(knn, "BLOCK_BYTES", 100)
    monkeypatch.setattr(knn, "CELL_BYTES", 1000)
    assert sorted(map(tuple, knn.knn_edges(df, 5).collect())) == graph_rows
    with pytest.raises(ValueError):
        knn.segment_knn(as_queries(df), df.withColumn("segment_id", F.lit(0)), 2)


def test_exact_search_in_bounded_memory():
    import subprocess
    import sys

    code = """
import resource, numpy as np
from vectide.operators import knn
rng = np.random.default_rng(0)
q, x = rng.normal(size=(65536, 64)), rng.normal(size=(10000, 64))
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
row, ids, dist = knn.nearest(q[:16384], x, np.arange(10000), 10)
assert len(row) == 163840
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=schema.__file__.rpartition("/vectide/")[0])
    assert float(out.stdout.split()[-1]) < 600  # MB


def test_heatmap_axes(spark):
    runs = spark.createDataFrame([("b", 8, 1.0), ("a", 16, 2.0), ("a", 4, 3.0)], "m string, beam int, v double")
    out = evaluate.heatmap(runs, "m", "beam", "v")
    assert out.columns == ["m", "4", "8", "16"]
    assert sorted(map(tuple, out.collect())) == [("a", 3.0, None, 2.0), ("b", None, 1.0, None)]


def test_sweep(spark):
    rows = evaluate.sweep(lambda beam, visits: spark.createDataFrame([(beam * visits,)], "x int"), {"beam": [1, 2], "visits": [3]})
    assert [(r["beam"], r["x"]) for r in rows] == [(1, 3), (2, 6)]


# files


def raw(kind, rows):
    dtype = {"fvecs": "<f4", "bvecs": "u1", "ivecs": "<i4"}[kind]
    return b"".join(struct.pack("<i", len(r)) + np.array(r).astype(dtype).tobytes() for r in rows)


@pytest.mark.parametrize("kind", ["fvecs", "bvecs", "ivecs"])
def test_vector_files(spark, tmp_path, kind):
    rows = [[i, i + 1, 250] for i in range(7)]
    path = tmp_path / f"x.{kind}"
    path.write_bytes(raw(kind, rows))
    got = sources.load_vectors(spark, str(path))
    assert [list(r.embedding) for r in got.orderBy("vec_id").collect()] == rows
    assert sources.load_vectors(spark, str(path), limit=3).count() == 3
    small = spark.read.format("vecs").option("path", str(path)).option("records", "2").load()
    assert small.rdd.getNumPartitions() == 4 and [r.vec_id for r in small.orderBy("vec_id").collect()] == list(range(7))
    path.write_bytes(raw(kind, rows)[:-2])  # a short last record
    assert sources.load_vectors(spark, str(path)).count() == 6
    path.write_bytes(raw(kind, rows[:2]) + struct.pack("<i", 0) + b"\0" * (len(raw(kind, rows[:1])) - 4))  # a dimension below 1
    assert sources.load_vectors(spark, str(path)).count() == 2
    path.write_bytes(raw(kind, rows[:2]) + struct.pack("<i", 2) + b"\0" * (len(raw(kind, rows[:1])) - 4))
    with pytest.raises(Exception, match="dimensions"):
        sources.load_vectors(spark, str(path)).count()
    path.write_bytes(b"")
    with pytest.raises(Exception, match="no records"):
        sources.load_vectors(spark, str(path)).count()


def test_files_round_trip(spark, tmp_path):
    df = frame(spark, np.random.default_rng(1).normal(size=(5, 4)).astype(np.float32))
    sources.write_vectors(df, str(tmp_path / "a.fvecs"))
    assert sources.load_vectors(spark, str(tmp_path / "a.fvecs")).orderBy("vec_id").collect() == df.orderBy("vec_id").collect()
    df.write.parquet(str(tmp_path / "a.parquet"))
    assert sources.load_vectors(spark, str(tmp_path / "a.parquet"), limit=2).count() == 2
    book = pq.first_rows_codebook(df, 2, 3)
    sources.write_codebook(book, str(tmp_path / "b.pcb"))
    assert sorted(sources.read_codebook(spark, str(tmp_path / "b.pcb")).collect()) == sorted(book.collect())
    (tmp_path / "b.pcb").write_bytes(b"VPQC" + struct.pack("<4I", 1, 2, 3, 4))
    with pytest.raises(ValueError):
        sources.read_codebook(spark, str(tmp_path / "b.pcb"))


def test_segment_file(spark, tmp_path):
    head = b"VSG1" + struct.pack("<IIQIIIQ", 2, 2, 2, 1, 1, 12, 4096) + struct.pack("<2I", 2, 1)
    body = b"".join(struct.pack("<2fI", *r) for r in ((1.0, 2.0, 1), (3.0, 4.0, 0)))
    codes = struct.pack("<3I", 2, 1, 1) + struct.pack("<2f", 5, 6) + bytes([0, 7, 3, 0])
    (tmp_path / "s.vsg").write_bytes(head.ljust(4096, b"\0") + body + codes)
    for records in (50_000, 1):
        got = sources.read_segment(spark, str(tmp_path / "s.vsg"), 100, records).orderBy("local_id").collect()
        assert [(r.vec_id, list(r.embedding), list(r.neighbors), list(r.pq_code), r.is_entry) for r in got] == [(100, [1.0, 2.0], [1], [0, 7], False), (101, [3.0, 4.0], [0], [3, 0], True)]
    assert sorted((r.m, r.k, *r.centroid) for r in sources.segment_codebook(spark, str(tmp_path / "s.vsg")).collect()) == [(0, 0, 5.0), (1, 0, 6.0)]
    (tmp_path / "k.vsg").write_bytes((head[:-4] + struct.pack("<I", 9)).ljust(4096, b"\0") + body + codes)
    with pytest.raises(Exception, match="centroids"):
        sources.read_segment(spark, str(tmp_path / "k.vsg")).count()
    (tmp_path / "n.vsg").write_bytes(b"none")
    with pytest.raises(Exception, match="no segment"):
        sources.read_segment(spark, str(tmp_path / "n.vsg")).count()


def test_segments_round_trip(spark, tmp_path):
    df = frame(spark, blobs(n=2, each=15, d=4))
    book = pq.first_rows_codebook(df, 2, 3)
    for own in (book, None):
        nodes = search.build_nodes(store.assign_segments(df, 10), graph.BuildConfig(degree=4), own).persist()
        files = sources.write_segments(nodes, f"file://{tmp_path}/{own is None}", own)
        assert sorted((r.segment_id, r.id_offset, r["count"]) for r in files.collect()) == [(0, 0, 10), (1, 10, 10), (2, 20, 10)]
        for r in files.collect():
            got = sources.read_segment(spark, r.path, r.id_offset, 4).orderBy("local_id").collect()
            assert got == nodes.where(F.col("segment_id") == r.segment_id).drop("segment_id").orderBy("local_id").collect()
            found = sources.segment_codebook(spark, r.path)
            assert found is None if own is None else sorted(found.collect()) == sorted(book.collect())


def test_manifest_file(spark, tmp_path):
    path = tmp_path / "manifest.txt"
    path.write_text("a.vsg|0|1\n\nb.vsg|10\nbroken\n")
    got = sources.read_manifest(spark, str(path))
    assert sorted(map(tuple, got.collect())) == [("a.vsg", 0, 1), ("b.vsg", 10, 0)]
    sources.write_manifest(got, str(path))
    assert path.read_text() == "a.vsg|0|1\nb.vsg|10|0\n"
    path.write_text("\n")
    with pytest.raises(ValueError):
        sources.read_manifest(spark, str(path))


def test_configuration(tmp_path):
    (tmp_path / "c.json").write_text('{"max_visits": 5, "beam": 3, "beam": 4}')
    assert sources.load_config(str(tmp_path / "c.json")) == {"max-visits": 5, "beam": 3}
    (tmp_path / "n.json").write_text('{"a": {"b": 1}}')
    with pytest.raises(ValueError):
        sources.load_config(str(tmp_path / "n.json"))
    (tmp_path / "d.json").write_text(json.dumps({"small.base": "b", "small.query": "q", "small.learn": "l"}))
    profile = sources.load_catalog(str(tmp_path / "d.json"))["small"]
    assert sources.resolve({"beam": None}, {"beam": 3}, profile, "learn", {"beam": 8, "topk": 10})["input"] == "l"
    assert sources.resolve({"beam": 1}, {"beam": 3}, profile, "query", {"beam": 8})["beam"] == 1


# store, stream, commands


def test_store_life(spark, tmp_path):
    x = np.random.default_rng(5).normal(size=(60, 4))
    s = store.Store(spark, f"file://{tmp_path}/s")
    config = graph.BuildConfig(degree=4, builder="brute")
    s.build(frame(spark, x[:20]), config, size=10)
    assert [(a.id_offset, a.count, a.level) for a in s.segments()] == [(0, 10, 0), (10, 10, 0)]
    s.insert(frame(spark, x[20:50]), flush=10, config=config)  # five of level 0: merged
    assert s.next_id() == 50 and [(a.count, a.level) for a in s.segments()] == [(50, 1)]
    s.insert(frame(spark, x[50:]), config=config)
    assert len({a.segment_id for a in s.segments()}) == 2
    got = {r.vec_id: list(r.embedding) for r in s.vectors().collect()}
    assert sorted(got) == list(range(60)) and all(np.allclose(got[i], x[i], atol=1e-6) for i in got)
    assert s.vacuum() > 0 and s.vectors().count() == 60
    q = as_queries(frame(spark, x[:3]))
    hits, _ = s.search(q, graph.SearchConfig(1, 0, 100))
    assert sorted((h.qid, h.vec_id) for h in hits.collect()) == [(0, 0), (1, 1), (2, 2)]
    with pytest.raises(RuntimeError):
        s.commit(s.segments(), s.version() - 1)
    with pytest.raises(ValueError):
        s.insert(frame(spark, np.eye(3)), config=config)
    with pytest.raises(ValueError):
        s.build(frame(spark, x), config)


def test_segments_are_searched_where_they_lie(spark, tmp_path, monkeypatch):
    x = np.random.default_rng(6).normal(size=(90, 4))
    s = store.Store(spark, f"file://{tmp_path}/s")
    s.build(frame(spark, x), graph.BuildConfig(degree=6, builder="brute"), size=20)
    q, config = as_queries(frame(spark, x[:5])), graph.SearchConfig(4, 0, 100)
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    found = search.search_files(s.files(), q, config)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    hits, stats = search.ann_search(s.nodes(), q, config)
    assert rows(search.summaries(found, 4)[0]) == rows(hits)
    assert rows(search.summaries(found, 4)[1].drop("latency_ms")) == rows(stats.drop("latency_ms"))
    monkeypatch.setattr(knn, "BLOCK_BYTES", 64)  # several blocks of queries
    assert rows(search.summaries(search.search_files(s.files(), q, config), 4)[0]) == rows(hits)
    assert search.search_files(s.files(), q.limit(0), config).count() == 0


def test_a_file_with_part_of_a_segment_is_refused(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/s")
    s.build(frame(spark, np.random.default_rng(7).normal(size=(20, 4))), graph.BuildConfig(degree=3, builder="brute"))
    s.nodes().where("local_id >= 5").coalesce(1).write.parquet(f"{tmp_path}/part")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(f"{tmp_path}/part")
    with pytest.raises(Exception, match="a part of segment"):
        search.search_files(files, as_queries(frame(spark, np.eye(4)))).count()


@pytest.mark.parametrize("n", [60, 250])
def test_compaction_of_runs_of_many_segments_ends(spark, tmp_path, monkeypatch, n):
    monkeypatch.setattr(store, "SEGMENT_SIZE", 10)
    x = np.random.default_rng(8).normal(size=(n, 2))
    s = store.Store(spark, f"file://{tmp_path}/s")
    s.insert(frame(spark, x), config=graph.BuildConfig(degree=2, builder="brute"))
    assert {a.level for a in s.segments()} == {1} and len({a.run_id for a in s.segments()}) == 1
    assert sum(a.count for a in s.segments()) == n and max(a.count for a in s.segments()) == 10
    assert sorted(r.vec_id for r in s.vectors().collect()) == list(range(n))
    assert {r.level: r.n for r in store.level_counts(s.manifest()).collect()} == {1: 1}
    r = s.node(s.segments()[1].segment_id, 3).first()
    assert (r.local_id, r.vec_id) == (3, 13) and s.node(s.segments()[0].segment_id, 99).count() == 0
    with pytest.raises(ValueError):
        s.node(10**6, 0)


def test_rows_without_an_id_are_kept_last(spark, tmp_path):
    df = spark.createDataFrame([(5, [1.0]), (None, [2.0]), (10**15, [3.0]), (-4, [4.0]), (None, [5.0])], "vec_id bigint, embedding array<float>")
    got = sorted((r.batch, r.vec_id is None) for r in store.ingest_batches(df, 2).collect())
    assert got == [(0, False), (0, False), (1, False), (1, True), (2, True)]
    s = store.Store(spark, f"file://{tmp_path}/s")
    s.insert(df, config=graph.BuildConfig(degree=1))
    rows = {r.vec_id: r.embedding[0] for r in s.vectors().collect()}
    assert [rows[i] for i in range(3)] == [4.0, 1.0, 3.0] and sorted(rows) == list(range(5))


@pytest.mark.parametrize("cuts", [[], [5], [1, 5, 9], list(range(0, 100, 3)), list(range(1, 60, 7))])
def test_ranges_of_sorted_cuts(spark, cuts):
    got = spark.range(-2, 110).select("id", store.range_of(F.col("id"), cuts).alias("r")).collect()
    assert all(r.r == sum(c < r.id for c in cuts) for r in got)


def test_nodes_of_arrays_marked_not_null(spark):
    df = spark.range(6).select(F.col("id").alias("vec_id"), F.array(F.col("id").cast("float"), F.lit(1.0).cast("float")).alias("embedding"), F.lit(0).alias("segment_id"))
    assert search.build_nodes(df, graph.BuildConfig(degree=2)).count() == 6


def test_two_writers_of_one_version(spark, tmp_path):
    a = store.Store(spark, f"file://{tmp_path}/s")
    a.commit([], 0)
    b = store.Store(spark, f"file://{tmp_path}/s")
    with pytest.raises(RuntimeError):
        b.commit([], 0)
    assert a.commit([], 1, batch=7) == 2 and b.last_batch() == 7 and b.commit([], 2) == 3 and a.last_batch() == 7


def test_stream_ingest_is_idempotent(spark, tmp_path):
    x = np.random.default_rng(6).normal(size=(30, 4))
    for i in range(3):
        frame(spark, x[i * 10 : i * 10 + 10], i * 10).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = store.Store(spark, f"file://{tmp_path}/s")
    stream = spark.readStream.schema(schema.VECTORS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q, writer = ingest_stream(stream, s, str(tmp_path / "cp"), graph.BuildConfig(degree=4, builder="brute"))
    q.awaitTermination()
    assert len(writer.log) == 3 and s.vectors().count() == 30
    writer(frame(spark, x[:10]), 1)  # a batch that is run again
    assert s.vectors().count() == 30 and s.last_batch() == 2


def test_rates_on_a_stream(spark, tmp_path):
    spark.sql("SELECT timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,0,id) AS ts, double(id) AS value FROM range(10)").write.parquet(str(tmp_path / "ev"))
    stream = spark.readStream.schema("ts timestamp, value double").parquet(str(tmp_path / "ev"))
    q = rate_samples(stream, 5).writeStream.outputMode("complete").format("memory").queryName("rates").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r.n for r in spark.sql("SELECT * FROM rates ORDER BY at").collect()] == [5, 5]


def test_commands(spark, tmp_path):
    x = blobs(n=4, each=20, d=8)
    for name, part in (("base", x), ("query", x[::10]), ("more", x[:15] + 100)):
        sources.write_vectors(frame(spark, part), str(tmp_path / f"{name}.fvecs"))
    at = {k: str(tmp_path / k) for k in ("base.fvecs", "query.fvecs", "more.fvecs", "book.pcb", "gt.ivecs")}
    truth = cli.exact_truth(spark, at["base.fvecs"], at["query.fvecs"], 10)
    rows = truth.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rk", "vec_id"))), lambda r: r["vec_id"].cast("int")).alias("embedding"))
    sources.write_vectors(rows.withColumnRenamed("qid", "vec_id"), at["gt.ivecs"], "ivecs")
    home = f"file://{tmp_path}/store"
    assert cli.run(spark, ["train-pq", "--input", at["base.fvecs"], "--output", at["book.pcb"], "--pq-m", "4", "--pq-k", "8", "--pq-iters", "2"]).count() == 32
    assert cli.run(spark, ["build", "--input", at["base.fvecs"], "--output", home, "--degree", "79", "--codebook", at["book.pcb"], "--segment", str(tmp_path / "vsg")]).count() == 1
    assert sources.read_segment(spark, str(tmp_path / "vsg" / "segment_0.vsg")).count() == 80
    assert cli.run(spark, ["query", "--manifest", home, "--input", at["query.fvecs"], "--topk", "3"]).count() == 24
    report = cli.run(spark, ["eval", "--manifest", home, "--input", at["query.fvecs"], "--groundtruth", at["gt.ivecs"], "--ks", "1,10", "--beam", "0", "--threads", "2"]).first()
    assert (report.num_threads, report.beam, report.total_prefetch_hits, report.cache_mb) == (2, 0, 0, 0)
    assert report.recall_1 == report.recall_10 == 1.0 and report.num_queries == 8 and report.qps > 0
    assert cli.run(spark, ["insert", "--manifest", home, "--input", at["more.fvecs"], "--degree", "4", "--codebook", at["book.pcb"], "--flush", "10"]).count() == 3
    stress = ["stress", "--manifest", home, "--input", at["query.fvecs"], "--groundtruth", at["gt.ivecs"], "--write-input", at["more.fvecs"], "--codebook", at["book.pcb"], "--duration", "3", "--read-threads", "2", "--write-threads", "2", "--read-batch-size", "3", "--write-batch-size", "8", "--cache", "1", "--limit", "6"]
    rows = cli.run(spark, stress).collect()
    assert [r.kind for r in rows].count("summary") == 1 and rows[-1].reads > 0 and rows[-1].read_qps > 0 and rows[-1].recall10 is not None
    assert 0 < rows[-1].write_ops <= 15 and all(a.write_ops <= b.write_ops for a, b in zip(rows, rows[1:]))
    evals = ["--manifest", home, "--input", at["query.fvecs"], "--groundtruth", at["gt.ivecs"], "--ks", "1,10", "--limit", "3"]
    csv = str(tmp_path / "out.csv")
    assert cli.run(spark, ["thread-sweep", *evals, "--thread-counts", "1,2", "--output", csv]).count() == 2
    assert cli.run(spark, ["ablation", *evals, "--caches", "0,1", "--thread-counts", "1", "--prefetches", "off", "--output", csv]).count() == 2
    sweep = cli.run(spark, ["sweep", *evals, "--beams", "0", "--visits", "5,500", "--threads", "1", "--output", csv])
    assert [(r.beam, r.max_visits, r.num_queries) for r in sweep.collect()] == [(0, 5, 3), (0, 500, 3)]
    with open(csv) as f:
        assert f.readline().startswith("recall_1,recall_10,lat_avg_ms") and len(f.readlines()) == 2
    bench = cli.run(spark, ["write-bench", "--input", at["more.fvecs"], "--store", f"file://{tmp_path}/wb", "--flush-sizes", "0,2", "--degree", "2", "--output", csv]).collect()
    assert [(r.flush, r.vectors, r.segments, r.compactions) for r in bench] == [(0, 15, 1, 0), (2, 15, 1, 1)]
    with pytest.raises(SystemExit):
        cli.options(["query", "--nonsense", "1"])


def test_entry_contract(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() == 100


# search by bounds


def test_hits_by_bounds_are_those_of_all_walks(spark, monkeypatch):
    x = np.round(np.random.default_rng(8).normal(size=(240, 4)), 1)  # ties
    df = frame(spark, x)
    q = as_queries(df.where("vec_id % 7 = 0"))
    book = pq.first_rows_codebook(df, 2, 16)
    nodes = search.build_nodes(store.assign_segments(df, 30), graph.BuildConfig(degree=3, builder="vamana", beam=4, max_visits=8), book).persist()
    rows = lambda df: sorted(map(tuple, df.select("qid", "rk", "vec_id", "dist").collect()))
    walks, whole = [], graph.beam_search
    for visits, codes in ((2, None), (30, None), (12, book)):  # 2 visits: most walks miss the nearest
        config = graph.SearchConfig(6, 3, visits)
        sent = (*next(knn.query_blocks(q, "qid", "embedding")), None if codes is None else pq.codebook_array(codes), config)

        def walk(table):
            return search._search_segment(table, *sent)  # noqa: B023

        per_segment = nodes.groupBy("segment_id").applyInArrow(walk, search._FOUND)
        assert rows(search.ann_search(nodes, q, config, codes)[0]) == rows(search.summaries(per_segment, 6)[0])
    nodes.unpersist()
    # a segment with nothing within the bound is not walked at all
    monkeypatch.setattr(graph, "beam_search", lambda *a: walks.append(a) or whole(*a))
    t = search.build_nodes(store.assign_segments(df, 240), graph.BuildConfig(degree=239)).toArrow()
    x = knn.matrix(t.column("embedding"))  # as floats
    near = ((x[:, None] - x[None]) ** 2).sum(-1)
    found = search._hits_within(t, np.arange(20), x[:20] + 50, None, np.full(20, 1.0), graph.SearchConfig(5, 0, 240))
    assert not walks and found.num_rows == 0
    found = search._hits_within(t, np.arange(20), x[:20], None, np.sort(near[:20], 1)[:, 4], graph.SearchConfig(5, 0, 240))
    assert len(walks) == 20 and found.num_rows == 100


@pytest.mark.parametrize("prune", ["sparse", "standard"])
def test_graphs_from_a_table_of_distances_are_the_same(monkeypatch, prune):
    x = np.random.default_rng(9).normal(size=(120, 8))
    x[40:45] = x[3]
    config = graph.BuildConfig(degree=6, builder="vamana", beam=12, max_visits=40, prune=prune)
    fast, search_config = graph.build(x, config), graph.SearchConfig(5, 10, 60)
    hits = [graph.beam_search(x, *fast, q, search_config) for q in x[:9] + 0.1]
    monkeypatch.setattr(graph, "WHOLE", 0)
    slow = graph.build(x, config)
    assert np.array_equal(fast[0], slow[0]) and fast[1] == slow[1]
    for a, q in zip(hits, x[:9] + 0.1):
        b = graph.beam_search(x, *fast, q, search_config)
        assert np.array_equal(a[0], b[0]) and np.array_equal(a[1], b[1]) and a[2:] == b[2:]


def test_segments_are_merged_in_the_task(spark, monkeypatch):
    x = np.random.default_rng(10).integers(0, 4, (200, 3)).astype(float)  # many ties
    df = frame(spark, x).coalesce(1)
    q, segments = as_queries(df.where("vec_id % 9 = 0")), df.withColumn("segment_id", F.expr("vec_id % 50"))
    rows = lambda df: sorted(map(tuple, df.select("qid", "rk", "vec_id", "dist").collect()))
    want = rows(knn.exact_knn(q, df, 4))
    assert rows(knn.merged_segments(q, segments, 4)) == want
    kept = []
    monkeypatch.setattr(knn, "top_k", lambda hits, k: kept.append(hits) or hits.withColumn("rk", F.lit(1)))
    knn.merged_segments(q, segments, 4)
    assert kept[0].count() == 23 * 4  # one task: k a query, not k a query and segment
    monkeypatch.undo()
    each = rows(knn.segment_knn(q, segments, 4))
    monkeypatch.setattr(knn, "HELD_BYTES", 100)  # lists of segments go out before the task's end
    assert rows(knn.segment_knn(q, segments, 4)) == each


def test_many_pairs_are_not_rows(spark, monkeypatch):
    df = frame(spark, np.random.default_rng(11).normal(size=(60, 4)))
    q = as_queries(df.where("vec_id % 3 = 0"))
    rows = lambda df: sorted((r.qid, r.rk, r.vec_id, round(r.dist, 9)) for r in df.collect())
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    few = knn.exact_knn_sql(q, df, 5)
    assert "NestedLoopJoin" in plan(few) or "CartesianProduct" in plan(few)
    monkeypatch.setattr(knn, "SQL_PAIRS", 1000)
    many = knn.exact_knn_sql(q, df, 5)
    assert "NestedLoopJoin" not in plan(many) and "CartesianProduct" not in plan(many)
    assert rows(many) == rows(few)


def test_complete_graphs_are_walked_where_a_hit_can_be(monkeypatch):
    x = np.random.default_rng(12).normal(size=(400, 6)).astype(np.float32).astype(float)
    q, walks, found, whole = x[::20], [], [], graph.beam_search
    dist = np.stack([((x - own) ** 2).sum(-1) for own in q])
    reach = np.sort(dist, 1)[:, 4]
    monkeypatch.setattr(graph, "beam_search", lambda *a: walks.append(a) or whole(*a))
    for s in range(40):
        own = x[s * 10 : s * 10 + 10]
        lists, entry = graph.build(own, graph.BuildConfig(degree=9, builder="brute"))
        t = pa.table({"segment_id": [s] * 10, "local_id": np.arange(10), "vec_id": np.arange(10) + s * 10, "embedding": list(own), "neighbors": list(lists), "is_entry": np.arange(10) == entry})
        found += search._hits_within(t, np.arange(20), q, None, reach, graph.SearchConfig(5, 0, 10)).to_pylist()
    assert len(walks) <= 20 * 5  # of 20 x 40
    assert {(h["qid"], h["vec_id"]) for h in found} == {(i, int(v)) for i in range(20) for v in np.argsort(dist[i])[:5]}
