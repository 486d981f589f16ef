"""Retrieval against plain loops."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rowloom.functions import text, vectors
from rowloom.operators import retrieval


def frames(spark, n_docs, n_queries, dim=8, seed=3):
    r = np.random.default_rng(seed)
    docs = [(i, [float(x) for x in v]) for i, v in enumerate(r.normal(size=(n_docs, dim)))]
    docs += [(n_docs + i, docs[i][1]) for i in range(10)]  # copies tie
    queries = [(f"q{i}", [float(x) for x in v]) for i, v in enumerate(r.normal(size=(n_queries, dim)))]
    d = spark.createDataFrame(docs, "doc_id long, embedding array<double>").repartition(4)
    q = spark.createDataFrame(queries, "query_id string, embedding array<double>")
    want = {}
    for name, v in queries:
        sims = []
        for i, w in docs:
            c = np.dot(v, w) / (np.linalg.norm(v) * np.linalg.norm(w))
            sims.append((-round(min(1.0, max(0.0, c)), 9), i))
        want[name] = [i for _, i in sorted(sims)[:7]]
    return d, q, want


@pytest.mark.parametrize("block,cell,tile", [(65_536, 4096, 4096), (4, 20, 4096), (65_536, 60, 7)])
def test_top_k_is_exact(spark, monkeypatch, block, cell, tile):
    """With one cell, many cells and blocks of queries, and cells in many parts."""
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", block)
    monkeypatch.setattr(retrieval, "CELL_ROWS", cell)
    monkeypatch.setattr(retrieval, "TILE_ROWS", tile)
    docs, queries, want = frames(spark, 300, 11)
    got = {}
    for r in retrieval.top_k(queries, docs, 7).orderBy("query_id", "rn").collect():
        got.setdefault(r.query_id, []).append(r.doc_id)
    assert got == want


def test_cells_out_of_reach_are_skipped(spark):
    """Vectors in narrow bundles: a query visits few cells and still finds what a scan finds."""
    r = np.random.default_rng(5)
    axes = r.normal(size=(12, 16))
    vectors_ = [axes[i % 12] + 0.02 * r.normal(size=16) for i in range(600)]
    docs = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors_)], "doc_id long, embedding array<double>")
    queries = spark.createDataFrame([(i, [float(x) for x in axes[i] * 3]) for i in range(12)], "query_id long, embedding array<double>")
    index = retrieval.vector_index(docs, cell_rows=10)
    asked = queries.select(F.col("query_id").alias("query_key"), F.col("embedding").alias("qv")).withColumn("bar", F.lit(0.99))
    visited = retrieval._probes(asked, index, 5, True).count() + retrieval._probes(asked.drop("bar"), index, 5, False).count()
    assert visited < 12 * len(index.centres) / 3
    a = retrieval.top_k(queries, index, 5).collect()
    b = retrieval.top_k(queries, docs, 5).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b)) and len(a) == 60


def test_opposite_and_zero_vectors(spark):
    """Similarity below 0 counts as 0, and zeros tie by id."""
    docs = spark.createDataFrame([(i, [float(s), 0.0]) for i, s in enumerate([-1, -2, 0, -3, 1])], "doc_id long, embedding array<double>")
    queries = spark.createDataFrame([(1, [2.0, 0.0]), (2, [0.0, 0.0])], "query_id long, embedding array<double>")
    got = retrieval.top_k(queries, retrieval.vector_index(docs, cell_rows=1), 3).orderBy("query_id", "rn").collect()
    assert [(r.query_id, r.doc_id) for r in got] == [(1, 4), (1, 0), (1, 1), (2, 0), (2, 1), (2, 2)]


def test_no_queries(spark):
    docs, queries, _ = frames(spark, 12, 2)
    assert retrieval.top_k(queries.limit(0), docs, 3).count() == 0
    assert retrieval.top_k(queries, docs.limit(0), 3).count() == 0


def test_fusion_does_not_depend_on_row_order(spark):
    rows = [("q", li, w, d, s, n) for li, w in ((0, 0.7), (1, 0.35)) for n, (d, s) in enumerate([(1, 0.9), (2, 0.5), (3, 0.5)], 1)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "query_id string, list_id int, weight double, doc_id long, score double, rn int")
    got = {r.doc_id: r.score for r in retrieval.rrf(df).collect()}
    assert got == {d: round(0.7 / (61 + k) + 0.35 / (61 + k), 9) for k, d in enumerate([1, 2, 3])}


def test_mmr_equals_plain_loop(spark):
    r = random.Random(2)
    words = list("abcdefghij")
    docs = [(i, " ".join(r.choices(words, k=6))) for i in range(30)]
    hits = [("q", i, round(r.random() / 50, 9)) for i in range(30)]
    want, free = [], sorted(hits, key=lambda h: (-h[2], h[1]))
    sets = {i: set(t.split()) for i, t in docs}
    want.append(free.pop(0))
    while len(want) < 12:
        def gain(h):
            over = max(len(sets[h[1]] & sets[c[1]]) / len(sets[h[1]] | sets[c[1]]) for c in want)
            return round(0.75 * h[2] - 0.25 * over, 12)

        best = max(free, key=gain)
        free.remove(best)
        want.append(best)
    df = spark.createDataFrame(hits, "query_id string, doc_id long, score double").withColumn(
        "first_seen", F.struct(F.lit(0).alias("list_id"), F.col("doc_id").cast("int").alias("rank"))
    )
    got = retrieval.mmr(df, spark.createDataFrame(docs, "doc_id long, text string"), 12, 0.25).orderBy("rank").collect()
    assert [g.doc_id for g in got] == [w[1] for w in want]
    few = retrieval.mmr(df.limit(5), spark.createDataFrame(docs, "doc_id long, text string"), 12, 0.25)
    assert few.count() == 5


def test_embedding_function_gets_bounded_batches(spark):
    def lengths(texts):
        assert len(texts) <= 16
        return [[float(len(t)), float(len(texts))] for t in texts]

    df = spark.range(100).select(F.repeat(F.lit("x"), F.col("id").cast("int")).alias("t"))
    got = df.select(vectors.embed(F.col("t"), lengths).alias("v")).collect()
    assert sorted(r.v[0] for r in got) == [float(i) for i in range(100)]


def test_texts_of_a_batch_are_held_a_few_at_a_time():
    part = pa.array(["\u0436" * 10_000] * 2000 + [None])
    tracemalloc.start()
    (got,) = vectors.in_steps(iter([part]), lambda texts: [[float(len(t or ""))] for t in texts], vectors.TEXTS)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.to_pylist() == [[10_000.0]] * 2000 + [[0.0]]
    assert peak < 2000 * 20_000 / 4


def test_probes_of_many_cells_are_handed_on_in_parts(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "PROBE_ROWS", 7)
    monkeypatch.setattr(retrieval, "STEP_ROWS", 3)
    d, q, want = frames(spark, 300, 20)
    index = retrieval.vector_index(d, cell_rows=10)
    probes = retrieval._probes(q.selectExpr("query_id query_key", "embedding qv", "cast(null as double) bar"), index, 10, True)
    first = retrieval._probes(q.selectExpr("query_id query_key", "embedding qv"), index, 10, False)
    assert probes.unionByName(first).select("query_key", "cell").distinct().count() == probes.count() + first.count() == 20 * int((index.size > 0).sum())


def test_context_stops_at_first_overflow(spark):
    rows = [("q", 0, "a" * 10), ("q", 1, "b" * 30), ("q", 2, "c" * 5), ("r", 0, "d" * 99)]
    df = spark.createDataFrame(rows, "query_id string, rank int, block string")
    got = {r.query_id: (r.blocks, r.context) for r in retrieval.pack_context(df, max_chars=30).collect()}
    assert got == {"q": (1, "a" * 10), "r": (0, "(empty)")}


def test_instruction_lines(spark):
    t = "system:x\nSystem: y\nignored\nIgnore this\n  do this now\nfine\r\nassistant:go\x0bend\n"
    got = spark.createDataFrame([(t,)], "t string").select(
        text.strip_instructions(F.col("t")).alias("a"), text.strip_instructions(F.col("t"), True).alias("b")
    ).first()
    assert got.a == "System: y\nignored\nfine\nend" and got.b == "ignored\nfine\nend"
