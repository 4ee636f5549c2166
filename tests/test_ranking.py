"""Fusion, scores, vectors, facets."""

import math
import random
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import queries
from tessera.functions import metavalue as M
from tessera.operators import facets, scoring, vectors
from tessera.operators.fusion import reciprocal_rank_fusion, top
from tessera.plans.filters import Fields

LIST = "chunk_id bigint, score double"
NOW = datetime(2024, 2, 15)


def fused(spark, a, b, limit=10, **more):
    rows = reciprocal_rank_fusion(spark.createDataFrame(a, LIST), spark.createDataFrame(b, LIST), limit, **more)
    return [(r.chunk_id, round(r.base_score, 9), r.source) for r in rows.orderBy(F.desc("base_score"), "chunk_id").collect()]


def test_fusion(spark):
    got = fused(spark, [(1, 9.0), (2, 8.0)], [(2, 0.9), (3, 0.8)])
    assert got == [(2, round(1 / 61 + 1 / 60, 9), "both"), (1, round(1 / 60, 9), "fts"), (3, round(1 / 61, 9), "semantic")]
    assert [x[0] for x in fused(spark, [(1, 9.0), (2, 8.0)], [(2, 0.9), (3, 0.8)], limit=1)] == [2]
    assert fused(spark, [], [(5, 1.0)], k=1.0, semantic_weight=4.0) == [(5, 4.0, "semantic")] and fused(spark, [], []) == []
    assert [x[0] for x in fused(spark, [(7, 1.0), (3, 1.0), (5, 1.0)], [])] == [3, 5, 7]
    with pytest.raises(ValueError):
        fused(spark, [], [], k=0)


def test_fusion_against_loops(spark):
    rng = random.Random(2)
    for _ in range(3):
        a, b = ([(k, float(rng.randint(0, 9))) for k in rng.sample(range(40), 15)] for _ in range(2))
        total = {}
        for ranked, w in ((a, 0.7), (b, 1.9)):
            for r, (k, _) in enumerate(sorted(ranked, key=lambda x: (-x[1], x[0]))):
                total[k] = total.get(k, 0) + w / (20 + r)
        want = sorted(total.items(), key=lambda x: (-x[1], x[0]))[:12]
        got = fused(spark, a, b, 12, k=20.0, fts_weight=0.7, semantic_weight=1.9)
        assert [x[0] for x in got] == [k for k, _ in want] and [x[1] for x in got] == pytest.approx([v for _, v in want], abs=1e-8)


@pytest.mark.parametrize(
    ("stamp", "factor"),
    [
        ("2024-02-15T00:00:00Z", 1.0), ("2024-02-05T00:00:00Z", 0.5), ("2024-01-26T00:00:00+00:00", 0.25), ("2023-02-15T00:00:00Z", 0.1), ("2024-03-01T00:00:00Z", 1.0),
        ("2024-02-05T02:00:00+02:00", 0.5), ("2024-02-05 00:00:00.500Z", 2 ** -((864000 - 1) / 864000)), ("2024-02-05", 1.0), ("2024-02-05T00:00:00", 1.0), ("yesterday", 1.0), (1707091200, 1.0), (None, 1.0),
    ],
)
def test_recency(spark, stamp, factor):
    meta = {} if stamp is None else {"at": stamp}
    schema = spark.range(0).withColumn("metadata", F.lit(None).cast(M.METADATA)).schema
    row = spark.createDataFrame([(1, M.to_metadata(meta))], schema)
    got = row.select(scoring.recency_factor(scoring.Recency("at", 10.0), NOW, Fields({})).alias("f")).first().f
    assert got == pytest.approx(factor, abs=1e-9)


def test_presets():
    assert scoring.Recency.preset("recent", "at") == scoring.Recency("at", 7.0, 0.2) and scoring.Recency.preset("archive", "at").min_score == 0.5
    assert scoring.Recency.preset("other", "at") is None and scoring.Recency.preset("mild", None) is None
    with pytest.raises(ValueError):
        scoring.Recency("at", 0)


def test_boosts(spark):
    schema = spark.range(0).withColumn("metadata", F.lit(None).cast(M.METADATA)).schema
    rows = spark.createDataFrame([(1, M.to_metadata({"a": "x", "n": 5, "t": "7"})), (2, M.to_metadata({"a": ["x"], "n": 5.5})), (3, {})], schema)
    boosts = [scoring.Boost("a", "x", weight=2.0), scoring.Boost("n", gte=5.0, lte=5.2, weight=3.0), scoring.Boost("t", gte=7, weight=5.0), scoring.Boost("a", "x", gte=9, weight=1.5), scoring.Boost("n", weight=7.0)]
    got = {r.id: r.f for r in rows.select("id", scoring.boost_factor(boosts, Fields({})).alias("f")).collect()}
    assert got == {1: 2.0 * 3.0 * 5.0 * 1.5, 2: 1.0, 3: 1.0}


@pytest.mark.parametrize("mode", ["max", "avg", "sum", "other"])
def test_relationships(spark, mode):
    rng = random.Random(3)
    rows = [(k, float(rng.randint(-3, 9)), rng.choice([None, *range(25)]), rng.choice([None, "a", "b", "c"])) for k in range(20)]
    most = max(max(s for _, s, _, _ in rows), 1e-10)
    ids = {k for k, *_ in rows}
    frame = spark.createDataFrame(rows, "chunk_id bigint, base_score double, parent_id bigint, group_id string")
    got = {r.chunk_id: r.relation for r in scoring.relationship_factor(frame, scoring.RelationshipBoost(0.3, 0.1, mode)).collect()}
    for k, _, parent, group in rows:
        others = [s / most for j, s, _, g in rows if g == group and j != k] if group else []
        agg = 0.0 if not others else sum(others) / len(others) if mode == "avg" else sum(others) if mode == "sum" else max(0.0, *others)
        assert got[k] == pytest.approx(1 + 0.3 * (parent in ids) + 0.1 * agg, abs=1e-9)


def test_negative_scores_are_clamped(spark):
    frame = spark.createDataFrame([(1, -2.0, None, "a"), (2, -1.0, None, "a")], "chunk_id bigint, base_score double, parent_id bigint, group_id string")
    got = {r.chunk_id: r.relation for r in scoring.relationship_factor(frame, scoring.RelationshipBoost(mode="sum")).collect()}
    assert got[1] == pytest.approx(1 + 0.1 * (-1.0 / 1e-10))


VECTORS = "chunk_id bigint, embedding array<float>"


def unit_rows(n, d, seed):
    x = np.random.default_rng(seed).normal(size=(n, d))
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def test_exact_search(spark):
    x = unit_rows(500, 16, 1) * 3
    frame = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)] + [(900, None), (901, [0.0] * 16)], VECTORS)
    q = np.random.default_rng(2).normal(size=16)
    s = (x.astype(float) @ q) / np.linalg.norm(x.astype(float), axis=1) / np.linalg.norm(q)
    got = vectors.nearest(frame, q.tolist(), 20).collect()
    assert [r.chunk_id for r in got] == np.argsort(-s)[:20].tolist() and [r.score for r in got] == pytest.approx(np.sort(s)[::-1][:20].tolist(), abs=1e-6)
    ok = spark.createDataFrame([(k,) for k in range(0, 500, 7)], "chunk_id bigint")
    got = [r.chunk_id for r in vectors.nearest(frame, q.tolist(), 10, ok).collect()]
    assert got == sorted(range(0, 500, 7), key=lambda k: -s[k])[:10]
    assert vectors.nearest(frame, q.tolist(), 10, ok.where("false")).count() == 0
    with pytest.raises(Exception, match="dimensions"):
        vectors.nearest(frame, [1.0, 2.0], 3).collect()


def test_inverted_file_recall(spark, tmp_path):
    rng = np.random.default_rng(4)
    centres = unit_rows(40, 32, 5)
    x = centres[rng.integers(0, 40, 4000)] + 0.15 * rng.normal(size=(4000, 32)) / math.sqrt(32)
    frame = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x.astype(np.float32))], VECTORS)
    index = vectors.InvertedFile.build(frame, f"{tmp_path}/ivf", vectors.IndexParams(dims=32, n_lists=40, n_probe=8))
    found = [vectors.recall(index.search(q.tolist(), 10), vectors.nearest(frame, q.tolist(), 10)) for q in x[:5]]
    assert np.mean(found) >= 0.95
    plan = index.search(x[0].tolist(), 10)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "centre" in plan.split("PartitionFilters: [")[1][:200]
    none = vectors.InvertedFile.build(frame.where("false"), f"{tmp_path}/none", vectors.IndexParams(dims=32))
    assert none.search(x[0].tolist(), 3).count() == 0


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01", "sf0.1"])
def test_registered_inverted_file_finds_what_the_exact_scan_finds(spark, size):
    found, exact = (queries.QUERIES[q](spark, f"/root/testdata/{size}").collect() for q in ("vector_inverted_file", "vector_topk_cosine"))
    assert {r.chunk_id for r in found} == {r.chunk_id for r in exact} and [r.score for r in found] == pytest.approx([r.score for r in exact], abs=2e-6)


def test_inverted_file_without_clusters(spark, tmp_path):
    x = np.vstack([unit_rows(3000, 24, 11), np.zeros((2, 24), np.float32)])
    frame = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], VECTORS)
    index = vectors.InvertedFile.build(frame, f"{tmp_path}/flat", vectors.IndexParams(dims=24, n_probe=1))
    ok = spark.createDataFrame([(k,) for k in range(0, 3002, 50)], "chunk_id bigint")
    for q in (*unit_rows(2, 24, 12).tolist(), x[7].tolist()):
        for k, among in ((10, None), (10, ok), (100, ok)):
            assert [r.chunk_id for r in index.search(q, k, among).collect()] == [r.chunk_id for r in vectors.nearest(frame, q, k, among).collect()]


def test_top_has_no_shuffle(spark):
    plan = top(spark.range(100).select(F.col("id").alias("chunk_id"), F.rand(1).alias("score")), 5)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Exchange" not in plan


def test_facets(spark):
    schema = spark.range(0).withColumn("metadata", F.lit(None).cast(M.METADATA)).schema
    rows = [{"a": 9}, {"a": 9.0, "b": True}, {"a": "9", "t": ["x", "y"]}, {}, {"t": ["y", "x"], "b": False}]
    frame = spark.createDataFrame([(k, M.to_metadata(m)) for k, m in enumerate(rows)], schema)
    assert facets.as_mapping(facets.facet_counts(frame)) == {"a": {"9": 3}, "b": {"true": 1, "false": 1}, "t": {"x,y": 1, "y,x": 1}}
    matched = spark.createDataFrame([(0,), (4,)], "chunk_id bigint")
    assert facets.as_mapping(facets.facet_counts(frame, ["a", "b", "zz"], matched), ["a", "b", "zz"]) == {"a": {"9": 1}, "b": {"false": 1}, "zz": {}}
    ids = spark.range(100_000).withColumn("metadata", M.metadata_of(k=("int", F.col("id") % 3)))
    counts = facets.facet_sets(ids, "k").groupBy("value").agg(F.sum(F.bitmap_count("bitmap")).alias("n")).collect()
    assert {r.value: r.n for r in counts} == {"0": 33334, "1": 33333, "2": 33333}


def test_many_vectors_at_once(spark, monkeypatch):
    rng = np.random.default_rng(30)
    x = rng.integers(-2, 3, (300, 6)).astype(np.float32)  # ties, equal vectors, and some without length
    frame = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], VECTORS)
    asked = frame.where("chunk_id % 25 = 0").withColumnRenamed("chunk_id", "query_id")
    want = {(q, r.chunk_id) for q in range(0, 300, 25) for r in vectors.nearest(frame, x[q].tolist(), 7).select("chunk_id", F.round("score", 9).alias("score")).collect()}
    for part in (1 << 24, 64):
        monkeypatch.setattr(vectors, "PART_VECTORS", part)
        monkeypatch.setattr(vectors, "FILE_VECTORS", 16 if part == 64 else 1 << 20)
        monkeypatch.setattr(vectors, "QUERIES_AT_ONCE", 5)
        rows = vectors.nearest_of_all(frame, asked, 7).collect()
        assert len(rows) == 84 and len({(r.query_id, r.rank) for r in rows}) == 84
        y = x.astype(float) / np.where((n := np.linalg.norm(x.astype(float), axis=1, keepdims=True)) > 0, n, 1)
        for r in rows:
            assert r.score == pytest.approx(float(y[r.query_id] @ y[r.chunk_id]), abs=1e-8)
        assert len({(r.query_id, r.chunk_id) for r in rows} ^ want) <= 12  # equal scores that differ in the last bits
    none = frame.withColumn("embedding", F.lit(None).cast("array<float>"))
    assert vectors.nearest_of_all(none, asked, 3).count() == 0 and vectors.nearest_of_all(frame, asked.where("false"), 3).count() == 0
