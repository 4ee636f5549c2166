import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import topk as T

from .helpers import clashing

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def brute(ids, x, k):
    s = T.rounded(x.astype(np.float64) @ x.astype(np.float64).T)
    out = []
    for a in range(len(ids)):
        best = sorted((-s[a, b], ids[b]) for b in range(len(ids)) if ids[b] != ids[a])[:k]
        out += [(ids[a], r + 1, i, -v) for r, (v, i) in enumerate(best)]
    return sorted(out)


def found(frame, k=T.K):
    return sorted((r.query_id, r.rank, r.neighbour_id, r.score) for r in T.top_k(frame, k).collect())


def same(a, b):
    assert [x[:3] for x in a] == [x[:3] for x in b] and np.allclose([x[3] for x in a], [x[3] for x in b], atol=1e-9)


@pytest.mark.parametrize(("n", "d", "kind"), [(400, 64, "unit"), (300, 8, "lengths"), (250, 40, "low rank"), (60, 3, "grid")])
def test_against_brute_force(spark, monkeypatch, n, d, kind):
    monkeypatch.setattr(T, "ITEMS_AT_ONCE", 37)
    monkeypatch.setattr(T, "QUERIES_AT_ONCE", 23)
    monkeypatch.setattr(T, "PART_ITEMS", 10_000 if kind == "unit" else 90)
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, d))
    if kind == "unit":
        x /= np.linalg.norm(x, axis=1, keepdims=True)
    elif kind == "lengths":
        x *= rng.lognormal(0, 2, n)[:, None]
    elif kind == "low rank":
        x = rng.normal(size=(n, 3)) @ rng.normal(size=(3, d)) + 0.01 * x
    else:
        x = rng.integers(-1, 2, (n, d)).astype(float)  # many ties, zeros and equal vectors
    x = x.astype(np.float32)
    frame = spark.createDataFrame([(k, v.tolist(), 0) for k, v in enumerate(x)], SCHEMA)
    same(found(frame), brute(list(range(n)), x, T.K))


def test_a_query_set_against_all_rows(spark, monkeypatch):
    monkeypatch.setattr(T, "PART_ITEMS", 100)
    monkeypatch.setattr(T, "QUERIES_LEAST", 2)
    x = np.random.default_rng(6).normal(size=(400, 12)).astype(np.float32)
    frame = spark.createDataFrame([(k, v.tolist(), 0) for k, v in enumerate(x)], SCHEMA)
    rows = T.top_k(frame, 5, asked=F.col("vec_id") % 50 == 0).collect()
    same(sorted((r.query_id, r.rank, r.neighbour_id, r.score) for r in rows), [r for r in brute(list(range(400)), x, 5) if r[0] % 50 == 0])


def test_bounds_prune_without_loss():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 32)) * np.concatenate([np.ones(4) * 5, np.ones(28) * 0.1])
    x = x[np.argsort(-np.linalg.norm(x, axis=1))]
    ids = np.arange(2000)
    read = []

    def blocks():
        for at in range(0, 2000, 100):
            read.append(at)
            yield T.Block.of(ids[at : at + 100], x[at : at + 100])

    few = np.flatnonzero(np.linalg.norm(x, axis=1) > np.quantile(np.linalg.norm(x, axis=1), 0.99))
    best = T.Best(len(few), 3)
    T.offer(best, T.Block.of(ids[few], x[few]), blocks())
    assert len(read) <= 20
    s = x[few] @ x.T
    for a in range(len(few)):
        mine = set(best.item[best.query == a].tolist())
        assert mine == set(np.argsort(-np.where(ids == few[a], -np.inf, s[a]))[:3].tolist())


def test_short_lists_stop_early():
    x = np.concatenate([np.full((10, 4), 5.0), np.full((1000, 4), 0.01)])
    read = []

    def blocks():
        for at in range(0, len(x), 10):
            read.append(at)
            yield T.Block.of(np.arange(at, at + 10), x[at : at + 10])

    T.offer(T.Best(10, 5), T.Block.of(np.arange(10), x[:10]), blocks())
    assert read == [0, 10]
    read.clear()
    T.offer(T.Best(10, 5, np.full(10, 1000.0)), T.Block.of(np.arange(10), x[:10]), blocks())
    assert read == [0]


def test_odd_tables(spark):
    rows = [(1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (2, [0.0, 1.0], 0), (3, [1.0, 1.0], 0), (3, [0.5, 1.0], 1), (None, [1.0, 1.0], 0), (4, None, 0), (5, [], 0), (6, [1.0, None], 0), (7, [float("nan"), 1.0], 0), (8, [1.0, 2.0, 3.0], 0), (9, [float("inf"), 0.0], 0)]
    frame = clashing(spark.createDataFrame(rows, SCHEMA))
    same(found(frame), brute([1, 2, 3], np.array([[1, 0], [0, 1], [0.5, 1]], np.float32), T.K))
    assert found(frame.where("false")) == [] and found(frame.where("vec_id is null or vec_id in (4, 5)")) == []
    assert found(frame.where("vec_id = 1")) == []
    assert T.top_k(frame, 1).where(F.col("rank") > 1).count() == 0
