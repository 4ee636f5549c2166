import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import bpe
from tessera.llm import packing as P

from .helpers import docs, empty, odd


def bins_of(frame, capacity, **more):
    return P.pack(frame, P.byte_tokens(frame["text"]), capacity=capacity, **more).collect()


def check(rows, lengths, capacity):
    """Every piece of every document once, no sequence too long; returns the number of sequences."""
    seen = {}
    for r in rows:
        assert r.used == sum(p.length + 1 for p in r.pieces) <= capacity
        assert r.doc_ids == sorted({p.doc_id for p in r.pieces})
        for p in r.pieces:
            seen.setdefault(p.doc_id, []).append((p.start, p.length))
    assert set(seen) == set(lengths)
    for d, n in lengths.items():
        pieces = sorted(seen[d])
        assert pieces[0][0] == 0 and sum(k for _, k in pieces) == n
        assert all(a + k == b for (a, k), (b, _) in itertools.pairwise(pieces))
        assert all(k == capacity - 1 for _, k in pieces[:-1])
    assert len({r.bin_id for r in rows}) == len(rows)
    return len(rows)


def test_best_fit():
    size = np.array([6, 5, 4, 3, 2])
    bin_of = P.packed(size, P.falling(size, np.arange(5)), 10)
    assert bin_of.tolist() == [0, 1, 0, 1, 1]


def test_crossover_and_mutation_keep_packings():
    rng = np.random.default_rng(0)
    size = rng.integers(1, 60, 300)
    people = P.founders(size, 100, 0, rng) + P.founders(size, 100, 1, rng)
    for a, b in itertools.product(people, people):
        for child in (P.crossover(a, b, size, 100, rng), P.mutate(a, size, 100, rng)):
            fill = np.bincount(child, weights=size)
            assert len(child) == 300 and child.min() == 0 and fill.max() <= 100 and fill.min() > 0


def test_crossover_injects_whole_bins():
    rng = np.random.default_rng(1)
    size = rng.integers(1, 60, 200)
    a, b = P.packed(size, rng.permutation(200), 100), P.packed(size, rng.permutation(200), 100)
    child = P.crossover(a, b, size, 100, rng)
    groups = lambda x: {tuple(np.flatnonzero(x == k)) for k in range(x.max() + 1)}
    assert groups(child) & groups(b) - groups(a)


def test_evolution_never_loses_its_best_and_beats_best_fit():
    rng = np.random.default_rng(2)
    size = np.array([35, 34, 31] * 20 + [50, 50] * 10)  # 30 full bins, of which best fit in falling order makes 34
    start = P.founders(size, 100, 0, rng)
    end = P.evolve(size, start, 100, np.random.default_rng(3), children=60)
    assert P.fitness(end[0], size, 100) >= max(P.fitness(p, size, 100) for p in start)
    assert P.packed(size, P.falling(size, np.arange(len(size))), 100).max() + 1 == 34
    assert 30 <= end[0].max() + 1 <= 31


@pytest.mark.parametrize("sizes", [[4, 4, 4, 6, 6, 6], [7, 3, 5, 5, 2, 8], [1], [9, 9, 9], [3] * 7])
def test_small_packings_are_the_least(spark, sizes):
    """Against all assignments; a document of n bytes takes n + 1 of 10."""
    n = len(sizes)
    rows = bins_of(docs(spark, ["x" * (s - 1) for s in sizes]), 10)
    best = min(max(a) + 1 for a in itertools.product(range(n), repeat=n) if all(sum(s for s, b in zip(sizes, a, strict=True) if b == k) <= 10 for k in range(n)))
    assert check(rows, {k: s - 1 for k, s in enumerate(sizes)}, 10) == best


@pytest.mark.parametrize(("items", "slack"), [(P.SHARD_ITEMS, 1.0), (100, 1.06)])
def test_shards_and_long_documents(spark, monkeypatch, items, slack):
    """As few sequences as best fit in falling order over all pieces; little more from shards of 100 pieces."""
    monkeypatch.setattr(P, "SHARD_ITEMS", items)
    rng = np.random.default_rng(4)
    lengths = {k: int(n) for k, n in enumerate(rng.integers(0, 900, 600))} | {1000: 25_000, 1001: 1023, 1002: 1024}
    frame = spark.createDataFrame([(k, "é" * (n // 2) + "x" * (n % 2)) for k, n in lengths.items()], "doc_id bigint, text string")
    rows = bins_of(frame, 1024)
    pieces = np.array([1024] * (25_000 // 1023) + [25_000 % 1023 + 1, 1024, 1024, 2] + [v + 1 for k, v in lengths.items() if k < 1000])
    together = P.packed(pieces, P.falling(pieces, np.arange(len(pieces))), 1024).max() + 1
    assert check(rows, lengths, 1024) <= slack * together
    assert sorted(map(str, bins_of(frame.repartition(5), 1024))) == sorted(map(str, rows))


def test_a_repeated_row_is_spread_over_shards(spark, monkeypatch):
    monkeypatch.setattr(P, "SHARD_ITEMS", 50)
    monkeypatch.setattr(P, "COPIES_AT_ONCE", 7)
    frame = spark.createDataFrame([(1, "x" * 20)] * 300 + [(k, "y" * k) for k in range(2, 200)], "doc_id bigint, text string")
    rows = bins_of(frame, 64)
    assert sum(p.doc_id == 1 for r in rows for p in r.pieces) == 300
    shards = {r.bin_id >> 32 for r in rows if 1 in r.doc_ids}
    held = {s: sum(p.doc_id == 1 for r in rows for p in r.pieces if r.bin_id >> 32 == s) for s in shards}
    assert len(shards) >= 8 and max(held.values()) < 80


def test_byte_pair_tokens(spark):
    """Packed by the number of byte-pair tokens instead of bytes."""
    texts = ["the river runs " * n for n in range(1, 40)] + ["", "é中\U0001f600"]
    frame = docs(spark, texts)
    counts = {r.doc_id: r.n for r in frame.select("doc_id", bpe.token_count(frame["text"]).alias("n")).collect()}
    assert counts == {r.doc_id: r.n_tokens for r in bpe.encode_and_check(frame).collect()}
    check(P.pack(frame, bpe.token_count(frame["text"]), capacity=128).collect(), counts, 128)
    assert odd(spark).select(bpe.token_count(F.col("text")).alias("n")).where("n is null").count() == 2


def test_tasks_grow_with_islands():
    assert [P.tasks_for(n) for n in (0, 5, 10_000)] == [1, 5, 4096] and P.tasks_for(10**8) > 190_000


def test_odd_tables(spark):
    rows = bins_of(odd(spark), 4096)
    lengths = {2: 0, 3: 4, 6: 200_000}
    held = {p.doc_id for r in rows for p in r.pieces}
    assert held == {2, 3, 4, 5, 6, 7}
    assert sum(p.doc_id == 5 for r in rows for p in r.pieces) == 2
    for d, n in lengths.items():
        assert sum(p.length for r in rows for p in r.pieces if p.doc_id == d) == n
    assert bins_of(empty(spark), 4096) == []
    with pytest.raises(ValueError):
        bins_of(empty(spark), 1)
