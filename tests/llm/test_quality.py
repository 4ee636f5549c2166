import random

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import quality

from .helpers import docs, empty, labels, odd

GOOD = "the river runs over old stones and under the low bridge where children often play in summer evening light".split()


def good(rng):
    return " ".join(rng.choice(GOOD) for _ in range(rng.randint(60, 300))) + "."


def bad(rng):
    return " ".join(rng.choice(GOOD).upper() + rng.choice(["!!", "###", "$$$"]) for _ in range(rng.randint(60, 300)))


def corpus(n, seed=1):
    rng = random.Random(seed)
    return [(bad(rng) if k % 4 == 0 else good(rng)) for k in range(n)]


def test_held_out_accuracy(spark):
    texts = corpus(400)
    marks = labels(spark, [(k, int(k % 4 != 0), 0) for k in range(200)])
    frame = docs(spark, texts)
    rows = {r.doc_id: r for r in quality.classify(frame, quality.fit(frame, marks)).collect()}
    held = [rows[k].keep == (k % 4 != 0) for k in range(200, 400)]
    assert np.mean(held) >= 0.98
    assert all(rows[k].keep for k in range(200, 400) if k % 4)
    assert all(0 <= r.score <= 1 for r in rows.values())
    kept = quality.good_documents(frame, marks)
    assert {r.doc_id for r in kept.collect()} == {k for k, r in rows.items() if r.keep} and kept.columns == frame.columns


def test_score_is_calibrated():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(-1, 1, 4000), rng.normal(1, 1, 1000)])
    y = np.concatenate([np.ones(4000), np.zeros(1000)])
    slope, offset = quality.logistic(x, y)
    p = 1 / (1 + np.exp(-(slope * x + offset)))
    for low in np.arange(0.1, 0.9, 0.2):
        some = (p >= low) & (p < low + 0.2)
        assert abs(p[some].mean() - y[some].mean()) < 0.06


def test_cutoff_weighs_good_ones():
    score, is_good = np.array([0.1, 0.2, 0.3, 0.4, 0.9]), np.array([False, True, False, False, True])
    best = quality.best_cutoff(score, is_good)
    cost = lambda c: 3 * (is_good & (score < c)).sum() + (~is_good & (score >= c)).sum()
    assert cost(best) == min(cost(c) for c in np.arange(0, 1.01, 0.01))


def test_blocks_cover_the_whole_text():
    parts = quality.blocks_of("a" * 5000 + "b" * 5000)
    assert parts[0] == b"a" * 512 and parts[-1] == b"b" * 512 and len(parts) == quality.BLOCKS_EACH
    assert quality.blocks_of("short") == [b"short"] and quality.blocks_of("") == [b""]


def test_the_sample_is_bounded_by_rows(spark):
    """An id that many rows repeat counts once, with the same text in every run."""
    frame = docs(spark, corpus(40)).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(30)))).withColumn("text", F.concat("text", F.col("k").cast("string")))
    marks = labels(spark, [(k, k % 2, 0) for k in range(40)])
    picked = [sorted(map(str, quality.labelled(f, marks, "quality", "doc_id", "text", 25).collect())) for f in (frame, frame.orderBy("text"))]
    assert len(picked[0]) == 25 and picked[0] == picked[1]


def test_scores_against_compressing_block_by_block(spark):
    """The operator's score is that of a plain loop over blocks, for good texts and bad ones."""
    import math

    import zstandard

    texts = corpus(80) + ["short", "x" * 3000]
    frame = docs(spark, texts)
    model = quality.fit(frame, labels(spark, [(k, int(k % 4 != 0), 0) for k in range(80)]))
    rows = {r.doc_id: r for r in quality.classify(frame, model).collect()}

    def size(block, dictionary):
        held = zstandard.ZstdCompressionDict(dictionary)
        return len(zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=held, write_content_size=False, write_dict_id=False, write_checksum=False).compress(block))

    for k, t in enumerate(texts):
        raw = t.encode()
        if len(raw) < quality.LEAST_BYTES:
            assert rows[k].score is None and rows[k].keep
            continue
        blocks = [raw[a : a + quality.BLOCK] for a in range(0, len(raw), quality.BLOCK)]
        x = sum(size(b, model.good) - size(b, model.bad) for b in blocks) / (len(raw) + quality.SHRINK)
        score = 1 / (1 + math.exp(-(model.slope * x + model.offset)))
        assert abs(rows[k].score - score) < 1e-9 and rows[k].keep == (score >= model.cutoff)


def test_odd_tables(spark):
    texts = corpus(120)
    marks = labels(spark, [(k, int(k % 4 != 0), 0) for k in range(100)] + [(None, 1, 0), (101, None, 0), (102, 7, 0), (103, 0, 0), (103, 1, 0)])
    model = quality.fit(docs(spark, texts), marks)
    frame = odd(spark, "the river runs over old stones")
    rows = quality.classify(frame, model).collect()
    assert len(rows) == 10 and [(r.score, r.keep) for r in rows if r.doc_id in (1, 2, 3)] == [(None, True)] * 3
    assert len({r.score for r in rows if r.doc_id == 5}) == 1
    assert quality.good_documents(frame, marks).columns == frame.columns
    assert quality.classify(empty(spark), model).count() == 0


def test_without_labels_of_both_kinds(spark):
    frame = docs(spark, corpus(20))
    for marks in ([], [(k, 1, 0) for k in range(20)], [(99, 0, 0)]):
        assert quality.fit(frame, labels(spark, marks)) is None
    assert quality.good_documents(frame, labels(spark, [])).count() == 20
    assert quality.classify(frame, None).where("keep and score is null").count() == 20
    few = quality.fit(frame, labels(spark, [(0, 0, 0), (1, 1, 0), (2, 1, 0)]))
    assert quality.classify(frame, few).count() == 20
