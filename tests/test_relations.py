"""Time windows, parent metadata, references within a batch."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import metavalue as M
from tessera.operators import relations as R

CHUNKS = "id bigint, doc_type string, parent_id bigint, group_id string"


def frame(spark, rows):
    schema = spark.createDataFrame([], CHUNKS).withColumn("metadata", F.lit(None).cast(M.METADATA)).schema
    return spark.createDataFrame([(i, d, p, g, M.to_metadata(m)) for i, d, p, g, m in rows], schema)


def span(s=None, e=None):
    return {k: v for k, v in (("timerange_start_ms", s), ("timerange_end_ms", e)) if v is not None}


SEGMENTS = [
    (1, "segment", None, "a", span(100.0, 200.0)), (2, "segment", None, "a", span(5200, 5200)), (3, "segment", None, "a", {}), (4, "segment", None, "a", span(50)),
    (5, "segment", None, "b", span(100, 200)), (6, "chunk", None, "a", span(100, 200)), (7, "segment", None, "a", span("150", "160")), (8, "segment", None, "a", span(float("nan"), 300.0)),
]


@pytest.mark.parametrize(
    ("window", "ids"),
    [
        ({}, [4, 1, 7, 2, 8, 3]),
        ({"time_ms": 100}, [1]),
        ({"time_ms": 150}, [1, 7]),
        ({"time_ms": 200}, [1]),
        ({"time_ms": 250}, []),
        ({"time_ms": 5200}, [2]),
        ({"time_ms": 5201}, []),
        ({"time_start_ms": 180, "time_end_ms": 300}, [1]),
        ({"time_start_ms": 250, "time_end_ms": 400}, []),
        ({"time_start_ms": 160}, [1, 7, 2]),
        ({"time_end_ms": 120}, [1]),
        ({"time_end_ms": 99.5}, []),
        ({"time_ms": 250, "time_start_ms": 0, "time_end_ms": 9999}, []),
        ({"time_start_ms": 0, "time_end_ms": 9999}, [1, 7, 2]),
    ],
)
def test_windows(spark, window, ids):
    assert [r.id for r in R.segments_at(frame(spark, SEGMENTS), "a", **window).collect()] == ids


def test_many_points(spark):
    rows = spark.createDataFrame([(k, "a" if k % 2 else "b", k * 10, k * 10 + 25) for k in range(50)], "id bigint, asset string, start_ms bigint, end_ms bigint")
    points = spark.createDataFrame([("a", 100), ("b", 101), ("c", 5), ("a", 10_000)], "asset string, time_ms bigint")
    got = {(r.asset, r.time_ms, r.id) for r in R.segments_for_points(rows, points).collect()}
    assert got == {(a, t, k) for a, t in (("a", 100), ("b", 101)) for k in range(50) if ("a" if k % 2 else "b") == a and k * 10 <= t <= k * 10 + 25}
    plan = R.segments_for_points(rows, points)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_parent_metadata(spark):
    rows = frame(
        spark,
        [
            (1, "source", None, None, {"title": "Keynote"}), (2, "segment", 1, None, {}), (3, "segment", 99, None, {}), (4, "segment", None, None, {}), (5, "chunk", 1, None, {}),
            (20, "source", None, None, {}), (21, "segment", 20, None, {}), (22, "segment", 1, None, {}), (23, "segment", 2, None, {}),
        ],
    )
    got = {r.id: M.from_metadata(r.parent_metadata) for r in R.parent_metadata(rows, rows).collect()}
    assert got == {1: None, 2: {"title": "Keynote"}, 3: None, 4: None, 5: None, 20: None, 21: {}, 22: {"title": "Keynote"}, 23: {}}


def test_references(spark):
    rows = [(10, "p", None, None), (11, "q", "p", 7), (12, None, "none", 7), (13, "p", "z", None), (14, "z", None, 3), (15, None, None, None)]
    got = {r.id: r.parent_id for r in R.resolve_parents(spark.createDataFrame(rows, "id bigint, client_id string, parent_ref string, parent_id bigint")).collect()}
    assert got == {10: None, 11: 13, 12: 7, 13: 14, 14: 3, 15: None}
