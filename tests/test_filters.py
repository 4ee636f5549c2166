"""Filters: operators, bounds, kinds, missing fields; golden counts on 1000 rows; agreement of both evaluations."""

import itertools

import pytest
from pyspark.sql import functions as F

from tessera.functions import metavalue as M
from tessera.plans.filters import Fields, compile_filters, selectivity

META_ONLY = Fields({"doc_type": ("string", "doc_type")})
SCHEMA = "id bigint, doc_type string"


def frame(spark, rows):
    """(id, metadata, doc_type) from plain objects."""
    schema = spark.createDataFrame([], SCHEMA).withColumn("metadata", F.lit(None).cast(M.METADATA)).schema
    return spark.createDataFrame([(k, d, M.to_metadata(m)) for k, (m, d) in enumerate(rows)], schema)


@pytest.fixture(scope="module")
def thousand(spark):
    return frame(spark, [({"org_id": "acme" if i % 100 == 0 else "widgets", "created_at": i * 10, "tags": ["even"] if i % 2 == 0 else ["odd"]}, "chunk") for i in range(1000)]).cache()


@pytest.mark.parametrize(
    ("filters", "count"),
    [
        ({"org_id": "acme"}, 10),
        ({"created_at": {"gte": 100, "lte": 200}}, 11),
        ({"org_id": "acme", "created_at": {"gte": 0, "lte": 5000}}, 6),
        ({"tags": {"contains": "even"}}, 500),
        ({}, 1000),
        ({"created_at": {"gte": 9000}}, 100),
        ({"created_at": {"lte": 90}}, 10),
        ({"org_id": {"in": ["acme", "none"]}}, 10),
        ({"org_id": {"in": []}}, 0),
        ({"missing": "x"}, 0),
        ({"tags": ["even"]}, 500),
        ({"tags": ["even", "odd"]}, 0),
        ({"created_at": 100.0}, 0),
        ({"created_at": "100"}, 0),
    ],
)
def test_golden_counts(thousand, filters, count):
    condition = compile_filters(filters)
    assert (thousand if condition is None else thousand.where(condition)).count() == count


ROWS = [
    ({"department": "Legal", "timerange_start": 2040.0, "priority": 5, "tags": ["sports", "goals"]}, "segment"),
    ({"department": "legal", "priority": "7", "doc_type": "chunk"}, "segment"),
    ({"department": ["Legal"], "priority": True, "tags": "sports"}, "chunk"),
    ({"priority": float("nan"), "tags": [], "department": ""}, "source"),
    ({"priority": "1d", "timerange_start": " 5 "}, "chunk"),
    ({"priority": "inf", "timerange_start": "-2.5e3"}, "chunk"),
    ({}, "chunk"),
]


@pytest.mark.parametrize(
    ("filters", "ids"),
    [
        ({"department": "Legal"}, [0]),
        ({"department": {"contains": "Legal"}}, [0, 2]),
        ({"department": {"in": ["Legal", "legal", 5]}}, [0, 1]),
        ({"priority": 5}, [0]),
        ({"priority": True}, [2]),
        ({"priority": {"gte": 5}}, [0, 1, 5]),
        ({"priority": {"gte": 5, "lte": 7}}, [0, 1]),
        ({"priority": {"lte": 7.5}}, [0, 1]),
        ({"timerange_start": {"lte": 2040}}, [0, 5]),
        ({"timerange_start": {"gte": 2040, "lte": 2040}}, [0]),
        ({"tags": {"contains": "goals"}}, [0]),
        ({"tags": {"contains": "sports"}}, [0, 2]),
        ({"tags": []}, [3]),
        ({"doc_type": "segment"}, [0, 1]),
        ({"doc_type": {"in": ["chunk", "source"]}}, [2, 3, 4, 5, 6]),
        ({"department": {"in": ["Legal"], "contains": "Legal"}}, [0]),
        ({"priority": {"gte": 5, "contains": "7"}}, [1]),
    ],
)
def test_operators(spark, filters, ids):
    assert sorted(r.id for r in frame(spark, ROWS).where(compile_filters(filters)).collect()) == ids


def test_strict_contains(spark):
    rows = frame(spark, ROWS)
    assert [r.id for r in rows.where(compile_filters({"tags": {"contains": "sports"}}, strict_contains=True)).collect()] == [0]


@pytest.mark.parametrize("bad", [{"a": {}}, {"a": {"gt": 1}}, {"a": {"gte": None}}, {"a": {"gte": "x"}}, {"a": None}, {"a": [1, 2]}])
def test_bad_conditions(spark, bad):
    with pytest.raises(ValueError):
        compile_filters(bad)


def test_conjunctions_are_intersections(spark, thousand):
    parts = [{"org_id": "acme"}, {"created_at": {"gte": 2000, "lte": 7000}}, {"tags": {"contains": "even"}}]
    ids = [{r.id for r in thousand.where(compile_filters(p)).select("id").collect()} for p in parts]
    for n in (2, 3):
        for some in itertools.combinations(range(3), n):
            both = {k: v for p in some for k, v in parts[p].items()}
            assert {r.id for r in thousand.where(compile_filters(both)).select("id").collect()} == set.intersection(*(ids[p] for p in some))


def test_promoted_fields_reach_the_scan(spark, tmp_path):
    spark.createDataFrame([("en", 5), ("de", 9)], "lang string, n int").write.parquet(f"{tmp_path}/t")
    fields = Fields({"lang": ("string", "lang"), "n": ("int", "n")}, None)
    plan = spark.read.parquet(f"{tmp_path}/t").where(compile_filters({"lang": "de", "n": {"gte": 6}}, fields))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(lang,de)" in text and "GreaterThanOrEqual(n,6)" in text and plan.count() == 1
    assert spark.read.parquet(f"{tmp_path}/t").where(compile_filters({"n": 5.0}, fields)).count() == 0


def test_selectivity(thousand):
    r = selectivity(thousand, compile_filters({"missing": {"gte": 1}, "org_id": "acme"})).first()
    assert (r.eligible, r.universe, r.selectivity) == (0, 1000, 0.0)
    assert selectivity(thousand.where("false"), None).first().selectivity == 1.0
    assert selectivity(thousand, compile_filters({"org_id": "acme"})).first().selectivity == 0.01


def test_values_and_texts(spark):
    values = {"a": 3, "b": 3.0, "c": True, "d": "x", "e": ["p", "q"], "f": 0.25, "g": 1e20, "h": 1 << 70, "i": -0.0, "j": [], "k": 1e-7, "l": float("inf")}
    assert M.from_metadata(M.to_metadata(values)) == {**values, "h": float(1 << 70)}
    row = frame(spark, [(values, "chunk")]).select(*(M.as_text(M.field(k)).alias(k) for k in values)).first()
    assert row.asDict() == {
        "a": "3", "b": "3", "c": "true", "d": "x", "e": "p,q", "f": "0.25", "g": "100000000000000000000", "h": row.h, "i": "0", "j": "", "k": "0.0000001", "l": "inf",
    }
    for bad in (None, {"x": 1}, [1], ["a", 1]):
        with pytest.raises(ValueError):
            M.to_value(bad)


def test_json_keeps_kinds(spark):
    text = '{"a": 3, "b": 3.0, "c": true, "d": "3", "e": ["x"], "f": [], "g": 99999999999999999999, "h": 1e2}'
    got = spark.createDataFrame([(text,)], "j string").select(M.parse_metadata(F.col("j")).alias("m")).first().m
    assert {k: v["kind"] for k, v in got.items()} == {"a": "int", "b": "float", "c": "bool", "d": "string", "e": "list", "f": "list", "g": "float", "h": "float"}
    assert M.from_metadata(got) == {"a": 3, "b": 3.0, "c": True, "d": "3", "e": ["x"], "f": [], "g": 1e20, "h": 100.0}
    with pytest.raises(Exception, match="no metadata value"):
        spark.createDataFrame([('{"a": null}',)], "j string").select(M.parse_metadata(F.col("j"))).collect()
