"""Collections end to end: names, ingest, restart, search, rebuild, streams."""

import json
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.engine import Engine, percent
from tessera.functions import embedding
from tessera.functions import metavalue as M
from tessera.functions import vector as V
from tessera.functions.embedding import Fallback, StaticEmbedder, embed_query, static_embedding
from tessera.operators.scoring import RelationshipBoost
from tessera.plans.search import SearchRequest
from tessera.sources.catalog import CollectionError, NotFound, check_name
from tessera.streaming.ingest import stream_into


def unit(seed, d=4):
    x = np.random.default_rng(seed).normal(size=d)
    return (x / np.linalg.norm(x)).tolist()


def chunk(k, text="some text", **more):
    return {"file_id": f"f{k}", "chunk_index": 0, "text": text, **more}


@pytest.fixture
def engine(spark, tmp_path):
    return Engine(spark, f"{tmp_path}/data")


@pytest.mark.parametrize("name", ["news-2024", "archive", "v2", "a", "A1"])
def test_good_names(name):
    assert check_name(name) == name


@pytest.mark.parametrize("name", ["", "..", "../x", "/", "\\", "a b", "a.b", "a_b", "a\tb", "a\n", "é", None])
def test_bad_names(engine, name):
    with pytest.raises(CollectionError):
        check_name(name)
    with pytest.raises(CollectionError):
        engine.create_collection(name)


def test_catalog(engine):
    c = engine.create_collection("one")
    assert (c.default_vector_space, c.vector_spaces["default"].dims, c.vector_spaces["default"].model) == ("default", 384, "bge-small-en-v1.5")
    with pytest.raises(CollectionError):
        engine.create_collection("one")
    with pytest.raises(CollectionError):
        engine.create_collection("three", {"../x": {"dims": 3}})
    two = engine.create_collection("two", {"b": {"dims": 3}, "a": {"dims": 5, "model": "m"}}, config={"analyzer": "simple"})
    assert two.default_vector_space == "b" and [c.name for c in engine.list_collections()] == ["one", "two"]
    assert engine.get_collection("none") is None and engine.get_collection("../x") is None
    assert engine.add_vector_space("two", "c", 7).status == "building"
    for bad in (lambda: engine.add_vector_space("two", "c", 7), lambda: engine.delete_vector_space("two", "b"), lambda: engine.set_default_vector_space("two", "x"), lambda: engine.add_vector_space("two", "d", 0)):
        with pytest.raises(CollectionError):
            bad()
    engine.set_default_vector_space("two", "c")
    engine.delete_vector_space("two", "b")
    engine.delete_vector_space("two", "never")
    assert {s["name"]: s["is_default"] for s in engine.list_vector_spaces("two")} == {"a": False, "c": True}
    engine.delete_collection("one")
    with pytest.raises(NotFound):
        engine.delete_collection("one")
    assert engine.health() == {"status": "ok", "collections": 1, "chunks": 0}


def test_ids_go_on_after_a_restart(spark, engine, tmp_path):
    engine.create_collection("t", embedding_dims=4)
    r = engine.ingest("t", [chunk(k, f"chunk-{k}", client_id=f"c{k}", embedding=unit(k)) for k in range(2)])
    assert r["indexed"] == 2 and r["id_map"] == {"c0": 0, "c1": 1}
    again = Engine(spark, f"{tmp_path}/data")
    assert again.ingest("t", [chunk(2, "chunk-2", client_id="x", parent_id=0)])["id_map"] == {"x": 2}
    got = again.get_chunks("t", [0, 1, 2, 9])
    assert [(g["id"], g["text"], g["parent_id"], g["doc_type"]) for g in got] == [(0, "chunk-0", None, "chunk"), (1, "chunk-1", None, "chunk"), (2, "chunk-2", 0, "chunk")]
    assert again.store.vectors(again.catalog.need("t"), "default").count() == 2


def test_batches_that_failed_are_not_read(engine):
    engine.create_collection("t", embedding_dims=4)
    engine.ingest("t", [chunk(0)])
    with pytest.raises(Exception, match="dimensions"):
        engine.ingest("t", [chunk(1, embedding=[1.0, 2.0])])
    with pytest.raises(Exception, match="no vector space"):
        engine.ingest("t", [chunk(1, embeddings={"other": unit(1)})])
    for bad in ({"text": "x"}, {**chunk(1), "colour": 1}, {**chunk(1), "metadata": {"a": None}}):
        with pytest.raises(ValueError):
            engine.ingest("t", [bad])
    assert engine.chunks("t").count() == 1 and engine.ingest("t", [chunk(1, client_id="n")])["id_map"] == {"n": 1}
    assert engine.ingest("t", [])["indexed"] == 0


@pytest.fixture(scope="module")
def hundred(spark, tmp_path_factory):
    e = Engine(spark, str(tmp_path_factory.mktemp("hundred")))
    e.create_collection("t", embedding_dims=4)
    rows = [chunk(i, f"document number {i} about {'wolves' if i % 3 else 'bears'}", metadata={"org_id": "acme" if i % 5 == 0 else "widgets", "created_at": 1_700_000_000 + i}, embedding=unit(i + 1), group_id=f"g{i % 10}") for i in range(100)]
    e.ingest("t", rows)
    return e


def test_filtered_search_and_explain(hundred):
    r = hundred.search("t", {"query": "wolf", "mode": "semantic", "vector": unit(7), "filters": {"org_id": "acme"}, "top_k": 10, "explain": True})
    assert r["total"] == 10 and all(h["metadata"]["org_id"] == "acme" for h in r["results"])
    assert r["explain"] == {"eligible_count": 20, "universe_count": 100, "selectivity": 0.2, "engine": "exact", "candidates_inspected": 20}
    exact = sorted(range(0, 100, 5), key=lambda i: -float(np.dot(unit(i + 1), unit(7))))[:10]
    assert [h["id"] for h in r["results"]] == exact
    assert hundred.search("t", {"query": "x", "mode": "fts", "explain": True})["explain"]["engine"] == "none"


def test_modes(hundred):
    text = hundred.search("t", {"query": "wolves", "mode": "FTS", "top_k": 5})
    assert text["mode"] == "FTS" and all(h["source"] == "fts" and h["id"] % 3 for h in text["results"]) and text["total"] == 5
    both = hundred.search("t", {"query": "bears", "vector": unit(1), "top_k": 5, "mode": "anything"})
    assert {h["source"] for h in both["results"]} <= {"fts", "semantic", "both"} and both["total"] == 5
    assert hundred.search("t", {"query": "bears", "mode": "semantic"})["results"] == []
    assert hundred.search("t", {"query": "bears", "mode": "semantic", "vector": unit(1), "vector_space": "none"})["results"] == []
    assert all(h["source"] == "fts" for h in hundred.search("t", {"query": "bears"})["results"])
    for bad in ({"top_k": 0}, {"top_k": 1001}, {"score_weights": {"rrf_k": 0}}, {"filters": {"a": {}}}):
        with pytest.raises(ValueError):
            hundred.search("t", {"query": "x", **bad})
    with pytest.raises(NotFound):
        hundred.search("none", {"query": "x"})


def test_scores_reorder(hundred):
    base = hundred.search("t", {"query": "bears", "mode": "fts", "top_k": 10})
    boosted = hundred.search("t", {"query": "bears", "mode": "fts", "top_k": 10, "boosts": [{"field": "org_id", "value": "acme", "weight": 10.0}]})
    assert boosted["results"][0]["metadata"]["org_id"] == "acme" and boosted["results"][0]["score"] == pytest.approx(10 * boosted["results"][0]["base_score"])
    assert base["results"][0]["score"] == base["results"][0]["base_score"]
    s = hundred.plan("t", SearchRequest("bears", mode="fts", top_k=10, relationship_boost=RelationshipBoost()))
    assert s.candidates().count() == 30 and s.ranked().count() == 10


def test_pre_and_post_filters(hundred):
    filters = {"created_at": {"lte": 1_700_000_006}}
    pre = hundred.search("t", {"query": "document", "mode": "fts", "top_k": 1, "filters": filters})
    assert pre["total"] == 1 and pre["results"][0]["id"] <= 6
    post = hundred.search("t", {"query": "bears about 99", "mode": "fts", "top_k": 1, "filters": {"created_at": 1_700_000_098}, "filter_mode": "post"})
    assert post["total"] == 0


def test_facets_cover_all_batches(engine):
    engine.create_collection("t")
    engine.ingest("t", [chunk(0, "red apple", metadata={"c": "x"})])
    engine.ingest("t", [chunk(1, "green apple", metadata={"c": "x", "n": 1.0})])
    assert engine.facets("t") == {"c": {"x": 2}, "n": {"1": 1}}
    assert engine.facets("t", "green", ["c", "zz"]) == {"c": {"x": 1}, "zz": {}} and engine.facets("t", "*", ["c"]) == {"c": {"x": 2}}
    engine.create_collection("none")
    assert engine.facets("none", "x", ["c"]) == {"c": {}}


TABLE = {"red": [1, 0, 0], "green": [0, 1, 0], "apple": [0, 0, 1]}


def test_embedders(spark):
    e = StaticEmbedder(TABLE)
    assert embed_query(e, "Red apple")[0] == pytest.approx(0.5**0.5) and embed_query(e, "nothing") is None and embed_query(None, "red") is None
    other = StaticEmbedder({"nothing": [0, 2, 0]})
    assert embed_query(Fallback(e, other), "nothing") == [0.0, 1.0, 0.0]
    texts = spark.createDataFrame([(1, "red red apple"), (2, "none"), (3, None)], "id bigint, text string")
    words = spark.createDataFrame([(k, [float(x) for x in v]) for k, v in TABLE.items()], "token string, vector array<double>")
    got = {r.id: list(r.embedding) for r in static_embedding(texts, words, 3).collect()}
    assert got.keys() == {1} and got[1] == pytest.approx(e.embed(["red red apple"])[0].tolist())


@pytest.mark.parametrize("held", [True, False], ids=["looked up", "joined"])
def test_static_embedding_reads_the_texts_once(spark, monkeypatch, held):
    """The same vectors by both ways; repeated ids are one text, nulls in vectors add nothing; the table is computed once."""
    monkeypatch.setattr(embedding, "HELD_TOKENS", 10**6 if held else 0)
    computed = spark.sparkContext.accumulator(0)

    def note(batches):
        for b in batches:
            computed.add(b.num_rows)
            yield b

    words = spark.createDataFrame([("red", [1.0, 0.0, None]), ("apple", [0.0, 0.0, 1.0]), (None, [5.0, 5.0, 5.0]), ("zero", [0.0, 0.0, 0.0])], "token string, vector array<double>").mapInArrow(note, "token string, vector array<double>")
    texts = spark.createDataFrame([(1, "red Red apple"), (2, "none"), (3, None), (4, "red"), (4, "apple"), (5, "zero"), (None, "red")], "id bigint, text string")
    got = {r.id: r.embedding for r in static_embedding(texts, words, 3).collect()}
    half = 0.5**0.5
    assert got == {1: pytest.approx([2 / 5**0.5, 0, 1 / 5**0.5]), 4: pytest.approx([half, 0, half]), 5: None, None: [1.0, 0.0, 0.0]}
    assert computed.value == 4


def test_embed_column_keeps_order_nulls_and_failures(spark):
    rows = spark.createDataFrame([(1, "red"), (2, None), (3, "none"), (4, ""), (5, "apple"), (6, "green")], "id bigint, text string").coalesce(1)
    got = [r.v for r in rows.select(embedding.embed_column(F.col("text"), StaticEmbedder(TABLE), 2).alias("v")).collect()]
    assert got == [[1, 0, 0], None, None, None, [0, 0, 1], [0, 1, 0]]


def test_a_term_of_all_chunks_is_spread_over_the_tasks(spark, engine):
    """Every file of postings is sorted, and none holds all chunks of a common term."""
    engine.create_collection("t", config={"analyzer": "simple"})
    c = engine.ingest_frame("t", spark.range(0, 4000, 1, 4).select(F.col("id").cast("string").alias("file_id"), F.lit(0).cast("bigint").alias("chunk_index"), F.concat_ws(" ", F.lit("the"), F.concat(F.lit("w"), "id")).alias("text")))
    held = spark.read.parquet(f"{engine.catalog.folder('t')}/postings/batch={c.live[0]}").withColumn("file", F.input_file_name())
    assert held.where("term = 'the'").select("file").distinct().count() > 1
    files = {}
    for r in held.select("file", "term", "chunk_id", F.monotonically_increasing_id().alias("n")).orderBy("n").collect():
        files.setdefault(r.file, []).append((r.term, r.chunk_id))
    assert all(rows == sorted(rows) for rows in files.values()) and sum(map(len, files.values())) == 8000


def test_a_vector_is_measured_once(spark):
    """Its length doesn't depend on the element: 20 vectors of 4,000 took 320 million products."""
    rows = spark.range(20).select(F.transform(F.sequence(F.lit(1), F.lit(4000)), lambda x: (x + F.col("id")).cast("float")).alias("v"))
    began = time.monotonic()
    got = rows.select(V.normalised(F.col("v")).alias("v")).collect()
    assert time.monotonic() - began < 5
    want = np.arange(1, 4001)
    assert got[0].v == pytest.approx((want / np.linalg.norm(want)).tolist(), rel=1e-5)
    odd = spark.createDataFrame([([0.0, 0.0],), ([3.0, 4.0],), ([],), (None,)], "v array<float>").select(V.normalised(F.col("v")).alias("v")).collect()
    assert [r.v for r in odd] == [[0.0, 0.0], pytest.approx([0.6, 0.8]), [], None]


def test_auto_embedding_and_rebuild(spark, tmp_path):
    e = Engine(spark, f"{tmp_path}/d", StaticEmbedder(TABLE))
    e.create_collection("t", embedding_dims=3)
    e.ingest("t", [chunk(0, "red"), chunk(1, "green apple", embedding=[1.0, 0.0, 0.0]), chunk(2, "unknown")])
    held = lambda: {r.chunk_id: [round(x, 3) for x in r.embedding] for r in e.store.vectors(e.catalog.need("t"), "default").collect()}
    assert held() == {0: [1, 0, 0], 1: [1, 0, 0]}
    assert e.search("t", {"query": "red", "mode": "semantic"})["total"] == 2
    assert e.rebuild_status("t", "default")["percent"] == 100.0
    r = e.rebuild("t", "default")
    assert (r["status"], r["embedded"], r["total"]) == ("done", 2, 3) and r["percent"] == pytest.approx(66.666, abs=0.01)
    assert held() == {0: [1, 0, 0], 1: [0, 0.707, 0.707]}
    e.add_vector_space("t", "second", 3)
    assert e.rebuild("t", "second")["embedded"] == 2 and e.catalog.need("t").vector_spaces["second"].status == "active"
    with pytest.raises(NotFound):
        e.rebuild("t", "third")
    c = e.catalog.need("t")
    c.rebuilds["default"] = {"status": "running", "embedded": 1, "total": 3}
    e.catalog.save(c)
    with pytest.raises(CollectionError):
        e.rebuild("t", "default")
    e.clean_rebuilds("t")
    assert e.rebuild_status("t", "default")["status"] == "failed" and held()[1] == [0, 0.707, 0.707]
    assert percent(0, 0) == 0.0


def test_inverted_file_backend(hundred):
    hundred.build_inverted_file("t", n_lists=5, n_probe=5)
    r = hundred.search("t", {"query": "x", "mode": "semantic", "vector": unit(3), "top_k": 4, "explain": True})
    assert r["explain"]["engine"] == "ivf" and 4 <= r["explain"]["candidates_inspected"] <= 100 and r["results"][0]["id"] == max(range(100), key=lambda i: float(np.dot(unit(i + 1), unit(3))))
    hundred.drop_inverted_file("t")


def test_json_lines(engine, tmp_path):
    lines = [{**chunk(0), "metadata": {"a": 3, "b": 3.0}}, {**chunk(1), "client_id": "k", "doc_type": "source"}, {**chunk(2), "parent_ref": "k"}]
    (tmp_path / "in.json").write_text("".join(json.dumps(x) + "\n" for x in lines))
    engine.create_collection("t")
    engine.ingest_json("t", str(tmp_path / "in.json"))
    got = engine.get_chunks("t", range(3))
    by = {g["file_id"]: g for g in got}
    assert by["f0"]["metadata"] == {"a": 3, "b": 3.0} and isinstance(by["f0"]["metadata"]["b"], float) and by["f2"]["parent_id"] == by["f1"]["id"]


def test_large_frames_get_dense_ids(spark, engine):
    engine.create_collection("t", config={"analyzer": "simple"})
    rows = spark.range(0, 5000, 1, 7).select(F.concat(F.lit("f"), "id").alias("file_id"), F.lit(0).cast("bigint").alias("chunk_index"), F.lit("a b").alias("text"), (4999 - F.col("id")).alias("ordinal"))
    engine.ingest_frame("t", rows)
    engine.ingest_frame("t", rows.drop("ordinal"))
    ids = engine.chunks("t").select("id", "file_id").collect()
    assert sorted(r.id for r in ids) == list(range(10_000))
    assert all(r.file_id == f"f{4999 - r.id}" for r in ids if r.id < 5000)


def test_streams(spark, engine, tmp_path):
    engine.create_collection("t", config={"analyzer": "simple"})
    schema = "file_id string, chunk_index bigint, text string"

    def add(k):
        spark.createDataFrame([(f"f{k}", 0, f"word{k}")], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    def run():
        rows = spark.readStream.schema(schema).parquet(f"{tmp_path}/in").withColumn("metadata", M.metadata_of(f=("string", F.col("file_id"))))
        stream_into(engine, "t", rows, f"{tmp_path}/state").awaitTermination()

    add(0)
    run()
    add(1)
    run()
    run()
    assert sorted(r.text for r in engine.chunks("t").collect()) == ["word0", "word1"] and engine.catalog.need("t").next_id == 2


def test_two_streams_fill_one_collection(spark, engine, tmp_path, monkeypatch):
    """Each stream's micro-batches are counted apart; a crash before the save ingests the batch once, one after it not again."""
    engine.create_collection("t", config={"analyzer": "simple"})
    schema = "file_id string, chunk_index bigint, text string"

    def feed(stream, k):
        spark.createDataFrame([(f"{stream}{k}", 0, f"{stream}{k}")], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{stream}")

    def run(stream):
        stream_into(engine, "t", spark.readStream.schema(schema).parquet(f"{tmp_path}/{stream}"), f"{tmp_path}/state-{stream}").awaitTermination()

    for k in range(2):
        for s in ("a", "b"):
            feed(s, k)
            run(s)
    held = lambda: sorted(r.text for r in engine.chunks("t").collect())
    assert held() == ["a0", "a1", "b0", "b1"]
    save = engine.catalog.save
    feed("a", 2)
    for after in (False, True):

        def crash(c, after=after):
            if after:
                save(c)
            raise OSError("lost")

        monkeypatch.setattr(engine.catalog, "save", crash)
        with pytest.raises(Exception, match="lost"):
            run("a")
        monkeypatch.setattr(engine.catalog, "save", save)
        assert held() == ["a0", "a1"] + ["a2"] * after + ["b0", "b1"]
    run("a")
    run("b")
    assert held() == ["a0", "a1", "a2", "b0", "b1"] and len(engine.catalog.need("t").streams) == 2
    # The same folder for a new checkpoint is a new stream.
    engine.compact("t")
    assert held() == ["a0", "a1", "a2", "b0", "b1"] and len(engine.catalog.need("t").live) == 1


def test_compaction_keeps_everything(spark, engine):
    engine.create_collection("t", embedding_dims=4, config={"analyzer": "simple"})
    for k in range(3):
        engine.ingest("t", [chunk(10 * k + j, f"red word{k} {j}", embedding=unit(10 * k + j + 1), metadata={"k": k}) for j in range(4)])
    engine.add_vector_space("t", "late", 4)
    engine.ingest("t", [chunk(99, "red last", embeddings={"default": unit(99), "late": unit(98)})])
    ask = lambda: [engine.search("t", q)["results"] for q in ({"query": "red", "mode": "fts", "top_k": 20}, {"query": "red", "vector": unit(3), "top_k": 5}, {"query": "x", "mode": "semantic", "vector": unit(98), "vector_space": "late"})]
    before, facets = ask(), engine.facets("t")
    engine.compact("t")
    c = engine.catalog.need("t")
    assert len(c.live) == 1 and [len(v.live) for v in c.vector_spaces.values()] == [1, 1] and engine.catalog.files.folders(f"{engine.catalog.folder('t')}/chunks") == [f"batch={c.live[0]}"]
    assert ask() == before and engine.facets("t") == facets and engine.compact("t").batches == c.batches
    assert engine.ingest("t", [chunk(100, "red more", client_id="n")])["id_map"] == {"n": 13} and engine.chunks("t").count() == 14


def test_inverted_file_outlives_ingests_and_engines(spark, tmp_path):
    e = Engine(spark, f"{tmp_path}/d")
    e.create_collection("t", embedding_dims=8, config={"analyzer": "simple"})
    e.build_inverted_file("t", n_lists=6, n_probe=2)
    rows = [chunk(i, f"n{i}", embedding=unit(i + 1, 8), metadata={"even": i % 2 == 0}) for i in range(120)]
    e.ingest("t", rows[:60])
    again = Engine(spark, f"{tmp_path}/d")
    again.ingest("t", rows[60:])
    third = Engine(spark, f"{tmp_path}/d")
    for q in range(3):
        for filters, ids in (({}, range(120)), ({"even": True}, range(0, 120, 2))):
            r = third.search("t", {"query": "x", "mode": "semantic", "vector": unit(500 + q, 8), "top_k": 10, "filters": filters, "explain": True})
            want = sorted(ids, key=lambda i: -float(np.dot(unit(i + 1, 8), unit(500 + q, 8))))[:10]
            assert [h["id"] for h in r["results"]] == want and r["explain"]["engine"] == "ivf" and 10 <= r["explain"]["candidates_inspected"] <= 120
    third.drop_inverted_file("t")
    assert third.search("t", {"query": "x", "mode": "semantic", "vector": unit(1, 8), "explain": True})["explain"]["engine"] == "exact"


def test_shared_folder_on_a_cluster():
    from types import SimpleNamespace

    from tessera.sources.shared import shared_folder

    unset = SimpleNamespace(sparkContext=SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077", setCheckpointDir=lambda _: None), conf=SimpleNamespace(get=lambda *_: None))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(unset, "x")
    unset.sparkContext.master = "local[8]"
    assert shared_folder(unset, "x")


def test_reranker_and_clashes(spark, hundred):
    s = hundred.plan("t", SearchRequest("bears", mode="fts", top_k=3))
    s.sources.reranker = lambda query, rows: rows.withColumn("final_score", F.col("id").cast("double"))
    assert [r.id for r in s.hits().collect()] == sorted((r.chunk_id for r in s.candidates().collect()), reverse=True)[:3]
    s.sources.chunks = s.sources.chunks.withColumn("source", F.lit("x"))
    with pytest.raises(ValueError):
        type(s)(s.sources, s.request)
