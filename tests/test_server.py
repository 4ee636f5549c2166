"""The HTTP paths: statuses, values, and the bearer token."""

import json
import time
import urllib.error
import urllib.request

import pytest

from tessera.engine import Engine
from tessera.functions.embedding import StaticEmbedder
from tessera.server import Api, allowed, serve


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    return Engine(spark, str(tmp_path_factory.mktemp("http")), StaticEmbedder({"red": [1, 0], "green": [0, 1]}))


@pytest.fixture(scope="module")
def server(engine):
    s = serve(engine, key="sesame")
    yield s
    s.shutdown()


def ask(server, method, path, body=None, key="sesame"):
    data = None if body is None else json.dumps(body).encode()
    r = urllib.request.Request(f"http://127.0.0.1:{server.server_port}{path}", data, method=method, headers={"Authorization": f"Bearer {key}"} if key else {})
    try:
        with urllib.request.urlopen(r) as f:
            raw = f.read()
            return f.status, json.loads(raw) if raw else None
    except urllib.error.HTTPError as e:
        return e.code, json.loads(e.read())


def test_tokens(server):
    assert allowed(None, None) and allowed("Bearer x", "x") and not allowed("Bearer xy", "x") and not allowed(None, "x") and not allowed("x", "x")
    assert ask(server, "GET", "/health", key=None)[0] == 200
    assert ask(server, "GET", "/collections", key=None)[0] == 401 and ask(server, "GET", "/collections", key="wrong")[0] == 401
    assert ask(server, "GET", "/nowhere")[0] == 404 and ask(server, "PUT", "/collections", {})[0] == 405


def test_every_path(server, engine):
    assert ask(server, "POST", "/collections", {"name": "c", "embedding_dims": 2})[0] == 201
    assert ask(server, "POST", "/collections", {"name": "c"})[0] == 400 and ask(server, "POST", "/collections", {"name": "../c"})[0] == 400 and ask(server, "POST", "/collections", {})[0] == 400
    chunks = [
        {"client_id": "src", "file_id": "f", "chunk_index": 0, "text": "red source", "doc_type": "source", "metadata": {"k": "a"}},
        {"client_id": "s1", "parent_ref": "src", "file_id": "f", "chunk_index": 1, "text": "green segment", "doc_type": "segment", "group_id": "asset", "metadata": {"k": "b", "timerange_start_ms": 100, "timerange_end_ms": 200}},
    ]
    status, r = ask(server, "POST", "/collections/c/ingest", {"chunks": chunks})
    assert status == 200 and r["indexed"] == 2 and r["id_map"] == {"src": 0, "s1": 1}
    assert ask(server, "POST", "/collections/none/ingest", {"chunks": chunks})[0] == 404 and ask(server, "POST", "/collections/c/ingest", {"chunks": [{"text": "x"}]})[0] == 400
    assert ask(server, "GET", "/collections/c")[1]["chunk_count"] == 2 and ask(server, "GET", "/collections/none")[0] == 404
    assert [c["name"] for c in ask(server, "GET", "/collections")[1]] == ["c"]
    status, r = ask(server, "POST", "/collections/c/search", {"query": "green", "top_k": 1})
    assert status == 200 and r["results"][0]["id"] == 1 and r["results"][0]["parent_metadata"] == {"k": "a"}
    assert ask(server, "POST", "/collections/c/search", {"query": "green", "top_k": 0})[0] == 400 and ask(server, "POST", "/collections/none/search", {"query": "x"})[0] == 404
    assert ask(server, "GET", "/collections/c/facets?fields=k&query=red")[1] == {"k": {"a": 1}}
    assert [s["id"] for s in ask(server, "GET", "/collections/c/segments/at?asset_id=asset&time_ms=150")[1]] == [1]
    assert ask(server, "GET", "/collections/c/segments/at?asset_id=asset&time_ms=250")[1] == [] and ask(server, "GET", "/collections/c/segments/at?time_ms=1")[0] == 400
    assert ask(server, "POST", "/collections/c/vector-spaces", {"name": "two", "dims": 2})[1]["status"] == "building"
    assert ask(server, "POST", "/collections/c/vector-spaces/two/rebuild", {})[0] == 202 and ask(server, "POST", "/collections/c/vector-spaces/three/rebuild", {})[0] == 404
    for _ in range(200):
        if (done := ask(server, "GET", "/collections/c/vector-spaces/two/status")[1])["status"] == "done":
            break
        time.sleep(0.2)
    assert done["embedded"] == 2
    assert ask(server, "PUT", "/collections/c/default-vector-space", {"vector_space": "two"})[1]["default_vector_space"] == "two"
    assert ask(server, "DELETE", "/collections/c/vector-spaces/two")[0] == 400 and ask(server, "DELETE", "/collections/c/vector-spaces/default") == (204, None)
    assert [s["name"] for s in ask(server, "GET", "/collections/c/vector-spaces")[1]] == ["two"]
    assert ask(server, "DELETE", "/collections/c") == (204, None) and ask(server, "DELETE", "/collections/c")[0] == 404


def test_faults_are_answers(engine, monkeypatch):
    api = Api(engine)
    assert api.answer("POST", "/collections", b"{")[0] == 400

    def broken():
        raise RuntimeError("no disk")

    monkeypatch.setattr(engine, "list_collections", broken)
    assert api.answer("GET", "/collections") == (500, {"error": "no disk"})
