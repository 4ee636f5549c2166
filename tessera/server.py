"""The engine over HTTP, for clients that speak JSON: `serve(engine, port, key)`.

One process serves requests on threads; each becomes a Spark job of the engine's session. With a
key every path but /health asks for it as a bearer token, compared in constant time.
"""

from __future__ import annotations

import hmac
import json
import re
from collections.abc import Callable
from dataclasses import asdict
from datetime import date, datetime
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from threading import Thread
from typing import Any
from urllib.parse import parse_qs, unquote, urlsplit

from tessera.engine import Engine
from tessera.sources.catalog import Collection, NotFound

LARGEST_BODY = 64 << 20
Answer = tuple[int, Any]


class HttpError(Exception):
    def __init__(self, status: int, text: str):
        super().__init__(text)
        self.status = status


def allowed(header: str | None, key: str | None) -> bool:
    """Whether the header carries the key; without a key all may pass."""
    return key is None or hmac.compare_digest((header or "").encode(), f"Bearer {key}".encode())


def described(c: Collection) -> dict[str, Any]:
    spaces = {n: {"dims": s.dims, "model": s.model, "status": s.status} for n, s in c.vector_spaces.items()}
    return {"name": c.name, "created_at": c.created_at, "chunk_count": c.chunk_count, "vector_spaces": spaces, "default_vector_space": c.default_vector_space}


class Api:
    """Requests to answers (status, JSON value); no sockets, so that it can be asked directly."""

    def __init__(self, engine: Engine, key: str | None = None):
        self.engine, self.key = engine, key
        one, space = r"/collections/([^/]+)", r"/collections/([^/]+)/vector-spaces/([^/]+)"
        self.routes: list[tuple[str, re.Pattern[str], Callable[..., Answer]]] = [
            (method, re.compile(path), call)
            for method, path, call in (
                ("GET", "/health", self.health),
                ("GET", "/collections", self.list),
                ("POST", "/collections", self.create),
                ("GET", one, self.get),
                ("DELETE", one, self.delete),
                ("GET", f"{one}/vector-spaces", self.spaces),
                ("POST", f"{one}/vector-spaces", self.add_space),
                ("DELETE", space, self.delete_space),
                ("POST", f"{space}/rebuild", self.rebuild),
                ("GET", f"{space}/status", self.status),
                ("PUT", f"{one}/default-vector-space", self.set_default),
                ("POST", f"{one}/ingest", self.ingest),
                ("POST", f"{one}/search", self.search),
                ("GET", f"{one}/facets", self.facets),
                ("GET", f"{one}/segments/at", self.segments),
            )
        ]

    def answer(self, method: str, target: str, body: bytes = b"", authorization: str | None = None) -> Answer:
        parts = urlsplit(target)
        query = {k: v[-1] for k, v in parse_qs(parts.query).items()}
        if parts.path != "/health" and not allowed(authorization, self.key):
            return 401, {"error": "a valid bearer token is needed"}
        found = [(m, call, match) for m, pattern, call in self.routes if (match := pattern.fullmatch(parts.path))]
        if not found:
            return 404, {"error": f"there is nothing at {parts.path}"}
        for m, call, match in found:
            if m == method:
                try:
                    sent = json.loads(body) if body else {}
                    return call(*map(unquote, match.groups()), sent if method in ("POST", "PUT") else query)
                except NotFound as e:
                    return 404, {"error": str(e)}
                except HttpError as e:
                    return e.status, {"error": str(e)}
                except (ValueError, KeyError, TypeError) as e:  # CollectionError is a ValueError
                    return 400, {"error": str(e)}
                except Exception as e:
                    return 500, {"error": str(e)[:500]}
        return 405, {"error": f"{method} isn't served at {parts.path}"}

    def health(self, _: dict) -> Answer:
        return 200, self.engine.health()

    def list(self, _: dict) -> Answer:
        return 200, [described(c) for c in self.engine.list_collections()]

    def create(self, body: dict) -> Answer:
        return 201, described(self.engine.create_collection(body["name"], body.get("vector_spaces"), body.get("embedding_dims"), body.get("config")))

    def get(self, name: str, _: dict) -> Answer:
        return 200, described(self.engine.catalog.need(name))

    def delete(self, name: str, _: dict) -> Answer:
        self.engine.delete_collection(name)
        return 204, None

    def spaces(self, name: str, _: dict) -> Answer:
        return 200, self.engine.list_vector_spaces(name)

    def add_space(self, name: str, body: dict) -> Answer:
        more = {"model": body["model"]} if body.get("model") else {}
        return 201, asdict(self.engine.add_vector_space(name, body["name"], body["dims"], **more))

    def delete_space(self, name: str, space: str, _: dict) -> Answer:
        self.engine.delete_vector_space(name, space)
        return 204, None

    def set_default(self, name: str, body: dict) -> Answer:
        self.engine.set_default_vector_space(name, body["vector_space"])
        return 200, described(self.engine.catalog.need(name))

    def rebuild(self, name: str, space: str, body: dict) -> Answer:
        """Starts it and returns; its status is asked for."""
        status = self.engine.rebuild_status(name, space)
        if status["status"] == "running":
            raise HttpError(409, f"{space!r} is being rebuilt")
        self.engine.check_rebuild(name, space)
        Thread(target=self.engine.rebuild, args=(name, space, None, int(body.get("batch_size") or 64)), daemon=True).start()
        return 202, {"status": "started", "vector_space": space}

    def status(self, name: str, space: str, _: dict) -> Answer:
        return 200, self.engine.rebuild_status(name, space)

    def ingest(self, name: str, body: dict) -> Answer:
        self.engine.catalog.need(name)
        return 200, self.engine.ingest(name, body["chunks"])

    def search(self, name: str, body: dict) -> Answer:
        return 200, self.engine.search(name, body)

    def facets(self, name: str, query: dict) -> Answer:
        return 200, self.engine.facets(name, query.get("query"), [f for f in query.get("fields", "").split(",") if f])

    def segments(self, name: str, query: dict) -> Answer:
        times = {k: float(query[k]) for k in ("time_ms", "time_start_ms", "time_end_ms") if k in query}
        return 200, self.engine.segments_at(name, query["asset_id"], **times)


def as_json(value: Any) -> Any:
    if isinstance(value, (date, datetime)):
        return value.isoformat()
    raise TypeError(f"{type(value)} isn't sent")


def serve(engine: Engine, port: int = 0, key: str | None = None, host: str = "127.0.0.1") -> ThreadingHTTPServer:
    """A server on a thread of its own; port 0 takes a free one (`server_port`), `shutdown()` ends it."""
    api = Api(engine, key)

    class Handler(BaseHTTPRequestHandler):
        protocol_version = "HTTP/1.1"

        def _any(self) -> None:
            size = int(self.headers.get("Content-Length") or 0)
            if size > LARGEST_BODY:
                self.close_connection = True
                return self._send(413, {"error": f"a body has {LARGEST_BODY} bytes at most"})
            body = self.rfile.read(size)
            self._send(*api.answer(self.command, self.path, body, self.headers.get("Authorization")))

        def _send(self, status: int, value: Any) -> None:
            data = b"" if value is None else json.dumps(value, default=as_json).encode()
            self.send_response(status)
            self.send_header("Access-Control-Allow-Origin", "*")
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_OPTIONS(self) -> None:
            self.send_response(204)
            for k, v in (("Origin", "*"), ("Methods", "GET, POST, PUT, DELETE"), ("Headers", "Authorization, Content-Type")):
                self.send_header(f"Access-Control-Allow-{k}", v)
            self.send_header("Content-Length", "0")
            self.end_headers()

        do_GET = do_POST = do_PUT = do_DELETE = _any

        def log_message(self, *_: Any) -> None:
            pass

    server = ThreadingHTTPServer((host, port), Handler)
    Thread(target=server.serve_forever, daemon=True).start()
    return server
