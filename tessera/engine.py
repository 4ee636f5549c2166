"""The engine: collections that are created, filled, searched, counted and rebuilt."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import asdict
from datetime import datetime
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import metavalue as M
from tessera.functions.embedding import Embedder, embed_column
from tessera.operators import facets, relations
from tessera.operators.vectors import IndexParams, InvertedFile, VectorBackend
from tessera.plans.search import Search, SearchRequest, Sources, collected
from tessera.sources.catalog import Catalog, Collection, CollectionError, NotFound, VectorSpace
from tessera.sources.store import INPUT, VECTORS, Store, rows_of


class Engine:
    def __init__(self, spark: SparkSession, root: str, embedder: Embedder | None = None):
        self.spark, self.embedder = spark, embedder
        self.catalog = Catalog(spark, root)
        self.store = Store(spark, self.catalog)
        self._backends: dict[tuple[str, int], VectorBackend] = {}

    # --- collections and spaces

    def create_collection(self, name: str, vector_spaces: Mapping[str, Mapping[str, Any]] | None = None, embedding_dims: int | None = None, config: dict | None = None) -> Collection:
        spaces = {k: VectorSpace(**v) for k, v in (vector_spaces or {}).items()}
        return self.catalog.create(name, spaces or None, embedding_dims, config)

    def list_collections(self) -> list[Collection]:
        return self.catalog.list()

    def get_collection(self, name: str) -> Collection | None:
        return self.catalog.get(name)

    def delete_collection(self, name: str) -> None:
        self.catalog.delete(name)

    def add_vector_space(self, name: str, space: str, dims: int, model: str = "bge-small-en-v1.5") -> VectorSpace:
        return self.catalog.add_space(name, space, dims, model)

    def list_vector_spaces(self, name: str) -> list[dict[str, Any]]:
        c = self.catalog.need(name)
        return [{"name": k, "dims": s.dims, "model": s.model, "status": s.status, "is_default": k == c.default_vector_space} for k, s in c.vector_spaces.items()]

    def delete_vector_space(self, name: str, space: str) -> None:
        self.catalog.delete_space(name, space)

    def set_default_vector_space(self, name: str, space: str) -> None:
        self.catalog.set_default_space(name, space)

    # --- ingest

    def ingest(self, name: str, chunks: Iterable[Mapping[str, Any]]) -> dict[str, Any]:
        """Request objects; returns the number of chunks, ids by client id, and the time taken."""
        began = time.monotonic()
        rows = rows_of([dict(c) for c in chunks])
        frame = self.spark.createDataFrame([tuple(r[f] for f in INPUT.names) for r in rows], INPUT)
        before = self.catalog.need(name).chunk_count
        after, ids = self._append(name, frame)
        return {"indexed": after.chunk_count - before, "id_map": {r.client_id: r.id for r in ids.collect()}, "took_ms": int(1000 * (time.monotonic() - began))}

    def ingest_frame(self, name: str, rows: DataFrame, stream: tuple[str, int] | None = None) -> Collection:
        """A DataFrame of any size with file_id, chunk_index, text and, as wanted, the other fields of a chunk.

        stream: a stream's id and the number of its micro-batch, which is ingested once.
        """
        return self._append(name, rows, stream)[0]

    def compact(self, name: str) -> Collection:
        """All batches as one; an inverted file stays as it is."""
        with self.store.lock(name):
            return self.store.compact(self.catalog.need(name))

    def ingest_json(self, name: str, path: str) -> Collection:
        """JSON lines of request objects; metadata keeps 3 and 3.0 apart."""
        lines = self.spark.read.text(path)
        plain = [f for f in INPUT.fields if f.name not in ("ordinal", "metadata")]
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plain) + ", metadata map<string,variant>"
        parsed = lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")
        return self._append(name, parsed.withColumn("metadata", M.typed(F.col("metadata"))))[0]

    def _append(self, name: str, rows: DataFrame, stream: tuple[str, int] | None = None) -> tuple[Collection, DataFrame]:
        with self.store.lock(name):
            c = self.catalog.need(name)
            if stream is not None and stream[1] <= c.streams.get(stream[0], -1):
                return c, self.spark.createDataFrame([], "client_id string, id bigint")
            default = c.vector_spaces.get(c.default_vector_space or "")
            fits = self.embedder is not None and default is not None and self.embedder.dims == default.dims
            return self.store.append(c, rows, (lambda text: embed_column(text, self.embedder)) if fits else None, stream)

    # --- queries

    def chunks(self, name: str) -> DataFrame:
        return self.store.chunks(self.catalog.need(name))

    def get_chunks(self, name: str, ids: Sequence[int]) -> list[dict[str, Any]]:
        return collected(self.store.get(self.catalog.need(name), ids).orderBy("id"))

    def sources(self, name: str) -> Sources:
        c = self.catalog.need(name)

        def vectors(space: str) -> VectorBackend | DataFrame | None:
            if space not in c.vector_spaces:
                return None
            held = c.vector_spaces[space].index
            return self._backend(held["folder"], c.batches) if held else self.store.vectors(c, space)

        return Sources(self.store.chunks(c), self.store.full_text(c), vectors, c.default_vector_space or "default", self.embedder)

    def plan(self, name: str, request: SearchRequest | Mapping[str, Any], now: datetime | Column | None = None) -> Search:
        return Search(self.sources(name), request if isinstance(request, SearchRequest) else SearchRequest.of(request), now)

    def search(self, name: str, request: SearchRequest | Mapping[str, Any], now: datetime | None = None) -> dict[str, Any]:
        began = time.monotonic()
        s = self.plan(name, request, now)
        results = collected(s.hits())
        out = {"results": results, "total": len(results), "took_us": int(1e6 * (time.monotonic() - began)), "mode": s.request.mode}
        if s.request.explain:
            out["explain"] = asdict(s.explain())
        return out

    def facets(self, name: str, query: str | None = None, fields: Sequence[str] = ()) -> dict[str, dict[str, int]]:
        c = self.catalog.need(name)
        if not c.chunk_count:
            return {f: {} for f in fields}
        matched = None if query is None or query.strip() in ("", "*") else self.store.full_text(c).matches(query)
        return facets.as_mapping(facets.facet_counts(self.store.chunks(c), fields, matched), fields)

    def segments_at(self, name: str, asset: str, time_ms: float | None = None, time_start_ms: float | None = None, time_end_ms: float | None = None) -> list[dict[str, Any]]:
        return collected(relations.segments_at(self.chunks(name), asset, time_ms, time_start_ms, time_end_ms))

    def build_inverted_file(self, name: str, space: str | None = None, **params: Any) -> InvertedFile:
        """A stored inverted file for a space; every engine uses it, ingests extend it, a rebuild of the space drops it."""
        with self.store.lock(name):
            c = self.catalog.need(name)
            space = space or c.default_vector_space or "default"
            v = c.vector_spaces[space]
            folder = f"{self.catalog.folder(name)}/ivf/{space}/v{v.version}-{c.batches}"
            self.catalog.files.delete(folder)
            built = InvertedFile.build(self.store.vectors(c, space), folder, IndexParams(dims=v.dims, **params))
            built.save(self.catalog.files)
            old, v.index = v.index, {"folder": folder, **asdict(built.params)}
            self.catalog.save(c)
            if old and old["folder"] != folder:
                self.catalog.files.delete(old["folder"])
            return built

    def drop_inverted_file(self, name: str, space: str | None = None) -> None:
        with self.store.lock(name):
            c = self.catalog.need(name)
            v = c.vector_spaces[space or c.default_vector_space or "default"]
            old, v.index = v.index, None
            self.catalog.save(c)
            if old:
                self.catalog.files.delete(old["folder"])

    def _backend(self, folder: str, batches: int) -> VectorBackend:
        """The inverted file as the last ingest left it."""
        if (folder, batches) not in self._backends:
            self._backends = {k: v for k, v in self._backends.items() if k[0] != folder}
            self._backends[folder, batches] = InvertedFile.open(self.spark, self.catalog.files, folder, batches)
        return self._backends[folder, batches]

    # --- rebuild

    def rebuild(self, name: str, space: str, embedder: Embedder | None = None, batch_size: int = 64) -> dict[str, Any]:
        """Embeds every chunk's text anew into a new version of the space's folder, then switches to it.

        Chunks whose text has no vector are counted as failed and have none afterwards.
        """
        c, embedder = self.check_rebuild(name, space, embedder)
        v = c.vector_spaces[space]
        c.rebuilds[space] = {"status": "running", "embedded": 0, "total": c.chunk_count}
        self.catalog.save(c)
        try:
            version = v.version + 1
            base = f"{self.catalog.folder(name)}/vectors/{space}/v{version}"
            self.catalog.files.delete(base)
            # All batches in one job, as one batch.
            new = self.store.chunks(c).select(F.col("id").alias("chunk_id"), embed_column(F.col("text"), embedder, batch_size).alias("embedding")).where("embedding is not null")
            new.write.parquet(f"{base}/batch={c.batches}")
            embedded = self.spark.read.schema(VECTORS).parquet(f"{base}/batch={c.batches}").count()
            old, v.index = v.index, None
            v.version, v.status, v.live = version, "active", [c.batches]
            c.batches += 1
            c.rebuilds[space] = {"status": "done", "embedded": embedded, "total": c.chunk_count}
            self.catalog.save(c)
            self.catalog.files.delete(f"{self.catalog.folder(name)}/vectors/{space}/v{version - 1}")
            if old:
                self.catalog.files.delete(old["folder"])
        except BaseException:
            c = self.catalog.need(name)
            c.rebuilds[space] = {**c.rebuilds.get(space, {}), "status": "failed"}
            self.catalog.save(c)
            raise
        return self.rebuild_status(name, space)

    def check_rebuild(self, name: str, space: str, embedder: Embedder | None = None) -> tuple[Collection, Embedder]:
        """The collection and the embedder that a rebuild of the space would use, or an error."""
        c = self.catalog.need(name)
        if space not in c.vector_spaces:
            raise NotFound(f"{name!r} has no vector space {space!r}")
        if c.rebuilds.get(space, {}).get("status") == "running":
            raise CollectionError(f"{space!r} is being rebuilt")
        embedder = embedder or self.embedder
        if embedder is None or embedder.dims != c.vector_spaces[space].dims:
            raise CollectionError("a rebuild needs an embedder of the space's dimensions")
        return c, embedder

    def rebuild_status(self, name: str, space: str) -> dict[str, Any]:
        """Progress of the last rebuild; a space that had none is complete."""
        c = self.catalog.need(name)
        if space not in c.vector_spaces:
            raise NotFound(f"{name!r} has no vector space {space!r}")
        r = c.rebuilds.get(space) or {"status": c.vector_spaces[space].status, "embedded": c.chunk_count, "total": c.chunk_count}
        done = 100.0 if space not in c.rebuilds else percent(r["embedded"], r["total"])
        return {**r, "percent": done}

    def clean_rebuilds(self, name: str) -> None:
        """After a crash: running rebuilds are marked as failed and their folders removed."""
        c = self.catalog.need(name)
        for space, r in c.rebuilds.items():
            if r["status"] == "running":
                r["status"] = "failed"
                self.catalog.files.delete(f"{self.catalog.folder(name)}/vectors/{space}/v{c.vector_spaces[space].version + 1}")
        self.catalog.save(c)

    def health(self) -> dict[str, Any]:
        held = self.catalog.list()
        return {"status": "ok", "collections": len(held), "chunks": sum(c.chunk_count for c in held)}


def percent(embedded: int, total: int) -> float:
    return 100.0 * embedded / total if total else 0.0


Reranker = Callable[[str, DataFrame], DataFrame]
