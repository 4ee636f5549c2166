"""Hybrid search as one plan: filter, retrieve, fuse, score, cut, enrich."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import metavalue as M
from tessera.functions.embedding import Embedder, embed_query
from tessera.operators.fts import FullText, TextScan
from tessera.operators.fusion import reciprocal_rank_fusion, top
from tessera.operators.relations import parent_metadata
from tessera.operators.scoring import Boost, Recency, RelationshipBoost, score_candidates
from tessera.operators.vectors import Exact, VectorBackend
from tessera.plans.filters import Fields, compile_filters, selectivity
from tessera.sources.shared import shared_folder

MODES = ("fts", "semantic", "hybrid")
OVERFETCH = 3


@dataclass
class SearchRequest:
    query: str
    mode: str = "hybrid"
    vector_space: str | None = None
    top_k: int = 10
    query_vector: Sequence[float] | None = None
    filters: Mapping[str, Any] = field(default_factory=dict)
    rrf_k: float = 60.0
    fts_weight: float = 1.0
    semantic_weight: float = 1.0
    recency: Recency | None = None
    recency_preset: str | None = None
    recency_field: str | None = None
    boosts: Sequence[Boost] = ()
    relationship_boost: RelationshipBoost | None = None
    explain: bool = False
    #: "pre": the filter holds before the text search is cut to its best; "post": after.
    filter_mode: str = "pre"
    strict_contains: bool = False

    def __post_init__(self) -> None:
        if not 1 <= self.top_k <= 1000:
            raise ValueError("top_k is from 1 to 1000")
        if self.rrf_k <= 0:
            raise ValueError("rrf_k must be above 0")
        if self.filter_mode not in ("pre", "post"):
            raise ValueError("filter_mode is pre or post")

    @property
    def kind(self) -> str:
        mode = self.mode.lower()
        return mode if mode in MODES else "hybrid"

    @property
    def decay(self) -> Recency | None:
        return self.recency or Recency.preset(self.recency_preset, self.recency_field)

    @staticmethod
    def of(request: Mapping[str, Any]) -> SearchRequest:
        """From a request object with nested mappings; `vector` stands for query_vector."""
        r = dict(request)
        if "vector" in r:
            r["query_vector"] = r.pop("vector")
        r |= dict(r.pop("score_weights", None) or {})
        if r.get("recency") is not None:
            r["recency"] = Recency(**r["recency"])
        r["boosts"] = [Boost(**b) for b in r.get("boosts") or ()]
        if r.get("relationship_boost") is not None:
            r["relationship_boost"] = RelationshipBoost(**r["relationship_boost"])
        return SearchRequest(**{k: v for k, v in r.items() if v is not None})


@dataclass
class Explain:
    eligible_count: int
    universe_count: int
    selectivity: float
    engine: str
    candidates_inspected: int | None = None


@dataclass
class Sources:
    """What a search reads: chunks (with metadata), the text index, and vectors by space."""

    chunks: DataFrame
    full_text: FullText | None
    vectors: Callable[[str], VectorBackend | DataFrame | None]
    default_space: str = "default"
    embedder: Embedder | None = None
    fields: Fields = field(default_factory=Fields)
    reranker: Callable[[str, DataFrame], DataFrame] | None = None


class Search:
    def __init__(self, sources: Sources, request: SearchRequest, now: datetime | Column | None = None):
        if clash := {"chunk_id", "base_score", "source", "score"} & set(sources.chunks.columns):
            raise ValueError(f"the search's own columns {sorted(clash)} are in the chunks; rename them there")
        self.sources, self.request = sources, request
        self.now = now if now is not None else datetime.now(UTC).replace(tzinfo=None)
        self.condition = compile_filters(request.filters, sources.fields, request.strict_contains)
        self.eligible = None if self.condition is None else sources.chunks.where(self.condition).select(F.col("id").alias("chunk_id"))
        self.budget = OVERFETCH * request.top_k

    def fts(self) -> DataFrame | None:
        if self.request.kind == "semantic" or self.sources.full_text is None:
            return None
        if self.request.filter_mode == "pre":
            index = self.sources.full_text
            if isinstance(index, TextScan) and index.chunks is self.sources.chunks:
                return index.search(self.request.query, self.budget, condition=self.condition)
            return index.search(self.request.query, self.budget, self.eligible)
        found = self.sources.full_text.search(self.request.query, self.budget)
        return found if self.eligible is None else found.join(self.eligible, "chunk_id", "left_semi")

    def _backend(self) -> VectorBackend | None:
        if self.request.kind == "fts":
            return None
        found = self.sources.vectors(self.request.vector_space or self.sources.default_space)
        return Exact(found) if isinstance(found, DataFrame) else found

    def semantic(self) -> DataFrame | None:
        """None without a space of that name, or without a vector for the query."""
        if (backend := self._backend()) is None:
            return None
        vector = self.request.query_vector or embed_query(self.sources.embedder, self.request.query)
        return None if vector is None else backend.search(vector, self.budget, self.eligible)

    def candidates(self) -> DataFrame:
        """(chunk_id, base_score, source), a few times top_k rows at most."""
        r, fts, semantic = self.request, self.fts(), self.semantic()
        empty = self.sources.chunks.sparkSession.createDataFrame([], "chunk_id bigint, score double")
        if r.kind == "hybrid":
            return reciprocal_rank_fusion(empty if fts is None else fts, empty if semantic is None else semantic, self.budget, r.rrf_k, r.fts_weight, r.semantic_weight)
        only = fts if r.kind == "fts" else semantic
        return (empty if only is None else only).select("chunk_id", F.col("score").alias("base_score"), F.lit(r.kind).alias("source"))

    def ranked(self) -> DataFrame:
        """(chunk fields, base_score, score, source) of the best top_k."""
        r = self.request
        # Candidates are few: the chunks are read by a broadcast join on their ids.
        rows = self.sources.chunks.join(F.broadcast(self.candidates()), F.col("id") == F.col("chunk_id"))
        if r.decay or r.boosts or r.relationship_boost:
            rows = score_candidates(rows, self.now, r.decay, r.boosts, r.relationship_boost, self.sources.fields)
        else:
            rows = rows.withColumn("final_score", F.col("base_score"))
        if self.sources.reranker:
            rows = self.sources.reranker(r.query, rows)
        return top(rows, r.top_k, "final_score").withColumnRenamed("final_score", "score")

    def hits(self) -> DataFrame:
        """ranked() with parent_metadata, best first."""
        out = self.ranked()
        # At most top_k rows: written, so that finding their parents doesn't run the search again.
        spark, path = out.sparkSession, shared_folder(out.sparkSession, "hits")
        out.write.parquet(path)
        out = spark.read.schema(out.schema).parquet(path)
        if {"doc_type", "parent_id", "metadata"} <= set(out.columns):
            out = parent_metadata(out, self.sources.chunks, few=True)
        return out.drop("chunk_id").orderBy(F.desc("score"), "id")

    def explain(self) -> Explain:
        r = selectivity(self.sources.chunks, self.condition).first()
        backend = self._backend()
        if backend is None:
            return Explain(r.eligible, r.universe, r.selectivity, "none")
        # The exact scan scores every eligible vector; an index says how many its lists hold that it read.
        if isinstance(backend, Exact):
            rows = backend.vectors if self.eligible is None else backend.vectors.join(self.eligible, "chunk_id", "left_semi")
            return Explain(r.eligible, r.universe, r.selectivity, backend.name, rows.count())
        return Explain(r.eligible, r.universe, r.selectivity, backend.name, getattr(backend, "inspected", None))


def collected(hits: DataFrame) -> list[dict[str, Any]]:
    """Hits as plain objects, with Python values for metadata."""
    out = []
    for row in hits.collect():
        d = row.asDict()
        for name in ("metadata", "parent_metadata"):
            if name in d:
                d[name] = M.from_metadata(d[name])
        out.append(d)
    return out
