"""A collection's tables: chunks, vectors by space, postings and document lengths, all Parquet.

Ingest appends. A batch is written whole under its own number before the catalog lists it,
so a batch that failed half-way is never read. The catalog says which batches are read: no
folder is listed, and compaction replaces many by one.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterable, Sequence
from threading import RLock
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import metavalue as M
from tessera.functions import vector as V
from tessera.operators import fts
from tessera.operators.relations import resolve_parents
from tessera.operators.vectors import InvertedFile, check_dims
from tessera.sources.catalog import Catalog, Collection, CollectionError

CHUNK = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("collection", T.StringType()),
        T.StructField("file_id", T.StringType()),
        T.StructField("chunk_index", T.LongType()),
        T.StructField("page", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("metadata", M.METADATA),
        T.StructField("doc_type", T.StringType()),
        T.StructField("parent_id", T.LongType()),
        T.StructField("group_id", T.StringType()),
    ]
)
#: What ingest takes: the chunk without what the store sets, and references within the batch.
INPUT = T.StructType(
    [
        T.StructField("ordinal", T.LongType()),
        T.StructField("client_id", T.StringType()),
        T.StructField("parent_ref", T.StringType()),
        *(f for f in CHUNK.fields if f.name not in ("id", "collection")),
        T.StructField("embeddings", T.MapType(T.StringType(), T.ArrayType(T.FloatType()))),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
    ]
)
VECTORS = "chunk_id bigint, embedding array<float>"


def rows_of(chunks: Iterable[dict[str, Any]]) -> list[dict[str, Any]]:
    """Rows of INPUT from request objects."""
    known, out = {f.name for f in INPUT.fields} - {"ordinal"}, []
    for k, c in enumerate(chunks):
        if unknown := set(c) - known:
            raise CollectionError(f"a chunk has no {sorted(unknown)}")
        if c.get("file_id") is None or c.get("text") is None or c.get("chunk_index") is None:
            raise CollectionError("a chunk needs file_id, chunk_index and text")
        row = dict.fromkeys(f.name for f in INPUT.fields) | c
        row |= {"ordinal": k, "metadata": M.to_metadata(c.get("metadata")), "doc_type": c.get("doc_type") or "chunk"}
        row["embeddings"] = {s: [float(x) for x in v] for s, v in (c.get("embeddings") or {}).items()}
        row["embedding"] = None if c.get("embedding") is None else [float(x) for x in c["embedding"]]
        out.append(row)
    return out


#: One writer of a collection at a time, also where streams of one process fill it.
_LOCKS: defaultdict[str, RLock] = defaultdict(RLock)
_ROW = (1 << 33) - 1  # of monotonically_increasing_id: the row's number within its task


class Store:
    def __init__(self, spark: SparkSession, catalog: Catalog):
        self.spark, self.catalog = spark, catalog

    def lock(self, name: str) -> RLock:
        return _LOCKS[self.catalog.folder(name)]

    def _table(self, c: Collection, what: str, schema: T.StructType | str, live: Sequence[int]) -> DataFrame:
        paths = [f"{self.catalog.folder(c.name)}/{what}/batch={k}" for k in live]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def chunks(self, c: Collection) -> DataFrame:
        return self._table(c, "chunks", CHUNK, c.live)

    def get(self, c: Collection, ids: Sequence[int]) -> DataFrame:
        """Chunks by id; the ids reach the Parquet scan."""
        return self.chunks(c).where(F.col("id").isin([int(i) for i in ids]))

    def vectors(self, c: Collection, space: str) -> DataFrame:
        v = c.vector_spaces[space]
        return self._table(c, f"vectors/{space}/v{v.version}", VECTORS, v.live)

    def full_text(self, c: Collection) -> fts.FullText:
        held = self._table(c, "postings", fts.POSTINGS, c.live), self._table(c, "doc_stats", fts.DOC_STATS, c.live)
        return fts.FullText(self.chunks(c), *held, c.chunk_count, c.total_terms, c.config.get("analyzer", "english"))

    # --- ingest

    def numbered(self, rows: DataFrame, first: int, staged: str) -> DataFrame:
        """`rows` with dense ids from `first` on; by ordinal where there is one, else in the order of the tasks.

        The rows are written with their task's and their own number in it. An id is the task's
        start plus the row's number, so nothing is shuffled; the starts, one number a task, are broadcast.
        """
        if "ordinal" in rows.columns:
            rows = rows.repartitionByRange(F.col("ordinal").asc_nulls_last()).sortWithinPartitions(F.col("ordinal").asc_nulls_last())
        rows.withColumn("__at", F.monotonically_increasing_id()).write.parquet(staged)
        held = self.spark.read.parquet(staged)
        part = F.shiftright("__at", 33)
        sizes = held.groupBy(part.alias("part")).count().orderBy("part").collect()  # a row for each task
        starts = np.cumsum([first, *(r["count"] for r in sizes)])[:-1]
        table = self.spark.createDataFrame(pa.table({"__part": pa.array([r.part for r in sizes], pa.int64()), "__start": pa.array(starts, pa.int64())}))
        out = held.join(F.broadcast(table), part == F.col("__part"))
        return out.select((F.col("__start") + F.col("__at").bitwiseAND(F.lit(_ROW))).alias("id"), *rows.columns)

    def append(self, c: Collection, rows: DataFrame, embed=None, stream: tuple[str, int] | None = None) -> tuple[Collection, DataFrame]:
        """Writes a batch (INPUT without what isn't there); returns the collection and (client_id, id) of the batch.

        The batch counts from the one save of the catalog at the end, together with the stream's number.
        A text is written twice: staged with its row's number, and in its chunk.
        """
        folder, batch = self.catalog.folder(c.name), f"batch={c.batches}"
        for what in ("staged", "chunks", "postings", "doc_stats"):
            self.catalog.files.delete(f"{folder}/{what}/{batch}")
        for f in INPUT.fields:
            if f.name not in rows.columns and f.name != "ordinal":
                rows = rows.withColumn(f.name, F.lit(None).cast(f.dataType))
        numbered = self.numbered(rows, c.next_id, f"{folder}/staged/{batch}")
        # Vectors first: one of a wrong size or an unknown space ends the ingest.
        for s, space in c.vector_spaces.items():
            vectors = self._embedded(c, numbered, embed).select(F.col("id").alias("chunk_id"), F.col("embeddings")[s].alias("embedding")).where("embedding is not null").withColumn("embedding", V.normalised(F.col("embedding")))
            path = f"{folder}/vectors/{s}/v{space.version}/{batch}"
            self.catalog.files.delete(path)
            vectors.write.parquet(path)
            if space.index:
                InvertedFile.open(self.spark, self.catalog.files, space.index["folder"], c.batches).extend(self.spark.read.schema(VECTORS).parquet(path), batch)
        whole = resolve_parents(numbered).withColumns(
            {"collection": F.lit(c.name), "doc_type": F.coalesce("doc_type", F.lit("chunk")), "metadata": F.coalesce("metadata", F.create_map().cast(M.METADATA))}
        )
        whole.select(*CHUNK.names).write.parquet(f"{folder}/chunks/{batch}")
        chunks = self.spark.read.schema(CHUNK).parquet(f"{folder}/chunks/{batch}")
        self._index(chunks, c, batch)
        n, total = fts.corpus_counts(self.spark.read.schema(fts.DOC_STATS).parquet(f"{folder}/doc_stats/{batch}"))
        names = numbered.where("client_id is not null").groupBy("client_id").agg(F.max("id").alias("id"))
        names.write.mode("overwrite").parquet(f"{folder}/names/{batch}")
        c.chunk_count += n
        c.total_terms += total
        c.next_id += n
        c.live.append(c.batches)
        for space in c.vector_spaces.values():
            space.live.append(c.batches)
        c.batches += 1
        if stream is not None:
            c.streams[stream[0]] = stream[1]
        self.catalog.save(c)
        self.catalog.files.delete(f"{folder}/staged/{batch}")
        return c, self.spark.read.schema("client_id string, id bigint").parquet(f"{folder}/names/{batch}")

    def _embedded(self, c: Collection, rows: DataFrame, embed) -> DataFrame:
        """(id, embeddings) with the old single field and the embedder's vectors in the default space, and all checked."""
        none = F.create_map().cast("map<string,array<float>>")
        out = rows.withColumn("embeddings", F.coalesce("embeddings", none))
        if (default := c.default_vector_space) is not None:
            old = F.when(F.col("embedding").isNotNull() & ~F.map_contains_key("embeddings", default), F.create_map(F.lit(default), F.col("embedding")))
            out = out.withColumn("embeddings", F.map_concat("embeddings", F.coalesce(old, none)))
            if embed is not None:
                vector = embed(F.when(F.size("embeddings") == 0, F.col("text")))
                out = out.withColumn("__v", vector).withColumn("embeddings", F.when(F.col("__v").isNotNull(), F.create_map(F.lit(default), F.col("__v"))).otherwise(F.col("embeddings")))
        spaces = F.array(*(F.lit(s) for s in c.vector_spaces))
        unknown = F.array_except(F.map_keys("embeddings"), spaces)
        out = out.withColumn("embeddings", F.when(F.size(unknown) == 0, F.col("embeddings")).otherwise(F.raise_error(F.concat(F.lit("there is no vector space "), F.array_join(unknown, ", "))).cast("map<string,array<float>>")))
        for s, space in c.vector_spaces.items():
            out = out.withColumn("embeddings", F.transform_values("embeddings", _checked(s, space.dims)))
        return out.select("id", "embeddings")

    def _index(self, chunks: DataFrame, c: Collection, batch: str) -> None:
        """Postings and lengths of a batch; each file's postings are sorted by term, so that a query's terms meet few pages of it.

        Nothing is shuffled: the texts are analysed once, and no task meets all chunks of a common term.
        """
        folder = self.catalog.folder(c.name)
        fts.postings(chunks, c.config.get("analyzer", "english")).sortWithinPartitions("term", "chunk_id").write.parquet(f"{folder}/postings/{batch}")
        fts.doc_stats(chunks).write.parquet(f"{folder}/doc_stats/{batch}")

    def compact(self, c: Collection) -> Collection:
        """All batches as one, for collections that streams filled by many small ones; readers of the old files keep them until the switch."""
        if len(c.live) < 2:
            return c
        folder, batch, old = self.catalog.folder(c.name), f"batch={c.batches}", list(c.live)
        tables = [("chunks", self.chunks(c), c.live), ("doc_stats", self._table(c, "doc_stats", fts.DOC_STATS, c.live), c.live)]
        tables.append(("postings", self._table(c, "postings", fts.POSTINGS, c.live).repartitionByRange("term").sortWithinPartitions("term", "chunk_id"), c.live))
        spaces = {f"vectors/{s}/v{v.version}": (v, list(v.live)) for s, v in c.vector_spaces.items() if v.live}
        tables += [(what, self._table(c, what, VECTORS, live), live) for what, (_, live) in spaces.items()]
        for what, frame, _ in tables:
            self.catalog.files.delete(f"{folder}/{what}/{batch}")
            frame.write.parquet(f"{folder}/{what}/{batch}")
        for v, _ in spaces.values():
            v.live = [c.batches]
        c.live, c.batches = [c.batches], c.batches + 1
        self.catalog.save(c)
        for what in ("chunks", "doc_stats", "postings"):
            for k in old:
                self.catalog.files.delete(f"{folder}/{what}/batch={k}")
        for what, (_, live) in spaces.items():
            for k in live:
                self.catalog.files.delete(f"{folder}/{what}/batch={k}")
        return c


def _checked(space: str, dims: int) -> Callable[[Column, Column], Column]:
    return lambda k, v: F.when(k == space, check_dims(v, dims)).otherwise(v)
