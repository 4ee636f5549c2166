"""Nearest neighbours by cosine: an exact scan, and an optional inverted file.

Both are filters, a score expression and TakeOrderedAndProject; neither shuffles. An inverted
file stores each vector under its nearest centroid and keeps how far each folder's vectors lie from it.
A query reads the folders nearest to it first, then all that may hold a vector as near as the k-th of
those: its result is the exact scan's.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass
from functools import reduce
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import DoubleType, IntegerType

from tessera.functions import vector as V
from tessera.operators.fusion import best_of, top
from tessera.sources.shared import shared_folder


@dataclass(frozen=True)
class IndexParams:
    dims: int
    n_lists: int = 0  # centroids; 0: about the square root of the number of vectors
    n_probe: int = 8  # lists read first; more follow as far as the bound asks for them
    train_rows: int = 50_000  # bounded sample that the centroids are fitted on
    seed: int = 7


class VectorBackend(Protocol):
    name: str

    def search(self, query: Sequence[float], k: int, eligible: DataFrame | None = None) -> DataFrame: ...


def check_dims(column: Column, dims: int) -> Column:
    """The vector, or an error where its size is another."""
    wrong = F.raise_error(F.concat(F.lit(f"a vector has not {dims} dimensions but "), F.size(column).cast("string")))
    return F.when(column.isNull() | (F.size(column) == dims), column).otherwise(wrong.cast("array<float>"))


def nearest(vectors: DataFrame, query: Sequence[float], k: int, eligible: DataFrame | None = None) -> DataFrame:
    """The k best (chunk_id, score) of (chunk_id, embedding) by cosine; rows of another dimension are an error."""
    if eligible is not None:
        vectors = vectors.join(eligible.select("chunk_id"), "chunk_id", "left_semi")
    scored = vectors.where(F.col("embedding").isNotNull()).select("chunk_id", V.cosine(check_dims(F.col("embedding"), len(query)), query).alias("score"))
    return top(scored, k)


def nearest_of_all(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, chunk_id, score, rank): the k best by cosine for each of many queries (query_id, embedding), in blocks.

    Vectors are written in parts of PART_VECTORS; a tile is a part with up to QUERIES_HELD queries, whose
    products are taken as matrices. Only k rows of a query and part are shuffled. A query's own chunk counts.
    """
    spark = vectors.sparkSession
    unit = lambda rows, name: rows.where(F.col("embedding").isNotNull()).select(F.col(name).cast("bigint").alias("id"), F.col("embedding").cast("array<float>").alias("x"))
    folder = shared_folder(spark, "parts")
    held, asked = unit(vectors, "chunk_id"), unit(queries, "query_id")
    n, m = vectors.count(), queries.count()
    parts, shares = max(1, -(-n // PART_VECTORS)), max(1, -(-m // QUERIES_HELD))
    shares = max(shares, min(-(-m // QUERIES_LEAST), -(-spark.sparkContext.defaultParallelism // parts)))
    held.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts))).repartition(parts * -(-PART_VECTORS // FILE_VECTORS) if parts > 1 else 1, "part", F.xxhash64("id") % 1009).write.partitionBy("part").parquet(folder)

    def search(tile: pa.Table) -> pa.Table:
        q_id, part = tile.column("id").to_numpy(), tile.column("part")[0].as_py()
        q = _unit(np.array(tile.column("x").to_pylist(), float).reshape(len(q_id), -1))
        found = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        for ids, x in _files_of(f"{folder}/part={part}"):
            for at in range(0, len(q), QUERIES_AT_ONCE):
                s = np.floor(q[at : at + QUERIES_AT_ONCE] @ _unit(x).T * 1e9 + 0.5) / 1e9
                least = np.partition(s, -min(k, s.shape[1]), axis=1)[:, -min(k, s.shape[1])]
                i, j = np.nonzero(s >= least[:, None])
                found = best_of(k, *(np.concatenate(p) for p in zip(found, (at + i, ids[j], s[i, j]), strict=True)))
        return pa.table([pa.array(q_id[found[0]]), pa.array(found[1]), pa.array(found[2])], ["query_id", "chunk_id", "score"])

    tiles = asked.withColumns({"part": F.explode(F.sequence(F.lit(0), F.lit(parts - 1))), "share": F.pmod(F.xxhash64("id"), F.lit(shares))})
    tiles = tiles.repartition(2 * parts * shares, "part", "share").groupBy("part", "share").applyInArrow(search, "query_id bigint, chunk_id bigint, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return tiles.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _files_of(folder: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    files, base = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
    for info in files.get_file_info(fs.FileSelector(base, allow_not_found=True)):
        if info.extension == "parquet":
            with files.open_input_file(info.path) as f:
                for batch in pq.ParquetFile(f).iter_batches(8192, columns=["id", "x"]):
                    if batch.num_rows:
                        yield batch.column(0).to_numpy(), batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1).astype(float)


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows at length 1; a row without length stays."""
    length = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(length > 0, length, 1)


class Exact:
    name = "exact"

    def __init__(self, vectors: DataFrame):
        self.vectors = vectors

    def search(self, query: Sequence[float], k: int, eligible: DataFrame | None = None) -> DataFrame:
        return nearest(self.vectors, query, k, eligible)


def kmeans(x: np.ndarray, n: int, seed: int, rounds: int = 12) -> np.ndarray:
    """Centroids of length 1 of vectors of length 1."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), n, replace=False)].copy()
    for _ in range(rounds):
        which = np.argmax(x @ centres.T, axis=1)
        total = np.zeros_like(centres)
        np.add.at(total, which, x)
        some = np.linalg.norm(total, axis=1) > 0
        centres[some] = total[some] / np.linalg.norm(total[some], axis=1, keepdims=True)
    return centres


def assign(embedding: Column, centres: np.ndarray) -> Column:
    @arrow_udf(IntegerType())
    def nearest_centre(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            x = b.flatten().to_numpy(zero_copy_only=False).reshape(-1, centres.shape[1])
            yield pa.array(np.argmax(x @ centres.T, axis=1).astype(np.int32))

    return nearest_centre(embedding)


def cosine_to(embedding: Column, centre: Column, centres: np.ndarray) -> Column:
    """Inner product of each vector with the centroid of its list."""

    @arrow_udf(DoubleType())
    def product(embeddings: pa.Array, own: pa.Array) -> pa.Array:
        x = embeddings.flatten().to_numpy(zero_copy_only=False).reshape(-1, centres.shape[1])
        return pa.array(np.einsum("ij,ij->i", _unit(x.astype(float)), centres[own.to_numpy(zero_copy_only=False)]))

    return product(embedding, centre)


#: Vectors of a part, of one of its files, and queries that a task holds, takes at once, and is worth a task of their own.
PART_VECTORS, FILE_VECTORS, QUERIES_HELD, QUERIES_AT_ONCE, QUERIES_LEAST = 1 << 24, 1 << 20, 65_536, 1024, 64
#: Tasks that write one list.
SPREAD = 16
#: What rounding of stored floats may change in a cosine.
SLACK = 1e-5


class InvertedFile:
    name = "ivf"

    def __init__(self, vectors: DataFrame, centres: np.ndarray, n_probe: int, least: np.ndarray, folder: str = "", params: IndexParams | None = None, parts: dict[str, np.ndarray] | None = None):
        """least: of each list the least cosine of a vector with its centroid, 2 for an empty list; parts: of what was added together the number of vectors in each list."""
        self.vectors, self.centres, self.n_probe, self.least, self.folder, self.params, self.parts = vectors, centres, n_probe, least, folder, params, parts or {}
        self.inspected = 0  # vectors in the lists that the last search read

    @staticmethod
    def build(vectors: DataFrame, folder: str, params: IndexParams) -> InvertedFile:
        """Writes the vectors under `folder`, a directory for each centroid."""
        rows = vectors.where(F.col("embedding").isNotNull()).select("chunk_id", check_dims(F.col("embedding"), params.dims).cast("array<float>").alias("embedding"))
        count = rows.count()
        sample = rows.orderBy(F.xxhash64("chunk_id", F.lit(params.seed)), "chunk_id").limit(params.train_rows).collect()
        x = _unit(np.array([r.embedding for r in sample], np.float64).reshape(-1, params.dims))
        n = min(len(x), params.n_lists or max(1, round(count**0.5)))
        centres = kmeans(x, n, params.seed) if n else np.zeros((0, params.dims))
        out = InvertedFile(rows, centres, params.n_probe, np.full(n, 2.0), folder, params)
        out._store(rows, "first")
        return out

    def _store(self, rows: DataFrame, part: str) -> None:
        """Adds vectors as they are under `part`; a list is spread over tasks by a hash of the ids, so that a large one isn't written by one."""
        spark, n = rows.sparkSession, len(self.centres)
        placed = rows.withColumn("centre", assign(F.col("embedding"), self.centres) if n else F.lit(0))
        placed.repartition("centre", F.pmod(F.xxhash64("chunk_id"), F.lit(SPREAD))).write.mode("overwrite").partitionBy("centre").parquet(f"{self.folder}/lists/{part}")
        stored = self._read(spark, [part])
        sizes = np.zeros(n, np.int64)
        near = stored.select("centre", cosine_to(F.col("embedding"), F.col("centre"), self.centres).alias("c")) if n else None
        for r in near.groupBy("centre").agg(F.min(F.when(F.isnan("c"), -1.0).otherwise(F.col("c"))).alias("c"), F.count(F.lit(1)).alias("n")).collect() if n else ():
            self.least[r.centre] = min(self.least[r.centre], r.c)
            sizes[r.centre] = r.n
        self.parts[part] = sizes
        self.vectors = self._read(spark, list(self.parts))

    def _read(self, spark: SparkSession, parts: list[str]) -> DataFrame:
        schema = "chunk_id bigint, embedding array<float>, centre int"
        return reduce(DataFrame.unionByName, [spark.read.schema(schema).parquet(f"{self.folder}/lists/{p}") for p in parts])

    def save(self, files) -> None:
        """Writes what isn't in the lists beside them; `files` reads and writes whole small files."""
        held = {"params": asdict(self.params), "parts": {p: s.tolist() for p, s in self.parts.items()}, "least": self.least.tolist(), "centres": self.centres.tolist()}
        files.write(f"{self.folder}/index.json", json.dumps(held))

    @staticmethod
    def open(spark: SparkSession, files, folder: str, batches: int | None = None) -> InvertedFile:
        """batches: ingests that count; what one added that failed before it counted is left out."""
        held = json.loads(files.read(f"{folder}/index.json"))
        params = IndexParams(**held["params"])
        out = InvertedFile(None, np.array(held["centres"], float).reshape(-1, params.dims), params.n_probe, np.array(held["least"], float), folder, params)
        counts = lambda part: batches is None or not part.startswith("batch=") or int(part[6:]) < batches
        out.parts, out.files = {p: np.array(s, np.int64) for p, s in held["parts"].items() if counts(p)}, files
        out.vectors = out._read(spark, list(out.parts))
        return out

    @property
    def sizes(self) -> np.ndarray:
        return sum(self.parts.values(), np.zeros(len(self.centres), np.int64))

    def extend(self, vectors: DataFrame, part: str) -> None:
        """Adds the vectors of an ingest to the lists of the nearest centroids. A part that was added before is written again."""
        rows = vectors.where(F.col("embedding").isNotNull()).select("chunk_id", check_dims(F.col("embedding"), self.params.dims).cast("array<float>").alias("embedding"))
        if not len(self.centres):  # built over nothing: the first vectors make the centroids
            built = InvertedFile.build(vectors, self.folder, self.params)
            built.save(self.files)
            return
        self.parts.pop(part, None)
        self._store(rows, part)
        self.save(self.files)

    def bounds(self, query: Sequence[float]) -> np.ndarray:
        """Of each list the highest cosine with the query that a vector in it may have."""
        q = np.asarray(query, float)
        near = np.arccos(np.clip(self.centres @ q / (np.linalg.norm(q) or 1.0), -1, 1))
        radius = np.arccos(np.clip(self.least - SLACK, -1, 1))
        best = np.cos(np.maximum(near - radius, 0)) + SLACK
        # A vector without length scores 0 wherever it lies.
        best = np.where(self.least <= SLACK, np.maximum(best, SLACK), best)
        return np.where(self.least > 1.5, -np.inf, best)

    def among(self, lists: np.ndarray) -> DataFrame:
        return self.vectors.where(F.col("centre").isin([int(c) for c in lists]))

    def search(self, query: Sequence[float], k: int, eligible: DataFrame | None = None) -> DataFrame:
        bounds = self.bounds(query)
        order = np.argsort(-bounds, kind="stable")
        order = order[bounds[order] > -np.inf]
        first = order[: self.n_probe]
        if not np.any(query) or not len(order) or k <= 0:  # all scores are equal, or there is nothing to read
            self.inspected = int(self.sizes[order].sum())
            return nearest(self.among(order), query, k, eligible)
        found = nearest(self.among(first), query, k, eligible).agg(F.count("score").alias("n"), F.min("score").alias("worst")).first()
        more = order if found.n < k else order[~(bounds[order] < found.worst)]
        read = np.union1d(first, more).astype(int)
        self.inspected = int(self.sizes[read].sum())
        return nearest(self.among(read), query, k, eligible)


def recall(found: DataFrame, exact: DataFrame) -> float:
    """Share of the exact ids that were found."""
    r = exact.select("chunk_id").join(found.select("chunk_id", F.lit(1).alias("hit")), "chunk_id", "left").agg(F.count("hit").alias("h"), F.count(F.lit(1)).alias("n")).first()
    return r.h / r.n if r.n else 1.0
