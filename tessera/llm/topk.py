"""Exact top-k by inner product of a query set with all rows, in falling order of length.

The vectors are rotated by the right singular vectors of the whole table (from its d x d
Gram matrix, summed over all rows), so that few leading coordinates carry most of an inner
product. They are written once, rotated, in parts of PART_ITEMS of falling length, with their
lengths and those of their residuals. A task holds a part of the queries and reads one part's
blocks one after the other, keeping each query's k best so far:

* queries whose length times the block's greatest is below their k-th score are done, and
  when all are, the rest of the part isn't read;
* the sums over the leading coordinates plus the product of the two residuals' lengths bound
  the inner product by Cauchy and Schwarz; pairs whose bound is below the query's k-th score
  go, first after HEAD coordinates, then after twice as many;
* the rest are computed in full.

The part of the longest vectors goes first: its k-th scores are where the other parts begin,
so that what is too short there is left at its first block.

The registered query asks with every row whose id is divisible by QUERY_EVERY, against all
rows: a stated query set, so that the work grows with the square of the table over a hundred.

A score is the inner product rounded to DIGITS decimals; of equal scores the smaller id comes
first. Defined results: a vector is no neighbour of itself; rows with a null id, and vectors
that are null, empty or hold a null or a value that isn't finite are left out, as are those
of another dimension than most rows have (of two as frequent ones, the larger is used); rows
that repeat an id count once, with the least of its vectors; a query with fewer than k others
has as many rows as there are; an empty table gives an empty result. Other columns are never read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .records import open_folder
from .spill import cut, fresh_path

K = 10
DIGITS = 6
HEAD = 16
ITEMS_AT_ONCE = 4096
QUERIES_AT_ONCE = 1024
#: Queries that a task holds, and the least for which a task of its own is worth it.
QUERIES_HELD, QUERIES_LEAST = 65_536, 64
PART_ITEMS = 1 << 24
QUERY_EVERY = 100
#: Above this share of pairs left by the bound the block's product is computed as a whole.
DENSE = 0.1
SLACK = 10.0**-DIGITS
RESULT = "query_id bigint, rank int, neighbour_id bigint, score double"


def rounded(x: np.ndarray) -> np.ndarray:
    scale = 10.0**DIGITS
    return np.copysign(np.floor(np.abs(x) * scale + 0.5), x) / scale + 0.0


def matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d).astype(np.float64)


def gram(vectors: DataFrame, d: int) -> np.ndarray:
    """X'X over all rows; partial sums are added up by Spark, so that d * d numbers reach the driver."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for b in batches:
            x = matrix(b.column(0), d)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d * d)), pa.array(total.ravel())], ["at", "v"])

    out = np.zeros(d * d)
    for r in vectors.select("vec").mapInArrow(partial, "at bigint, v double").groupBy("at").agg(F.sum("v").alias("v")).collect():
        out[r.at] = r.v
    return out.reshape(d, d)


class Best:
    """The k best pairs of each query."""

    def __init__(self, n: int, k: int, floor: np.ndarray | None = None):
        """floor: scores that a pair must reach, by query."""
        self.k, self.n = k, n
        self.query, self.score, self.item = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        self.least = np.full(n, -np.inf) if floor is None else floor.copy()

    def add(self, query: np.ndarray, score: np.ndarray, item: np.ndarray) -> None:
        good = score >= self.least[query]
        if not good.any():
            return
        q = np.concatenate([self.query, query[good]])
        s = np.concatenate([self.score, score[good]])
        i = np.concatenate([self.item, item[good]])
        order = np.lexsort((i, -s, q))
        q, s, i = q[order], s[order], i[order]
        first = np.searchsorted(q, np.arange(self.n))
        rank = np.arange(len(q)) - first[q]
        kept = rank < self.k
        self.query, self.score, self.item = q[kept], s[kept], i[kept]
        last = rank == self.k - 1
        self.least[q[last]] = s[last]

    def ranks(self) -> np.ndarray:
        return np.arange(len(self.query)) - np.searchsorted(self.query, np.arange(self.n))[self.query]


class Block(NamedTuple):
    """Rotated vectors in falling order of length, with the lengths of what is left of each after so many coordinates."""

    id: np.ndarray
    x: np.ndarray
    length: np.ndarray
    rest: dict[int, np.ndarray]

    @staticmethod
    def of(ids: np.ndarray, x: np.ndarray) -> Block:
        return Block(ids, x, np.linalg.norm(x, axis=1), {h: np.linalg.norm(x[:, h:], axis=1) for h in heads(x.shape[1])})

    def part(self, rows: slice) -> Block:
        return Block(self.id[rows], self.x[rows], self.length[rows], {h: r[rows] for h, r in self.rest.items()})


def heads(d: int) -> list[int]:
    return [h for h in (HEAD, 2 * HEAD) if h < d]


def search_block(best: Best, base: int, q: Block, x: Block) -> None:
    """Offers the pairs of a part of the queries (from row `base` on) with a block of items."""
    least = best.least[base : base + len(q.id)]
    total, done = np.zeros((len(q.id), len(x.id))), 0
    for h in heads(q.x.shape[1]):
        total += q.x[:, done:h] @ x.x[:, done:h].T
        done = h
        may = total + q.rest[h][:, None] * x.rest[h][None, :] >= least[:, None] - SLACK
        if may.mean() <= DENSE:
            i, j = np.nonzero(may)
            total = total[i, j] + np.einsum("nd,nd->n", q.x[i, done:], x.x[j, done:])
            break
    else:
        total += q.x[:, done:] @ x.x[:, done:].T
        i, j = np.nonzero(total >= least[:, None] - SLACK)
        total = total[i, j]
    other = q.id[i] != x.id[j]
    best.add(base + i[other], rounded(total[other]), x.id[j[other]])


def offer(best: Best, q: Block, blocks: Iterator[Block]) -> None:
    """All blocks, in falling order of their greatest length, until no query can gain."""
    for x in blocks:
        top = x.length.max()
        if not (q.length * top >= best.least - SLACK).any():
            return
        for base in range(0, len(q.id), QUERIES_AT_ONCE):
            part = slice(base, base + QUERIES_AT_ONCE)
            if (q.length[part] * top >= best.least[part] - SLACK).any():
                search_block(best, base, q.part(part), x)


def read_blocks(folder: str, part: int, d: int) -> Iterator[Block]:
    """The blocks of a part, which is what the task of that number wrote."""
    files, base = open_folder(folder)
    names = sorted(i.path for i in files.get_file_info(fs.FileSelector(base)) if i.extension == "parquet" and int(re.match(r"part-(\d+)", i.base_name)[1]) == part)
    for name in names:
        with files.open_input_file(name) as f:
            for batch in pq.ParquetFile(f).iter_batches(ITEMS_AT_ONCE):
                if batch.num_rows:
                    rest = matrix(batch.column("rest"), len(heads(d))) if heads(d) else np.zeros((batch.num_rows, 0))
                    yield Block(batch.column("id").to_numpy(), matrix(batch.column("vec"), d), batch.column("length").to_numpy(), {h: rest[:, k] for k, h in enumerate(heads(d))})


def lists(x: np.ndarray) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64())) if x.shape[1] else pa.array([[]] * len(x), pa.list_(pa.float64()))


def top_k(vectors: DataFrame, k: int = K, id_col: str = "vec_id", vec_col: str = "embedding", asked: Column | None = None) -> DataFrame:
    """(query_id, rank from 1, neighbour_id, score): the k best others of the vectors for which `asked` holds (on the id; all if None)."""
    spark = vectors.sparkSession
    which = F.lit(True) if asked is None else F.coalesce(asked, F.lit(False))
    v = vectors.select(vectors[id_col].cast("bigint").alias("id"), vectors[vec_col].cast("array<float>").alias("vec"), which.alias("asked"))
    inf = float("inf")
    bad = F.exists("vec", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == F.lit(inf)))
    v = v.where(F.col("id").isNotNull() & (F.size("vec") > 0) & ~bad)
    v = cut(v.groupBy("id").agg(F.min("vec").alias("vec"), F.max("asked").alias("asked")), "vectors")
    shape = v.groupBy(F.size("vec").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.count_if("asked").alias("asked")).orderBy(F.desc("n"), F.desc("d")).first()
    if shape is None:
        return spark.createDataFrame([], RESULT)
    d, parts = shape.d, -(-shape.n // PART_ITEMS)
    v = v.where(F.size("vec") == d)
    rotation = np.linalg.eigh(gram(v, d))[1][:, ::-1].copy()
    folder = fresh_path(spark, "blocks")

    def rotated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = Block.of(b.column(0).to_numpy(), matrix(b.column(1), d) @ rotation)
                rest = np.stack([x.rest[h] for h in heads(d)], axis=1) if heads(d) else np.zeros((len(x.id), 0))
                yield pa.RecordBatch.from_arrays([b.column(0), lists(x.x), pa.array(x.length), lists(rest)], ["id", "vec", "length", "rest"])

    length = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, e: a + e.cast("double") * e.cast("double")))
    ranged = v.select("id", "vec", length.alias("length")).repartitionByRange(parts, F.desc("length"), "id").sortWithinPartitions(F.desc("length"), "id")
    ranged.select("id", "vec").mapInArrow(rotated, "id bigint, vec array<double>, length double, rest array<double>").write.parquet(folder)

    def search(tile: pa.Table) -> pa.Table:
        q_id, part = tile.column("id").to_numpy(), tile.column("part")[0].as_py()
        q = Block.of(q_id, matrix(tile.column("vec").combine_chunks(), d) @ rotation)
        best = Best(len(q_id), k, tile.column("floor").to_numpy())
        offer(best, q, read_blocks(folder, part, d))
        return pa.table([pa.array(q_id[best.query]), pa.array(best.item), pa.array(best.score)], ["query_id", "neighbour_id", "score"])

    queries = v.where("asked").select("id", "vec")
    tasks = max(-(-shape.asked // QUERIES_HELD), min(spark.sparkContext.defaultParallelism, -(-shape.asked // QUERIES_LEAST)), 1)

    def found(rows: DataFrame, numbers: range) -> DataFrame:
        """The best of the queries (id, vec, floor) in the parts of these numbers; a tile is a task's queries with one part."""
        tiles = rows.withColumns({"part": F.explode(F.array(*map(F.lit, numbers))), "share": F.pmod(F.xxhash64("id"), F.lit(tasks))})
        tiles = tiles.withColumn("tile", F.col("part") * F.lit(tasks) + F.col("share")).repartition(2 * tasks * len(numbers), "tile")
        return tiles.groupBy("tile").applyInArrow(search, "query_id bigint, neighbour_id bigint, score double")

    pairs = found(queries.withColumn("floor", F.lit(-inf)), range(1))
    if parts > 1:
        pairs = cut(pairs, "longest")
        floors = pairs.groupBy(F.col("query_id").alias("id")).agg(F.when(F.count(F.lit(1)) == k, F.min("score")).alias("floor"))
        rest = queries.join(floors, "id", "left").withColumn("floor", F.coalesce("floor", F.lit(-inf)))
        pairs = pairs.unionByName(found(rest, range(1, parts)))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "neighbour_id")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "neighbour_id", "score")


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), asked=F.col("vec_id") % QUERY_EVERY == 0)


QUERIES = {"op8_exact_top_k": op8_exact_top_k}
ORACLE_SQL = {
    "op8_exact_top_k": f"""
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
p AS (SELECT q.vec_id AS query_id, x.vec_id AS neighbour_id, round(list_inner_product(q.e, x.e), {DIGITS}) AS score
      FROM v q JOIN v x ON q.vec_id <> x.vec_id WHERE q.vec_id % {QUERY_EVERY} = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, neighbour_id) AS INTEGER) AS rank, neighbour_id, score
FROM p QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, neighbour_id) <= {K}"""
}
