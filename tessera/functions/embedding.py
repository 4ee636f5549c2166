"""Text to vectors: a protocol for embedders, and a static table of token vectors."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, FloatType

from tessera.functions import analysis
from tessera.operators.fts import blocks, postings
from tessera.operators.relations import join_hot
from tessera.sources.shared import shared_table


#: Tokens of a table that a task may hold.
LOADED_TOKENS = 1_000_000


class Embedder(Protocol):
    """Anything with a number of dimensions that turns texts into rows of a matrix; a row of zeros means failure."""

    dims: int

    def embed(self, texts: Sequence[str]) -> np.ndarray: ...


class StaticEmbedder:
    """Mean of the token vectors of a text at length 1; zeros for a text without a known token."""

    def __init__(self, table: Mapping[str, Sequence[float]]):
        self.rows = {t: k for k, t in enumerate(table)}
        self.matrix = np.array(list(table.values()), np.float64).reshape(len(self.rows), -1)
        self.dims = self.matrix.shape[1]

    def embed(self, texts: Sequence[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dims))
        for k, text in enumerate(texts):
            known = [self.rows[t] for t in analysis.query_terms(text or "", "simple") if t in self.rows]
            if known:
                mean = self.matrix[known].mean(axis=0)
                length = np.linalg.norm(mean)
                out[k] = mean / length if length else 0
        return out


    @staticmethod
    def load(spark: SparkSession, path: str) -> StaticEmbedder:
        """From a stored table (token, vector) of Parquet; at most LOADED_TOKENS rows, as every task holds them."""
        table = spark.read.parquet(path)
        if (n := table.count()) > LOADED_TOKENS:
            raise ValueError(f"{path} has {n} tokens; join it by static_embedding instead")
        return StaticEmbedder({r.token: r.vector for r in table.where("token is not null").orderBy("token").collect()})


class Fallback:
    """The first embedder with a vector that isn't zero."""

    def __init__(self, *embedders: Embedder):
        self.embedders, self.dims = embedders, embedders[0].dims

    def embed(self, texts: Sequence[str]) -> np.ndarray:
        out = self.embedders[0].embed(texts)
        for e in self.embedders[1:]:
            none = np.flatnonzero(~out.any(axis=1))
            if len(none):
                out[none] = e.embed([texts[k] for k in none])
        return out


def embed_query(embedder: Embedder | None, text: str) -> list[float] | None:
    if embedder is None:
        return None
    v = np.asarray(embedder.embed([text]))[0]
    return [float(x) for x in v] if v.any() else None


def embed_column(text: Column, embedder: Embedder, batch_size: int = 64) -> Column:
    """The text's vector; null where the text is null or the embedder fails."""

    @arrow_udf(ArrayType(FloatType()))
    def vectors(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            held = []
            for at in range(0, len(b), batch_size):
                texts = b.slice(at, batch_size)
                found = np.asarray(embedder.embed(texts.fill_null("").to_pylist()), np.float32)
                has = found.any(axis=1) & texts.is_valid().to_numpy(zero_copy_only=False)
                ends = np.append(0, np.cumsum(has * found.shape[1]))
                held.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(found[has].ravel()), mask=pa.array(~has)))
            yield pa.concat_arrays(held) if held else pa.array([], pa.list_(pa.float32()))

    return vectors(text)


#: Numbers in a token table's vectors, and its rows, up to which every task holds it.
HELD_NUMBERS, HELD_TOKENS = 8_000_000, 500_000


def static_embedding(texts: DataFrame, table: DataFrame, dims: int) -> DataFrame:
    """(id, embedding) of (id, text) from a table (token, vector; each token once). Table and texts are computed once.

    A table that a task may hold is looked up where the texts are split, so that a text gives one
    row of sums and its tokens are never rows. A larger table is joined with the texts' tokens,
    a text's equal ones as one row with their number, the commonest by broadcast. Rows of one id are one text.
    """
    sums = [f"d{d}" for d in range(dims)]
    table = shared_table(table.select("token", "vector"), "tokens")
    n = table.count()
    if n <= HELD_TOKENS and n * dims <= HELD_NUMBERS:
        rows = _sums(texts, table, dims, sums)
    else:
        tokens = shared_table(postings(texts, "simple", places=False).select(F.col("chunk_id").alias("id"), F.col("term").alias("token"), "tf"), "counts")
        rows = join_hot(tokens, table, "token").select("id", F.col("tf").alias("n"), *((F.col("tf") * F.coalesce(F.get("vector", F.lit(d)).cast("double"), F.lit(0.0))).alias(f) for d, f in enumerate(sums)))
    mean = rows.groupBy("id").agg(F.sum("n").alias("n"), *(F.sum(f).alias(f) for f in sums)).select("id", F.array(*(F.col(f) / F.col("n") for f in sums)).alias("m"))
    length = F.sqrt(F.aggregate("m", F.lit(0.0), lambda s, x: s + x * x))
    return mean.select("id", F.when(length > 0, F.transform("m", lambda x: x / length)).alias("embedding"))


def _sums(texts: DataFrame, table: DataFrame, dims: int, names: Sequence[str]) -> DataFrame:
    """(id, n, ...) for each text with a known token: how many those are, and the sum of their vectors."""
    spark = texts.sparkSession
    held = table.where("token is not null").select("token", *(F.get("vector", F.lit(d)).cast("double").alias(f) for d, f in enumerate(names))).toArrow()
    # A null in a vector adds nothing.
    matrix = np.column_stack([held.column(f).combine_chunks().fill_null(0.0).to_numpy(zero_copy_only=False) for f in names]) if names else np.zeros((held.num_rows, 0))
    sent = spark.sparkContext.broadcast((held.column("token").cast(pa.string()).combine_chunks(), matrix))
    split = analysis.Splitter(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, matrix = sent.value
        for b in batches:
            for part in blocks(b, 1):
                words, row = split(part.column(1))
                words = words.dictionary_encode()
                # The block's words are looked up, not its tokens.
                found = pc.index_in(words.dictionary, tokens).fill_null(-1).to_numpy(zero_copy_only=False)
                at = found[words.indices.to_numpy(zero_copy_only=False)]
                row, at = row[at >= 0], at[at >= 0]
                n = np.bincount(row, minlength=part.num_rows)
                met = np.flatnonzero(n)
                sums = [pa.array(np.bincount(row, matrix[at, d], part.num_rows)[met]) for d in range(dims)]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(met)), pa.array(n[met].astype(np.int64)), *sums], ["id", "n", *names])

    rows = texts.select(F.col("id").cast("bigint").alias("id"), F.lower("text").alias("text")).where("text is not null")
    return rows.mapInArrow(run, ", ".join(["id bigint", "n bigint", *(f"{f} double" for f in names)]))
