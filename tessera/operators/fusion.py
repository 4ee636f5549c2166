"""Reciprocal rank fusion: two ranked lists become one."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top(ranked: DataFrame, n: int, score: str = "score", key: str = "chunk_id") -> DataFrame:
    """The n best rows; ties go to the smaller key."""
    return ranked.orderBy(F.desc(score), F.asc(key)).limit(n)


def rank(score: str = "score", key: str = "chunk_id") -> Column:
    """0-based rank. Over a list that was cut to its best rows; all of it is in one task."""
    return F.row_number().over(Window.orderBy(F.desc(score), F.asc(key))) - 1


def reciprocal_rank_fusion(fts: DataFrame, semantic: DataFrame, limit: int, k: float = 60.0, fts_weight: float = 1.0, semantic_weight: float = 1.0) -> DataFrame:
    """(chunk_id, base_score, source) of the `limit` best by the sum of weight / (k + rank), from lists (chunk_id, score)."""
    if k <= 0:
        raise ValueError("rrf_k must be above 0")
    lists = [
        ranked.select("chunk_id", (F.lit(float(w)) / (F.lit(float(k)) + rank())).alias("part"), F.lit(name).alias("name"))
        for name, ranked, w in (("fts", fts, fts_weight), ("semantic", semantic, semantic_weight))
    ]
    both = F.when(F.count_distinct("name") == 2, "both").otherwise(F.first("name"))
    merged = lists[0].unionByName(lists[1]).groupBy("chunk_id").agg(F.sum("part").alias("base_score"), both.alias("source"))
    return top(merged, limit, "base_score")


def best_of(k: int, query: np.ndarray, item: np.ndarray, score: np.ndarray) -> list[np.ndarray]:
    """The k best of each query; of equal scores the smaller item."""
    order = np.lexsort((item, -score, query))
    query, item, score = query[order], item[order], score[order]
    kept = np.arange(len(query)) - np.searchsorted(query, query) < k
    return [query[kept], item[kept], score[kept]]
