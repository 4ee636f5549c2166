"""Odd tables: nulls, empty and very long texts, repeated rows, and extra columns with clashing names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CLASHES = ["id", "u", "v", "h", "hi", "lo", "gone", "score", "keep", "kind", "start", "end", "value", "vec", "bin_id", "y", "key", "n", "toxic", "__text", "__id", "token_ids", "Group"]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def docs(spark: SparkSession, texts: list, lang: str | None = "en", first: int = 0) -> DataFrame:
    return spark.createDataFrame([(first + k, t, lang, "s", len(t) if t is not None else None) for k, t in enumerate(texts)], SCHEMA)


def clashing(frame: DataFrame) -> DataFrame:
    return frame.withColumns({c: F.lit(f"extra {c}") for c in CLASHES if c not in frame.columns})


def odd(spark: SparkSession, filler: str = "plain words of a text") -> DataFrame:
    long = " ".join(f"{filler} {k}" for k in range(40_000))
    rows = [(1, None), (2, ""), (3, "   \n"), (None, filler), (None, None), (4, long), (5, "same row"), (5, "same row"), (6, "x" * 200_000), (7, "é中\U0001f600" * 50)]
    return clashing(spark.createDataFrame([(i, t, None if i == 7 else "en", "s", None) for i, t in rows], SCHEMA))


def empty(spark: SparkSession) -> DataFrame:
    return clashing(spark.createDataFrame([], SCHEMA))


def labels(spark: SparkSession, rows: list) -> DataFrame:
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int").withColumn("id", F.lit("extra"))
