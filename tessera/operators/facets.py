"""Facets: how many chunks hold each value of each metadata field."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import metavalue as M


def facet_counts(chunks: DataFrame, fields: Sequence[str] = (), matched: DataFrame | None = None, metadata: Column | None = None) -> DataFrame:
    """(field, value, count) over all chunks, or those whose id is in matched.chunk_id. One shuffle, after partial counts."""
    meta = F.col("metadata") if metadata is None else metadata
    if matched is not None:
        chunks = chunks.join(matched.select(F.col("chunk_id").alias("id")), "id", "left_semi")
    if fields:
        meta = F.map_filter(meta, lambda k, v: k.isin(list(fields)))
    entries = chunks.select(F.explode(F.map_entries(meta)).alias("e"))
    return entries.groupBy(F.col("e.key").alias("field"), M.as_text(F.col("e.value")).alias("value")).agg(F.count(F.lit(1)).alias("count"))


def facet_sets(chunks: DataFrame, field: str) -> DataFrame:
    """(value, bucket, bitmap): the ids of each value as bitmaps; their conjunctions count chunks of two values without a scan."""
    at = F.col("id") + 1  # ids 0 and 1 would share a bit
    value = M.as_text(M.field(field))
    return chunks.where(value.isNotNull()).groupBy(value.alias("value"), F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bitmap"))


def as_mapping(counts: DataFrame, asked: Sequence[str] = ()) -> dict[str, dict[str, int]]:
    """{field: {value: count}}; an asked field without a value is there and empty."""
    out: dict[str, dict[str, int]] = {f: {} for f in asked}
    for r in counts.collect():
        out.setdefault(r.field, {})[r.value] = r["count"]
    return out
