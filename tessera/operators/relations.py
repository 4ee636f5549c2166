"""Parents, groups and segments in time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import metavalue as M

#: A key of more than this share of the rows is hot; there are at most 1 / HOT_SHARE of them.
HOT_SHARE = 1e-4


def parent_metadata(hits: DataFrame, chunks: DataFrame, few: bool = False) -> DataFrame:
    """`hits` with parent_metadata: of segments whose parent exists its metadata (maybe empty), else null.

    `few`: the hits are a search's, a thousand at most. Their parents are then found by a
    broadcast of the asked ids, so that the chunks are scanned and not shuffled.
    """
    asked = F.when(F.col("doc_type") == "segment", F.col("parent_id"))
    parents = chunks.select(F.col("id").alias("__pid"), F.col("metadata").alias("__pm"))
    if few:
        wanted = hits.select(asked.alias("__asked")).where("__asked is not null").distinct()
        parents = F.broadcast(parents.join(F.broadcast(wanted), F.col("__pid") == F.col("__asked")).drop("__asked"))
    held = hits.withColumn("__of", asked)
    return held.join(parents, F.col("__of") == F.col("__pid"), "left").withColumnRenamed("__pm", "parent_metadata").drop("__pid", "__of")


def resolve_parents(batch: DataFrame) -> DataFrame:
    """`batch` (id, client_id, parent_ref, parent_id, ...) with parent_id from the batch's own client ids.

    The last chunk of a client id stands for it; forward references are fine; a reference to
    an unknown one leaves the given parent_id.
    """
    found = parent_ids(batch).withColumnRenamed("id", "__id")
    refers = F.col("parent_ref").isNotNull()
    out = batch.where(refers).join(found, F.col("id") == F.col("__id"), "left")
    out = out.withColumn("parent_id", F.coalesce("__pid", "parent_id")).drop("__id", "__pid")
    return batch.where(~refers).unionByName(out)


def parent_ids(batch: DataFrame) -> DataFrame:
    """(id, __pid) of the chunks whose reference is known: ids and names only, whatever the size of the texts."""
    own = batch.where("client_id is not null").groupBy(F.col("client_id").alias("__ref")).agg(F.max("id").alias("__pid"))
    asked = batch.where("parent_ref is not null").select("id", F.col("parent_ref").alias("__ref"))
    return join_hot(asked, own, "__ref").select("id", "__pid")


def join_hot(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Inner join with a table that has each key once; keys of more than HOT_SHARE of the rows, which are few, are joined by broadcast.

    So no task meets all rows of a key. Rows are read three times: only for rows that are cheap to read.
    """
    sizes = rows.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    total = rows.count()
    hot = F.broadcast(sizes.where(F.col("__n") >= max(10_000, int(total * HOT_SHARE))).select(key))
    few = F.broadcast(table.join(hot, key, "left_semi"))
    return rows.join(few, key).unionByName(rows.join(hot, key, "left_anti").join(table, key))


def in_window(start: Column, end: Column, time_ms: float | None = None, time_start_ms: float | None = None, time_end_ms: float | None = None) -> Column:
    """Whether [start, end] holds the point, or else overlaps the range, bounds included; a row without both bounds doesn't."""
    if time_ms is not None:
        met = (start <= F.lit(float(time_ms))) & (end >= F.lit(float(time_ms)))
    elif time_start_ms is None and time_end_ms is None:
        return F.lit(True)
    else:
        met = start.isNotNull() & end.isNotNull() & ~F.isnan(start) & ~F.isnan(end)
        if time_end_ms is not None:
            met &= start <= F.lit(float(time_end_ms))
        if time_start_ms is not None:
            met &= end >= F.lit(float(time_start_ms))
    return F.coalesce(met & ~F.isnan(start) & ~F.isnan(end), F.lit(False))


def segments_at(chunks: DataFrame, asset: str, time_ms: float | None = None, time_start_ms: float | None = None, time_end_ms: float | None = None) -> DataFrame:
    """The segments of an asset in a time window, by start; those without one last, ties by id."""
    start, end = (M.as_number(M.field(f)) for f in ("timerange_start_ms", "timerange_end_ms"))
    rows = chunks.where((F.col("doc_type") == "segment") & (F.col("group_id") == asset))
    rows = rows.where(in_window(start, end, time_ms, time_start_ms, time_end_ms))
    return rows.withColumn("__start", start).orderBy(F.asc_nulls_last("__start"), "id").drop("__start")


def segments_for_points(segments: DataFrame, points: DataFrame) -> DataFrame:
    """(point columns, segment columns) for many points at once: segments (asset, start_ms, end_ms), points (asset, time_ms).

    An equi-join on the asset carries the interval's condition, so no nested loop is planned.
    """
    s, p = segments.alias("s"), points.alias("p")
    on = (F.col("s.asset") == F.col("p.asset")) & (F.col("s.start_ms") <= F.col("p.time_ms")) & (F.col("s.end_ms") >= F.col("p.time_ms"))
    return p.join(s, on).drop(F.col("s.asset"))
