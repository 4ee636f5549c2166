"""Structured Streaming into a collection, and windowed counts over event streams."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.engine import Engine
from tessera.sources.catalog import Files


def stream_into(engine: Engine, name: str, rows: DataFrame, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Every micro-batch of `rows` (file_id, chunk_index, text, ...) is one ingest.

    A micro-batch that is offered again after a failure is known by its stream and number and skipped.
    A stream is known by the id in its checkpoint, so any number of streams may fill one collection;
    the number is saved together with the batch, so that a crash leaves both or neither.
    """

    def write(batch: DataFrame, number: int) -> None:
        stream = json.loads(engine.catalog.files.read(f"{checkpoint.rstrip('/')}/metadata"))["id"]
        if not batch.isEmpty():
            engine.ingest_frame(name, batch, stream=(stream, number))

    writer = rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def event_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, event_type, count, value) by window; later events than the watermark allows are dropped."""
    rows = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return rows.groupBy(F.window("at", width), "event_type").agg(F.count(F.lit(1)).alias("count"), F.sum("value").alias("value")).select(F.col("window.start").alias("start"), "event_type", "count", "value")


def read_table(spark: SparkSession, schema: str, path: str) -> DataFrame:
    """A stream over a table of Parquet, be it one file or a folder of files."""
    rows = spark.readStream.schema(schema)
    if Files(spark).is_folder(path):
        return rows.parquet(path)
    folder, name = path.rsplit("/", 1)  # a stream reads no file but its folder
    return rows.option("pathGlobFilter", name).parquet(folder)


def read_events(spark: SparkSession, folder: str, name: str = "events.parquet") -> DataFrame:
    return read_table(spark, "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string", f"{folder}/{name}")
