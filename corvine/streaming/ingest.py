"""Incremental ingest and windowed counts with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corvine.sources.files import decode, language_of
from corvine.sources.store import exists, upsert, write


def file_stream(spark: SparkSession, folder: str, namespace: str) -> DataFrame:
    """New files of a folder as (file_path, code, language, namespace, modified)."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").load(folder)
    return files.select(F.col("path").alias("file_path"), decode("content").alias("code"), language_of(F.col("path")).alias("language"), F.lit(namespace).alias("namespace"), F.col("modificationTime").alias("modified"))


def keep_table(stream: DataFrame, path: str, key: list[str], checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Upsert each batch into the table at ``path``; a batch that is run again changes nothing."""

    def batch(df: DataFrame, _: int) -> None:
        spark = df.sparkSession
        if df.isEmpty():
            return
        if exists(spark, path):
            upsert(spark, path, df, key)
        else:
            write(df.dropDuplicates(key), path)

    w = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")).start()


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(user_id, window, events): sessions of a user, over a stream (with a watermark) or a table of events."""
    e = events.select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    e = e.withWatermark("ts", late) if events.isStreaming else e
    return e.groupBy("user_id", F.session_window("ts", gap).alias("window")).agg(F.count("*").alias("events"))


def windowed_counts(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """(window, event_type, events, value): tumbling or sliding windows over a stream or a table of events."""
    e = events.select("event_type", "value", F.col("ts").cast("timestamp").alias("ts"))
    e = e.withWatermark("ts", late) if events.isStreaming else e
    return e.groupBy(F.window("ts", width, slide or width).alias("window"), "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("value"))
