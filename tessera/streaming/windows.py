"""Structured Streaming: windowed counts, sessions and their batch equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tumbling(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts and sums by window and type; the watermark bounds the state."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    out = events.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("window_start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str, step: str, late: str = "1 hour") -> DataFrame:
    """Counts and sums by overlapping windows and type; the watermark bounds the state."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    out = events.groupBy(F.window("ts", width, step), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("window_start"), "event_type", "n", "total")


def stale(beats: DataFrame, worker: str, at: str, seconds: int = 90) -> DataFrame:
    """(worker, last_seen, stale): whether a worker's last heartbeat is more than so many seconds before the newest of all."""
    last = beats.groupBy(worker).agg(F.max(at).alias("last_seen"))
    newest = last.agg(F.max("last_seen").alias("_now"))
    return last.join(F.broadcast(newest)).select(worker, "last_seen", (F.col("last_seen") < F.col("_now") - F.expr(f"INTERVAL {seconds} SECOND")).alias("stale"))


def journal(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """An append-only journal of JSON lines as a stream."""
    return spark.readStream.schema(schema).json(folder)


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    out = events.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("session_window.start").alias("start"), "n")


def stream_of(spark: SparkSession, path: str, schema) -> DataFrame:
    """A file stream of Parquet files below path."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 8).parquet(path)


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process all that is there, then stop; results and progress are files, so a restart goes on where it stopped."""
    stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def run_complete(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Process all that is there and leave the whole result table at path, replaced with each batch."""
    query = stream.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True)
    query.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(path)).start().awaitTermination()
