"""Streams: stateless scans, deduplication under a watermark, windowed counts, versioned allocation in batches.

The reference behaviour is batch; these are its streaming form, an extension. Sources are folders of files, so a
stream can be replayed to its end with the availableNow trigger.
"""

from __future__ import annotations

from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F

from bankspark.operators import scan as scans


def read_parquet(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """A stream over the files of a folder or over one file, with the schema of the files that are there."""
    schema = spark.read.parquet(path).schema
    folder, pattern = (path, None) if Path(path).is_dir() else (str(Path(path).parent), Path(path).name)
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    return (reader.option("pathGlobFilter", pattern) if pattern else reader).parquet(folder)


def with_event_time(df: DataFrame, event_time: str, delay: str) -> DataFrame:
    """The stream with its time column as an instant (one without zone is in the session's zone) and a watermark."""
    return df.withColumn(event_time, F.col(event_time).cast("timestamp")).withWatermark(event_time, delay)


def scan_stream(df: DataFrame, key: str, text: str, found: list[dict[str, Any]]) -> DataFrame:
    """Records of a stream of documents; append mode, no state."""
    return scans.scan(df, key, text, found)


def distinct_stream(df: DataFrame, keys: list[str], event_time: str, delay: str) -> DataFrame:
    """First row of each key within the watermark."""
    return with_event_time(df, event_time, delay).dropDuplicatesWithinWatermark(keys)


def window_counts(df: DataFrame, event_time: str, width: str, delay: str, by: list[str], slide: str | None = None) -> DataFrame:
    """Rows by tumbling (or sliding) window and keys; late rows within the delay count."""
    window = F.window(event_time, width, slide) if slide else F.window(event_time, width)
    rows = with_event_time(df, event_time, delay).groupBy(window.alias("w"), *by).agg(F.count(F.lit(1)).alias("events"))
    return rows.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *by, "events")


def session_counts(df: DataFrame, event_time: str, gap: str, delay: str, by: list[str]) -> DataFrame:
    """Rows by session: events of a key closer than the gap."""
    rows = with_event_time(df, event_time, delay).groupBy(F.session_window(event_time, gap).alias("w"), *by).agg(F.count(F.lit(1)).alias("events"))
    return rows.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *by, "events")


def run_to_table(df: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """All that is there now, through the stream, as an in-memory table (for tests and small results)."""
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    return df.sparkSession.table(name)


def run_to_parquet(df: DataFrame, path: str, checkpoint: str) -> None:
    """All that is there now, appended to a folder; exactly once with the checkpoint."""
    query = df.writeStream.format("parquet").option("path", path).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
