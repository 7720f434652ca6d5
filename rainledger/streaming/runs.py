"""Structured Streaming forms: resumable appends and windowed counts (the latter go beyond the batch operators)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, time: str, kind: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, kind, n): counts per tumbling window. On a stream, rows later than the watermark are dropped and a
    window's state is freed once it has passed; on a batch, all rows count."""
    return events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), kind).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), kind, "n")


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Processes all that is there, exactly once per row over restarts, and stops."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()


def run_each(stream: DataFrame, work, checkpoint: str) -> None:
    """Calls work(batch, number) for each micro-batch; work must be idempotent by number."""
    stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def first_seen(stream: DataFrame, time: str, key: str, late: str = "1 day") -> DataFrame:
    """Rows whose key has not come within the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])
