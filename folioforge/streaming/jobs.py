"""Streams: job messages, delivery dedupe, retention by watermark, event-time windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def source(spark: SparkSession, path: str, schema: StructType, per_trigger: int = 8) -> DataFrame:
    """Files that arrive in a folder; files per trigger is the back-pressure."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def run(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str):
    """What is there now, batch by batch, normal before low within a batch; a restart goes on from the checkpoint."""

    def batch(rows: DataFrame, n: int) -> None:
        order = F.when(F.col("priority") == "normal", 0).otherwise(1)
        work(rows.orderBy(order, "enqueued_at") if "priority" in rows.columns else rows, n)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def deduplicated(stream: DataFrame, at: str = "ts", key: str = "event_id", delay: str = "1 hour") -> DataFrame:
    """Deliveries repeat; each id passes once within the watermark."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def tumbling(events: DataFrame, width: str, by: list[str], at: str = "ts", late: str = "1 hour") -> DataFrame:
    """Counts in tumbling windows; with a watermark where events is a stream."""
    rows = events.withWatermark(at, late) if events.isStreaming else events
    return rows.groupBy(F.window(at, width), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), *by, "n")


def sessions(events: DataFrame, gap: str, by: str, at: str = "ts", late: str = "1 hour") -> DataFrame:
    rows = events.withWatermark(at, late) if events.isStreaming else events
    return rows.groupBy(F.session_window(at, gap), by).agg(F.count(F.lit(1)).alias("n")).select(by, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")
