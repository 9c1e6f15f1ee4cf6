"""Streaming ingest: events become acquisitions as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def acquisition_stream(events: DataFrame, late: str = "2 days") -> DataFrame:
    """Daily acquisitions of an event stream (ts, value): d, bpr, n.

    A day is final, and emitted in append mode, once the watermark passes it;
    later events of that day are dropped, so state is bounded by the days
    within the delay.
    """
    day = F.window("ts", "1 day")
    agg = events.withWatermark("ts", late).groupBy(day.alias("w")).agg(F.round(100 * (F.avg("value") - 50), 1).alias("bpr"), F.count("*").alias("n"))
    return agg.select(F.col("w.start").cast("date").alias("d"), "bpr", "n")


def read_events(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """Event files of a folder as a stream."""
    return spark.readStream.schema("event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string").option("maxFilesPerTrigger", files_per_batch).parquet(path)


def run_once(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Process what is there and stop; results are appended to a Parquet folder."""
    q = stream.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
