"""Windows over events, and batches appended to files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(events: DataFrame, size: str = "1 day", late: str = "2 days", key: str = "event_type") -> DataFrame:
    """Tumbling counts and sums with a watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), key).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), key, "n", "total")


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "2 days") -> DataFrame:
    """Sessions per user with a watermark."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("stop"), "user_id", "n")


def append_batches(df: DataFrame, path: str, checkpoint: str):
    """Append every micro-batch as CSV; a batch that is run again replaces its own folder."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").option("header", True).csv(f"{path}/batch={epoch}")

    return df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
