"""Daily label counts over a stream of articles, and incremental runs over what is new."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_counts(stream: DataFrame, late: str = "2 days") -> DataFrame:
    """(day, label, articles): tumbling days with a watermark; rows later than ``late`` are dropped by it."""
    day = F.window("ts", "1 day")
    counts = stream.withWatermark("ts", late).groupBy(day, "label").agg(F.count("*").alias("articles"))
    return counts.select(F.to_date("window.start").alias("day"), "label", "articles")


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process what has arrived since the last run and stop; the checkpoint holds how far runs have come."""
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(path)
    query.awaitTermination()
