"""An extension: counts over event streams. The capability set at hand is batch only; nothing else depends on this."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, at: str = "ts", by: str = "event_type", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events and their summed value for each tumbling window and kind; works on a static table and on a stream."""
    w = events.withColumn("__at", F.col(at).cast("timestamp")).withWatermark("__at", late)
    return w.groupBy(F.window("__at", width).alias("w"), by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), by, "n", "total")
