"""Daily bars of an event stream, with late events up to a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_event_bars(events: DataFrame, late: str = "2 days") -> DataFrame:
    """(date, event_type, n_events, value_sum, value_avg) of events(ts timestamp, event_type, value), batch or stream."""
    ts = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        ts = ts.withWatermark("ts", late)
    day = ts.groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n_events"), F.sum("value").alias("value_sum"), F.avg("value").alias("value_avg"))
    return day.select(F.to_date("window.start").alias("date"), "event_type", "n_events", "value_sum", "value_avg")
