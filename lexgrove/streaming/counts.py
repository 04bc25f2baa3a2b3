"""Counts of labels by event time, for streams and batches alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def label_counts(events: DataFrame, label: str, time: str = "ts", late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """(window, label, n) of events in windows of event time; late rows beyond the bound are dropped in streams."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), label).agg(F.count(F.lit(1)).alias("n"))
