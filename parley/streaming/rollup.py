"""Metrics of a running stream of spans, per window of event time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.operators.instruments import histograms, observations


def windowed_histograms(measured: DataFrame, ts: str = "ts", window: str = "1 minute",
                        lateness: str = "10 minutes") -> DataFrame:
    """Histograms per window. Works on a static and on a streaming DataFrame alike."""
    timed = measured.withWatermark(ts, lateness).withColumn("window", F.window(ts, window))
    return histograms(observations(timed), by=("window",))
