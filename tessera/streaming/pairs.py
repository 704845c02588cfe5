"""Pairs that arrive as a stream: classified as they come, and counted in event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import pairs


def classified_counts(stream: DataFrame, limits: DataFrame, time: str, width: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """(rg, chr1, start1, ..., time) -> (window, chr, svtype, n). ``limits`` is a small static table; rows later than ``late`` are left out."""
    got = pairs.discordant(pairs.classify(stream.withWatermark(time, late), limits))
    return got.groupBy(F.window(time, width).alias("window"), F.col("chr1").alias("chr"), "svtype").agg(F.count("*").alias("n"))
