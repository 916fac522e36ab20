"""Detectors over streams: stateless verdicts, and hazards counted in event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import admission


def stream_hazards(stream: DataFrame, column: str, families: tuple[str, ...] | None = None) -> DataFrame:
    """One row per hazard of a streaming table; detectors keep no state."""
    return admission.hazards(stream, column, families)


def windowed_hazards(
    stream: DataFrame, column: str, time_col: str, window: str = "5 minutes", late: str = "10 minutes", families: tuple[str, ...] | None = None
) -> DataFrame:
    """Hazards by family in tumbling windows; rows later than ``late`` are left out."""
    found = stream_hazards(stream.withWatermark(time_col, late), column, families)
    counts = found.groupBy(F.window(time_col, window), "family").agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("window.start").alias("start"), "family", "n")
