"""Degrees over a stream of edges, as windowed counts behind a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_degrees(edges: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, id, degree) of a streaming or batch table of edges (ts, src, dst): out-edges of each vertex per window; edges later than `late` no longer count."""
    counted = edges.withWatermark("ts", late).groupBy(F.window("ts", window), F.col("src").alias("id")).agg(F.count("*").alias("degree"))
    return counted.select(F.col("window.start").alias("start"), "id", "degree")
