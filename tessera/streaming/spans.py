"""Span aggregates over streams: windowed calls by service, with late spans dropped by watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.enrich import OUTBOUND


def remote_windows(spans: DataFrame, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """(start, end, service, n, total_ms, max_ms) of outbound spans by event time; the same for a batch and for closed windows of a stream."""
    source = spans.withWatermark("start_time", late) if spans.isStreaming else spans
    out = source.filter(F.col("kind").isin(*OUTBOUND)).groupBy(F.window("start_time", window).alias("w"), "service")
    return out.agg(F.count("*").alias("n"), F.sum("latency_ms").alias("total_ms"), F.max("latency_ms").alias("max_ms")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "service", "n", "total_ms", "max_ms")
