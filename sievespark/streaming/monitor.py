"""Scanning streams: scanners hold no state, so only the flag rates need a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievespark import schema as S
from sievespark.plans.pipeline import Pipeline


def scan_stream(stream: DataFrame, pipeline: Pipeline, text: str = "text") -> DataFrame:
    """Append mode; restarts give the same matches."""
    return pipeline.scan(stream, text)


def flag_rates(scanned: DataFrame, time: str, late: str = "10 minutes", window: str = "5 minutes", slide: str | None = None) -> DataFrame:
    """Texts scanned, flagged and refused in each window; rows later than ``late`` are dropped by the watermark."""
    by = F.window(time, window, slide) if slide else F.window(time, window)
    m = F.col("matches")
    return scanned.withWatermark(time, late).groupBy(by).agg(F.count(F.lit(1)).alias("scanned"), F.count_if(S.flagged(m)).alias("flagged"), F.count_if(S.should_refuse(m)).alias("refused"))
