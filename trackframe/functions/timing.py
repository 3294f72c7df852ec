"""Time as seconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seconds(ts: Column) -> Column:
    """A naive timestamp as seconds since 1970, whatever the session's time zone."""
    return F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), ts.cast("timestamp_ntz")) / 1e6


def frame_time(pts: Column, time_base: Column, position: Column, rate: Column, fallback: float = 25.0) -> Column:
    """Presentation time, or the position over the average rate (``fallback`` if unknown)."""
    return F.coalesce(pts * time_base, position / F.coalesce(rate, F.lit(fallback)))


def elapsed_ms(start: Column, end: Column) -> Column:
    """Whole milliseconds, truncated."""
    return ((end - start) * 1000).cast("long")
