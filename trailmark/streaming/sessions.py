"""Session windows over a stream of check-ins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def live_sessions(checkins: DataFrame, gap: str = "6 hours", lateness: str = "1 day") -> DataFrame:
    """Sessions of each user (start, end, stops) from a streaming or a batch table of check-ins.

    A check-in exactly ``gap`` after the last one still belongs to its session.  On a stream a session is sent once
    the watermark has passed its end; check-ins later than ``lateness`` are dropped."""
    rows = checkins.withWatermark("Time", lateness) if checkins.isStreaming else checkins
    window = F.session_window("Time", gap)
    out = rows.groupBy("UId", window.alias("w")).agg(F.count(F.lit(1)).alias("stops"), F.min("Time").alias("session_start_time"), F.max("Time").alias("session_end_time"))
    return out.select("UId", "session_start_time", "session_end_time", "stops")
