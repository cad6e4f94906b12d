"""Event-time windows; the same functions take batch and streaming frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _counted(frame: DataFrame, window, by: list[str]) -> DataFrame:
    out = frame.groupBy(window.alias("w"), *by).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n")


def tumbling(frame: DataFrame, ts: str, size: str, by: list[str], late: str | None = None) -> DataFrame:
    """Rows by window and key. late: how long a stream waits for late rows."""
    return _counted(frame.withWatermark(ts, late) if late else frame, F.window(ts, size), by)


def sliding(frame: DataFrame, ts: str, size: str, slide: str, by: list[str], late: str | None = None) -> DataFrame:
    return _counted(frame.withWatermark(ts, late) if late else frame, F.window(ts, size, slide), by)


def sessions(frame: DataFrame, ts: str, gap: str, by: list[str], late: str | None = None) -> DataFrame:
    return _counted(frame.withWatermark(ts, late) if late else frame, F.session_window(ts, gap), by)
