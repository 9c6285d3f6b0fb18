"""Streams: windowed levels with a watermark, an append-only work queue, and a compressor whose state outlives a chunk."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earshot.streaming.chunks import Compressing, in_order


def windowed_levels(events: DataFrame, *, late: str = "10 minutes", size: str = "5 minutes", slide: str | None = None) -> DataFrame:
    """Count and RMS of ``value`` by window and event type; rows later than the watermark are left out."""
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    grouped = events.withWatermark("ts", late).groupBy(window.alias("w"), "event_type")
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(F.col("value") * F.col("value"))).alias("rms")).select("w.start", "w.end", "event_type", "n", "rms")


def sessions(events: DataFrame, *, gap: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of each user."""
    grouped = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id")
    return grouped.agg(F.count(F.lit(1)).alias("n")).select("w.start", "w.end", "user_id", "n")


def compressed_chunks(chunks: DataFrame, *, rate: float, wait_ms: int = 60_000, **settings: float) -> DataFrame:
    """Chunks of signals (``signal_id``, ``chunk`` from 0, ``x``), in any order, through a compressor that carries its gain and window on; see ``chunks.in_order``."""
    return in_order(chunks, Compressing(rate, **settings), wait_ms=wait_ms)
