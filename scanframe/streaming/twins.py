"""Windowed aggregations that mean the same on a table and on a stream.

On a stream, put a watermark on ``ts`` first; the functions below are plain aggregations either way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanframe.operators import hot, ordered


def hot_tile_windows(hits: DataFrame, duration: str, min_hits: int = 1) -> DataFrame:
    """Tiles in focus at least ``min_hits`` times per window of the capture."""
    return (hits.groupBy(F.window("ts", duration).alias("w"), *hot.TILE).agg(F.count(F.lit(1)).alias("hits"))
            .filter(F.col("hits") >= max(1, min_hits)).select(F.col("w.start").alias("window_start"), *hot.TILE, "hits"))


def throttle(frames: DataFrame, keys: list[str], max_fps: float) -> DataFrame:
    """First frame per slot of 1/max_fps seconds."""
    slot = F.floor(F.unix_micros("ts") / F.lit(1e6 / max_fps)).cast("bigint")
    return frames.groupBy(*keys, slot.alias("slot")).agg(F.min("frame_id").alias("frame_id"))


def scan_sessions(events: DataFrame, idle: str) -> DataFrame:
    """Activity of a sample separated by idle time."""
    return (events.groupBy("sample_id", F.session_window("ts", idle).alias("s"))
            .agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last_ts"))
            .select("sample_id", F.col("s.start").alias("session_start"), "last_ts", "n"))


def scan_sessions_of_table(events: DataFrame, idle: str) -> DataFrame:
    """``scan_sessions`` for tables: no task holds a sample, which may have a third of all events.

    Events are numbered by ranges, a session starts where the time since the one before is ``idle`` or more, and its number is
    a running sum of the starts.
    """
    numbered = ordered.range_index(events.select("sample_id", "ts"), ["sample_id"], ["ts"], "place")
    near = ordered.with_neighbours(numbered, ["sample_id"], "place", lambda w: {"before": F.lag("ts").over(w)}, before=1)
    starts = F.when(F.col("before").isNull() | (F.col("ts") >= F.col("before") + F.expr(f"INTERVAL {idle}")), 1).otherwise(0)
    counted = ordered.running(near, ["sample_id"], "place", {"session": ("sum", starts)})
    return counted.groupBy("sample_id", "session").agg(F.min("ts").alias("session_start"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("n")).drop("session")


def rolling_focus(series: DataFrame, length: str, slide: str) -> DataFrame:
    """Focus counts over sliding windows."""
    return (series.groupBy("sample_id", F.window("ts", length, slide).alias("w"))
            .agg(F.avg("hard").alias("mean_hard"), F.max("soft").alias("max_soft"), F.count(F.lit(1)).alias("n"))
            .select("sample_id", F.col("w.start").alias("window_start"), "mean_hard", "max_soft", "n"))


def latest_capture(captures: DataFrame, keys: list[str]) -> DataFrame:
    """Newest capture per key; a still wins a tie."""
    best = F.max_by(F.struct("source", "ts", "event_id"), F.struct("ts", F.col("source") == "still", "event_id"))
    return captures.groupBy(*keys).agg(best.alias("c")).select(*keys, "c.source", "c.ts", "c.event_id")
