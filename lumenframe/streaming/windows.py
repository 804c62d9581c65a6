"""Event-time windows, sessions, timers and the node registry on streams (and, unchanged, on batches)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latency_windows(events: DataFrame, size: str = "1 day", slide: str | None = None, late: str | None = None) -> DataFrame:
    """Count, total and maximum per operation and window; ``late`` sets the watermark of a stream."""
    e = events.withWatermark("ts", late) if late else events
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    g = e.groupBy(w.alias("w"), "operation").agg(F.count("*").alias("n"), F.round(F.sum("duration"), 4).alias("total"), F.max("duration").alias("most"))
    return g.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "operation", "n", "total", "most")


def sessions(events: DataFrame, gap: str = "6 hours", late: str | None = None) -> DataFrame:
    """Sessions per client; events exactly one gap apart stay together."""
    e = events.withWatermark("ts", late) if late else events
    g = e.groupBy(F.session_window("ts", gap).alias("w"), "client").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    return g.select("client", "first_ts", "last_ts", "n")


def pair_timers(starts: DataFrame, stops: DataFrame, longest: str = "1 hour", late: str | None = None) -> DataFrame:
    """``timer_id, duration`` of start and stop events by id; a stop pairs with a start at most ``longest`` before it."""
    a = starts.select(F.col("timer_id"), F.col("ts").alias("start_ts"))
    b = stops.select(F.col("timer_id").alias("stop_id"), F.col("ts").alias("stop_ts"))
    if late:
        a, b = a.withWatermark("start_ts", late), b.withWatermark("stop_ts", late)
    ok = (F.col("timer_id") == F.col("stop_id")) & (F.col("stop_ts") >= F.col("start_ts")) & (F.col("stop_ts") <= F.col("start_ts") + F.expr(f"interval {longest}"))
    return a.join(b, ok).select("timer_id", ((F.unix_micros("stop_ts") - F.unix_micros("start_ts")) / 1e6).alias("duration"))


def registry_updates(announcements: DataFrame) -> DataFrame:
    """Newest announcement per node, for the update mode of a stream."""
    return announcements.groupBy("node_id").agg(F.max("last_seen").alias("last_seen"), F.max_by("status", "last_seen").alias("status"))


def new_content(files: DataFrame, late: str | None = None) -> DataFrame:
    """Incremental ingest: each content hash once, whatever its path (state in the checkpoint)."""
    return files.withWatermark("mtime", late).dropDuplicatesWithinWatermark(["hash"]) if late else files.dropDuplicates(["hash"])
