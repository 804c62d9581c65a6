"""Operational statistics over events ``ts, operation, duration, client``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_n(events: DataFrame, key: str, n: int) -> DataFrame:
    """The newest ``n`` events per key, numbered from the newest (``rn``)."""
    w = Window.partitionBy(key).orderBy(F.desc("ts"), F.desc("event_id"))
    return events.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n)


def latency_stats(events: DataFrame, slow: float = 5.0, window: int = 1000, recent: int = 50) -> DataFrame:
    """Per operation over its last ``window`` events; slow events are counted over all of them."""
    d = F.col("duration")
    r = lambda c: F.round(c, 4)
    kept = last_n(events, "operation", window).groupBy("operation").agg(
        F.count("*").alias("count"), r(F.sum(d)).alias("total"), r(F.avg(d)).alias("avg"), r(F.min(d)).alias("min"), r(F.max(d)).alias("max"),
        r(F.stddev_pop(d)).alias("std"), r(F.percentile(d, F.lit(0.5))).alias("median"), r(F.percentile(d, F.lit(0.95))).alias("p95"),
        r(F.avg(F.when(F.col("rn") <= recent, d))).alias("recent_avg"),
    )
    slows = events.groupBy("operation").agg(F.count_if(d > slow).alias("slow_count"))
    return kept.join(slows, "operation")


def slow_rollup(events: DataFrame, slow: float, now: Column) -> DataFrame:
    """Count, average and maximum of slow events, and how many fell into the hour before ``now``."""
    s = events.where(F.col("duration") > slow)
    return s.agg(
        F.count("*").alias("slow_count"), F.round(F.avg("duration"), 4).alias("slow_avg"), F.round(F.max("duration"), 4).alias("slow_max"),
        F.count_if(F.col("ts") > now - F.expr("interval 1 hour")).alias("last_hour"),
    )


def _window_stats(events: DataFrame, key: str, window: int, places: int = 4) -> tuple[DataFrame, DataFrame]:
    kept = last_n(events, key, window)
    return kept, kept.groupBy(key).agg(F.count("*").alias("count"), F.round(F.sum("duration"), 4).alias("total"), F.round(F.avg("duration"), places).alias("avg"), F.countDistinct("operation").alias("operations"))


def client_stats(events: DataFrame, window: int = 500) -> DataFrame:
    """Per client over its last events: totals, distinct operations and the commonest (ties: first by name)."""
    kept, totals = _window_stats(events, "client", window)
    counts = kept.groupBy("client", "operation").agg(F.count("*").alias("n"))
    w = Window.partitionBy("client").orderBy(F.desc("n"), "operation")
    common = counts.withColumn("k", F.row_number().over(w)).where("k = 1").select("client", F.col("operation").alias("most_common"))
    return totals.join(common, "client")


def team_stats(events: DataFrame, window: int = 200) -> DataFrame:
    """Per ``team`` over its last events: totals, distinct operations and distinct members."""
    kept, totals = _window_stats(events, "team", window, 6)
    members = kept.groupBy("team").agg(F.countDistinct("client").alias("members"))
    return totals.join(members, "team")


def error_counts(events: DataFrame, error: str = "error_type", operation: str = "operation") -> DataFrame:
    return events.groupBy(F.concat_ws(":", error, operation).alias("error")).agg(F.count("*").alias("count"))


def global_rollup(events: DataFrame, slow: float, now: Column) -> DataFrame:
    """Totals, uptime in hours and alarms of the monitor itself."""
    totals = events.agg(
        F.count("*").alias("events"), F.countDistinct("operation").alias("operations"), F.count_if(F.col("duration") > slow).alias("slow"),
        F.count_if((F.col("duration") > slow) & (F.col("ts") > now - F.expr("interval 1 hour"))).alias("recent_slow"),
        F.round((F.unix_timestamp(F.max("ts")) - F.unix_timestamp(F.min("ts"))) / 3600, 4).alias("uptime_hours"),
    )
    return totals.withColumn("healthy", (F.col("slow") <= 10) & (F.col("recent_slow") <= 5))


def monitor_alarms(slow: Column, errors: Column, recent_slow: Column, timers: Column) -> Column:
    """Names of the monitor's alarms: over 10 slow operations, 50 errors, 5 slow ones lately, 100 open timers."""
    limits = (("slow_operations", slow, 10), ("errors", errors, 50), ("recent_slow", recent_slow, 5), ("open_timers", timers, 100))  # fixed values
    return F.array_compact(F.array(*[F.when(c > n, F.lit(name)) for name, c, n in limits]))


def monitor_health(events: DataFrame, now: Column, slow: float = 5.0) -> DataFrame:
    """One row of a log with ``error`` and ``open`` (a timer without a stop): its counts and alarms."""
    c = events.agg(
        F.count_if(F.col("duration") > slow).alias("slow"), F.count_if("error").alias("errors"),
        F.count_if((F.col("duration") > slow) & (F.col("ts") > now - F.expr("interval 1 hour"))).alias("recent_slow"), F.count_if("open").alias("timers"),
    )
    return c.withColumn("alarms", F.array_join(monitor_alarms(*map(F.col, ("slow", "errors", "recent_slow", "timers"))), ","))


def index_stats(frames: DataFrame) -> DataFrame:
    """One row: frames, folders, dimension, bytes of the vectors, frames without one."""
    size = F.coalesce(F.size("v"), F.lit(0))
    return frames.agg(
        F.count("*").alias("frames"), F.countDistinct("folder").alias("folders"), F.max(size).cast("long").alias("dimension"),
        F.sum(size * 4).cast("long").alias("vector_bytes"), F.count_if(F.col("v").isNull()).alias("without_vector"),
    )


def folder_stats(files: DataFrame) -> DataFrame:
    """Files per folder with the share of all (one row per folder)."""
    per = files.groupBy("folder").agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"))
    total = per.agg(F.sum("files").alias("all_files"))
    return per.crossJoin(F.broadcast(total)).withColumn("share", F.round(F.col("files") / F.col("all_files"), 6))  # one row


def structure_profile(files: DataFrame, sample_folders: int = 3, sample_files: int = 5) -> DataFrame:
    """Folders, files, extensions, and the first files of the first folders."""
    total = files.agg(F.countDistinct("folder").alias("folders"), F.count("*").alias("files"), F.array_join(F.sort_array(F.collect_set("extension")), ",").alias("extensions"))
    first = files.select("folder").distinct().orderBy("folder").limit(sample_folders)
    w = Window.partitionBy("folder").orderBy("name")
    names = files.join(F.broadcast(first), "folder").withColumn("k", F.row_number().over(w)).where(F.col("k") <= sample_files)
    samples = names.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("folder", "name"))), lambda s: F.concat_ws("/", s["folder"], s["name"])), ",").alias("samples"))
    return total.crossJoin(samples)  # one row each


def cache_stats(log: DataFrame) -> DataFrame:
    """Hit rate of a cache log (``hit`` boolean) and the alarm of a low one.

    With ``used`` and ``budget`` bytes in the log, the greatest share in use.
    """
    used = [F.round(100 * F.max(F.col("used") / F.col("budget")), 2).alias("memory_percent")] if "used" in log.columns else []
    s = log.agg(F.count("*").alias("requests"), F.count_if("hit").alias("hits"), *used)
    rate = F.round(F.col("hits") / F.greatest("requests", F.lit(1)), 3)
    return s.withColumn("hit_rate", rate).withColumn("low_hit_rate", (F.col("requests") > 100) & (F.col("hits") / F.col("requests") < 0.1))


def compression_ratio(files: DataFrame, dimension: int = 512) -> DataFrame:
    """Estimated uncompressed size over actual size, at least 1."""
    per_row = dimension * 4 + 200 + 5_000 + 50_000  # fixed values: vector, metadata, thumbnail and image bytes
    s = files.agg(F.count("*").alias("rows"), F.sum("bytes").alias("actual"))
    return s.withColumn("ratio", F.round(F.greatest(F.lit(1.0), F.col("rows") * per_row / F.greatest("actual", F.lit(1))), 4))
