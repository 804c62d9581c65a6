"""Performance logs, frame lists and search results that come as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def performance_log(spark: SparkSession, path: str) -> DataFrame:
    """``operation, duration, ts`` of lines ``<time> | {json}``; other lines are dropped."""
    raw = spark.read.text(path).select(F.regexp_extract("value", r"\|\s*(\{.*\})\s*$", 1).alias("j"))
    parsed = raw.where("j <> ''").select(F.from_json("j", "operation string, duration double, timestamp string").alias("p"))
    stamp = F.coalesce(F.timestamp_seconds(F.col("p.timestamp").try_cast("double")), F.try_to_timestamp("p.timestamp"))
    return parsed.where("p.operation is not null").select("p.operation", "p.duration", stamp.alias("ts"))


def log_line(event: Column, when: Column) -> Column:
    """The line format of the performance log."""
    return F.concat(F.date_format(when, "yyyy-MM-dd HH:mm:ss"), F.lit(" | "), F.to_json(event))


def frame_list(spark: SparkSession, path: str) -> DataFrame:
    """Frame references of a CSV list: ``id, folder_name, frame_id, file_path`` with defaults."""
    df = spark.read.csv(path, header=True)
    get = lambda c, default: F.coalesce(F.col(c), F.lit(default)) if c in df.columns else F.lit(default)
    folder, frame = get("folder_name", "unknown"), get("frame_id", "0")
    return df.select(F.concat_ws(":", folder, frame).alias("id"), folder.alias("folder_name"), frame.alias("frame_id"), get("file_path", "").alias("file_path"))
