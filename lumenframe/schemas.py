"""Schemas of the data model, and the views of stored tables that stand in for them."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEYFRAME = T.StructType(
    [
        T.StructField("folder_name", T.StringType(), False),
        T.StructField("image_name", T.StringType(), False),
        T.StructField("file_path", T.StringType(), False),
        T.StructField("frame_id", T.LongType(), False),
        T.StructField("sequence_position", T.IntegerType()),
        T.StructField("total_frames", T.IntegerType()),
        T.StructField("neighboring_frames", T.ArrayType(T.LongType())),
        T.StructField("scene_boundaries", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
        T.StructField("clip_features", T.ArrayType(T.FloatType())),
        T.StructField("llm_description", T.StringType()),
        T.StructField("detected_objects", T.ArrayType(T.StringType())),
        T.StructField("scene_tags", T.ArrayType(T.StringType())),
        T.StructField("confidence_score", T.DoubleType()),
        T.StructField("similar_frames", T.ArrayType(T.StringType())),
        T.StructField("transition_frames", T.ArrayType(T.StringType())),
    ]
)
FRAME_MAP_V1 = "n INT, pts_time INT, fps INT, frame_idx INT"
FRAME_MAP_V2 = "n INT, pts_time DOUBLE, fps INT, original_frame_idx INT, scene_id INT"
STRUCTURED_QUERY = "STRUCT<objects: STRING, actions: STRING, scene: STRING, time: STRING, style: STRING, mood: STRING, clip_prompt: STRING, confidence: DOUBLE, language: STRING>"
PERFORMANCE_EVENT = "operation STRING, duration DOUBLE, ts TIMESTAMP"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A stored table; NTZ timestamps become timestamps (session zone UTC)."""
    df = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    ntz = [f.name for f in df.schema if isinstance(f.dataType, T.TimestampNTZType)]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in ntz}) if ntz else df


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``folder, frame_id, v``: vectors as keyframes, in double precision."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("label").alias("folder"), F.col("vec_id").alias("frame_id"), F.col("embedding").cast("array<double>").alias("v"))


def performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``event_id, ts, operation, duration, client``."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", "ts", F.col("event_type").alias("operation"), F.col("value").alias("duration"), F.col("user_id").alias("client"))


def inventories(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Current and stored file inventory ``(path, hash)``, derived from documents."""
    current = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.md5("text").alias("hash"))
    kept = current.where("path % 7 <> 0").withColumn("hash", F.when(F.col("path") % 11 == 0, F.concat("hash", F.lit("x"))).otherwise(F.col("hash")))
    gone = current.where("path % 13 = 0").select((F.col("path") + 1_000_000).alias("path"), "hash")
    return current, kept.unionByName(gone)
