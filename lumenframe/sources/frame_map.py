"""Frame maps: CSV files that give each image of a video its frame id."""

from __future__ import annotations

import csv
import io

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenframe.storage import exists

# fixed values: recognised column names
IMAGE_COLUMNS = ("n", "image", "image_name", "img", "name")
FRAME_COLUMNS = ("frame_idx", "frame_id", "frame", "idx", "id")
MAX_BYTES = 50 * 1024 * 1024


def _number(text: str) -> float | None:
    try:
        return float(text)
    except ValueError:
        return None


def _columns(first: list[str], second: list[str]) -> tuple[bool, int, int] | None:
    """Whether there is a header, and the image and frame columns."""
    header = any(c.strip() and _number(c) is None for c in first)
    if not header:
        return (False, 0, 3) if len(first) >= 4 else (False, 0, 1) if len(first) >= 2 else None
    names = [c.strip().lower() for c in first]
    image = next((i for i in reversed(range(len(names))) if names[i] in IMAGE_COLUMNS), 0)
    frame = next((i for i in reversed(range(len(names))) if names[i] in FRAME_COLUMNS), None)
    if frame is None:
        numeric = [i for i in range(image + 1, len(names)) if i < len(second) and _number(second[i]) is not None]
        frame = numeric[0] if numeric else len(names) - 1
    return True, image, frame


def read_map(spark: SparkSession, path: str) -> DataFrame:
    """``image, frame_id`` of one map.

    Missing, empty and oversized files give no rows.  Numeric image ids are padded to
    three digits, rows without one are skipped, a missing or negative frame
    becomes the row number (from 1), and of equal images the last row wins.
    Only the first two lines come to the driver, to find the columns.
    """
    empty = spark.createDataFrame([], "image string, frame_id long")
    if not exists(spark, path):
        return empty
    size = spark.read.format("binaryFile").load(path).select("length").first()
    if size is None or not 0 < size[0] <= MAX_BYTES:
        return empty
    lines = spark.read.text(path).limit(2).collect()
    rows = list(csv.reader(io.StringIO("\n".join(r[0] for r in lines))))
    chosen = _columns(rows[0], rows[1] if len(rows) > 1 else []) if rows else None
    if chosen is None:
        return empty
    header, image, frame = chosen
    width = len(rows[0])
    raw = spark.read.schema(", ".join(f"c{i} string" for i in range(width))).csv(path, header=header)
    raw = raw.withColumn("__row", F.monotonically_increasing_id())
    numbered = raw.withColumn("row", F.row_number().over(Window.orderBy("__row")))  # one file of at most 50 MB
    key = F.trim(f"c{image}")
    number = key.try_cast("double")
    name = F.when(number.isNotNull() & ~F.isnan(number), F.lpad(number.try_cast("long").cast("string"), 3, "0")).otherwise(F.when(F.lower(key) != "nan", key))
    value = F.trim(f"c{frame}").try_cast("double")
    frame_id = F.when(value.isNull() | F.isnan(value) | (value < 0), F.col("row")).otherwise(value).cast("long")
    # long numbers keep all their digits: padding never cuts
    name = F.when(F.length(F.coalesce(number.try_cast("long").cast("string"), F.lit(""))) > 3, number.try_cast("long").cast("string")).otherwise(name)
    return numbered.select(name.alias("image"), frame_id.alias("frame_id"), "row").where("image is not null and image <> ''").groupBy("image").agg(F.max_by("frame_id", "row").alias("frame_id"))
