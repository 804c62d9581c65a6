"""Directory scans, inventories and image validity, on Spark's binary file source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenframe import storage

EXTENSIONS = ("jpg", "jpeg", "png", "bmp", "tiff", "webp")
MAX_IMAGE_BYTES = 100 * 1024 * 1024


def _files(spark: SparkSession, root: str, **options) -> DataFrame:
    return spark.read.format("binaryFile").options(recursiveFileLookup="true", **options).load(root)


def supported(path: Column) -> Column:
    return F.lower(F.element_at(F.split(path, r"\."), -1)).isin(*EXTENSIONS)


def keyframe_files(spark: SparkSession, root: str) -> DataFrame:
    """One row per supported image one folder deep: ``folder, name, stem, extension, path, bytes, pos``.

    Within a folder the order is numeric if all stems are numbers, else by name.
    Contents are not read: only listing columns are selected.
    """
    f = _files(spark, root).select("path", F.col("length").alias("bytes"))
    parts = F.split("path", "/")
    f = f.where(supported(F.col("path"))).withColumn("folder", F.element_at(parts, -2)).withColumn("name", F.element_at(parts, -1))
    f = f.withColumn("stem", F.regexp_extract("name", r"^(.*)\.[^.]*$", 1)).withColumn("extension", F.lower(F.regexp_extract("name", r"\.([^.]*)$", 1)))
    return numbered(f)


def inventory(spark: SparkSession, root: str, pattern: str = "*.jpg") -> DataFrame:
    """``path`` (relative), ``hash`` (16 hex digits of SHA-256), ``size, mtime``."""
    prefix = root.rstrip("/") + "/"
    path = F.col("path")
    relative = path.substr(F.locate(prefix, path) + len(prefix), F.length(path))
    return _files(spark, root, pathGlobFilter=pattern).select(
        relative.alias("path"), F.substring(F.sha2("content", 256), 1, 16).alias("hash"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime")
    )


def size_ok(length: Column) -> Column:
    return length.between(1, MAX_IMAGE_BYTES)


def valid_files(spark: SparkSession, root: str, least_side: int = 1) -> DataFrame:
    """``keyframe_files`` without those that are empty, too large or can't be decoded.

    Positions are numbered again over what is left; a folder without a valid
    image is gone.
    """
    listed = keyframe_files(spark, root).where(size_ok(F.col("bytes")))
    same = lambda path: F.regexp_replace(path, "^([a-z0-9+]+):/+", "$1:/")  # noqa: E731  the two sources write a scheme's slashes differently
    good = images(spark, root, least_side).select(same("path").alias("__path")).distinct()
    return numbered(listed.drop("pos").join(good, same("path") == F.col("__path"), "left_semi"))


def numbered(files: DataFrame) -> DataFrame:
    """``pos`` within the folder: by number if all stems are numbers, else by name."""
    number = F.col("stem").try_cast("long")
    files = files.withColumn("__n", F.when(F.min(number.isNotNull()).over(Window.partitionBy("folder")), number))
    return files.withColumn("pos", F.row_number().over(Window.partitionBy("folder").orderBy("__n", "stem")) - 1).drop("__n")


def images(spark: SparkSession, root: str, least_side: int = 32) -> DataFrame:
    """Decoded images that are not smaller than ``least_side``: ``path, width, height, channels, data`` (BGR rows)."""
    i = spark.read.format("image").option("dropInvalid", True).option("recursiveFileLookup", "true").load(root)
    i = i.select(F.col("image.origin").alias("path"), F.col("image.width").alias("width"), F.col("image.height").alias("height"), F.col("image.nChannels").alias("channels"), F.col("image.data").alias("data"))
    return i.where((F.col("width") >= least_side) & (F.col("height") >= least_side)).withColumn("oversize", F.greatest("width", "height") > 4096)


def expired(files: DataFrame, now: Column, hours: int) -> DataFrame:
    """Files older than so many hours."""
    return files.where(F.col("mtime") < now - F.expr(f"interval {hours} hours"))


def clean_up(spark: SparkSession, root: str, now: Column, hours: int, *, dry_run: bool = True) -> int:
    """Number of expired files under ``root``; without ``dry_run`` they are deleted, through any file system."""
    gone = expired(_files(spark, root).select("path", F.col("modificationTime").alias("mtime")), now, hours).select("path")
    if dry_run:
        return gone.count()
    return sum(storage.delete(spark, r["path"]) for r in gone.toLocalIterator())


def shares(paths: DataFrame, node: str) -> DataFrame:
    """Registry rows of shared folders and containers: ``share_id, node, path, kind``."""
    kind = F.when(F.col("path").rlike(r"\.lumen/?$"), "index").otherwise("folder")
    return paths.select(F.substring(F.md5("path"), 1, 12).alias("share_id"), F.lit(node).alias("node"), "path", kind.alias("kind")).distinct()


def add_shares(registry: DataFrame, added: DataFrame) -> DataFrame:
    """The registry with shares it lacks; one that is known stays as it is."""
    return registry.unionByName(added.join(registry.select("share_id"), "share_id", "left_anti"))


def remove_shares(registry: DataFrame, share_ids: list[str]) -> DataFrame:
    return registry.where(~F.col("share_id").isin(*share_ids)) if share_ids else registry


def shares_of(registry: DataFrame, node: str, kind: str | None = None) -> DataFrame:
    found = registry.where(F.col("node") == node)
    return found if kind is None else found.where(F.col("kind") == kind)
