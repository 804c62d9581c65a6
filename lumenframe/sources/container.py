"""Containers: frames with their vectors and bytes in one folder that grows by chunks.

Layout: ``<path>/chunks/chunk=<name>/*.parquet`` and ``<path>/manifest.json``.
A chunk is a partition that is written whole or not at all, so a build that
ends early is resumed by what its chunks hold: files whose content hash is
known are skipped, whatever their path.  The older flat layout,
``<path>/frames/*.parquet``, is read as well.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe import storage
from lumenframe.functions import encoders
from lumenframe.operators import health, ingest

VERSION = 2
#: What a result of a container may show of a frame.
RESULT_KEYS = ("folder", "frame_id", "name", "path", "score", "rank")
STEPS = ("scan", "resume", "encode", "append", "check", "finalise")

Progress = Callable[[int, int, str], None]


def _chunks(path: str) -> str:
    return f"{path}/chunks"


def manifest(spark: SparkSession, path: str) -> dict | None:
    """What the finalised container says of itself; None if it isn't finalised."""
    if not storage.exists(spark, f"{path}/manifest.json"):
        return None
    return json.loads("\n".join(r[0] for r in spark.read.text(f"{path}/manifest.json").collect()))  # a file of a few lines


def append_chunk(rows: DataFrame, path: str, chunk: str | None = None) -> None:
    """Writes rows as one chunk, or as those of their column ``chunk``.

    A chunk that was written before is replaced, so a repeated append adds nothing.
    """
    if chunk is not None:
        rows = rows.withColumn("chunk", F.lit(chunk))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("chunk").parquet(_chunks(path))


def stored_chunks(spark: SparkSession, path: str) -> DataFrame | None:
    """All rows of the chunks so far; None for a container that has none."""
    if storage.exists(spark, _chunks(path)):
        return spark.read.parquet(_chunks(path))
    return spark.read.parquet(f"{path}/frames").withColumn("chunk", F.lit("flat")) if storage.exists(spark, f"{path}/frames") else None


def remaining(files: DataFrame, path: str) -> DataFrame:
    """Files whose content the container lacks."""
    known = stored_chunks(files.sparkSession, path)
    return files if known is None else ingest.pending(files, known)


def build(
    files: DataFrame,
    path: str,
    *,
    make: Callable[[], encoders.Encoder] = encoders.HashingEncoder,
    encode: str = "content",
    chunk_rows: int = 100_000,
    commit_chunks: int = 50,
    progress: Progress | None = None,
) -> dict:
    """Appends what is new of ``files`` (``path, hash, folder, frame_id`` and the column to encode); returns the manifest.

    New rows are dealt into chunks by their hash, about ``chunk_rows`` in
    each, and committed ``commit_chunks`` at a time: a later build goes on
    after the last commit.  The bytes are joined and stored once, in a folder for each commit,
    so a commit reads its own rows alone.  Chunk names follow from the content, so the same
    build gives the same chunks.
    """
    tell = progress or (lambda step, total, what: None)
    spark, total = files.sparkSession, len(STEPS)
    tell(1, total, STEPS[0])
    # which file gives a content is decided on names and hashes, once; bytes take no part
    names = files.groupBy("hash", "path").agg(F.count("*").alias("times"))
    names = names.groupBy("hash").agg(F.min("path").alias("path"), F.max("times").alias("times"))
    tell(2, total, STEPS[1])
    new = storage.stored(remaining(names, path))
    n, times = new.agg(F.count("*"), F.max("times")).first()
    if n:
        if times > 1:  # a listing that names a file twice
            files = files.dropDuplicates(["path", "hash"])
        chunks = max(1, -(-n // chunk_rows))
        before = stored_chunks(spark, path)
        round_ = 0 if before is None else before.select("chunk").distinct().count()
        decided = new.select(F.col("hash").alias("__hash"), F.col("path").alias("__path"), F.pmod(F.xxhash64("hash"), F.lit(chunks)).cast("int").alias("__k"))
        part = files.join(decided, F.col("hash").eqNullSafe(F.col("__hash")) & F.col("path").eqNullSafe(F.col("__path"))).select(*files.columns, "__k")
        dealt = storage.dealt(part.withColumn("__commit", F.floor(F.col("__k") / F.lit(commit_chunks)).cast("int")), "__commit")
        for at in range(0, chunks, commit_chunks):
            part = dealt(at // commit_chunks)
            if part is None:
                continue
            tell(3, total, STEPS[2])
            rows = encoders.with_embeddings(part.withColumn("chunk", F.format_string("c%05d-%05d", F.lit(round_), F.col("__k"))).drop("__k"), encode, make)
            tell(4, total, STEPS[3])
            append_chunk(rows, path)
    tell(5, total, STEPS[4])
    if (rows := stored_chunks(spark, path)) is None:
        raise ValueError(f"no files and no chunks in {path}")
    health.assert_unique(rows, "hash")
    tell(6, total, STEPS[5])
    return finalise(spark, path)


def finalise(spark: SparkSession, path: str) -> dict:
    """Counts the chunks and writes the manifest last: what a reader may rely on."""
    rows = stored_chunks(spark, path)
    seen = rows.agg(
        F.count("*").alias("rows"), F.countDistinct("chunk").alias("chunks"), F.countDistinct("folder").alias("folders"),
        F.max(F.size("v")).alias("dimension"), F.count_if(F.col("v").isNull()).alias("without_vector"),
    ).first()
    said = {"version": VERSION, **seen.asDict(), "columns": sorted(rows.columns)}
    storage.write_file(spark, f"{path}/manifest.json", json.dumps(said, sort_keys=True))
    return said


def healthy(spark: SparkSession, path: str) -> bool:
    """Whether there is a manifest of a known version that agrees with the rows."""
    said = manifest(spark, path)
    rows = stored_chunks(spark, path)
    return said is not None and rows is not None and said["version"] <= VERSION and rows.count() == said["rows"]


def load(spark: SparkSession, path: str) -> tuple[dict, DataFrame]:
    """Manifest and rows, of either layout; one of a newer version or with other rows than it says is an error."""
    said = manifest(spark, path)
    rows = stored_chunks(spark, path)
    if rows is None:
        raise FileNotFoundError(f"no container in {path}")
    if said is None:
        said = {"version": 1, "rows": rows.count(), "columns": sorted(rows.columns)}
    if said["version"] > VERSION:
        raise ValueError(f"container of version {said['version']}, known is {VERSION}")
    if rows.count() != said["rows"]:
        raise ValueError(f"container has not the {said['rows']} rows of its manifest")
    return said, rows


def progressive(rows: DataFrame, size: int = 1000, order: str = "frame_id") -> Iterator[DataFrame]:
    """Parts of about ``size`` rows in ascending order, each a lazy filter on ``order``; the first comes at once.

    Bounds come from an approximate quantile sketch in one pass, so nothing
    is sorted; equal values stay together.
    """
    n = rows.count()
    parts = max(1, -(-n // size))
    bounds = [] if parts == 1 else rows.approxQuantile(order, [i / parts for i in range(1, parts)], 0.5 / parts)
    low = None
    for high in [*sorted(set(bounds)), None]:
        above = F.lit(True) if low is None else F.col(order) > low
        below = F.lit(True) if high is None else F.col(order) <= high
        yield rows.where(above & below if high is not None or low is not None else F.lit(True))
        low = high


def picture(rows: DataFrame, folder, frame_id, column: str = "content") -> bytes | None:
    """The stored bytes of one frame (image or thumbnail); both equalities reach the scan, one column is read."""
    found = ingest.lookup(rows, folder, frame_id).select(column).first()
    return None if found is None or found[0] is None else bytes(found[0])


def recover_images(wanted: DataFrame, rows: DataFrame | None, inventory: DataFrame, roots: list[str], column: str = "content", **where) -> DataFrame:
    """``wanted`` (``folder, frame_id, path``) with the stored bytes, else the first path under which the file still is.

    Adds ``content`` and ``resolved``; where there is neither, both are null.
    """
    found = ingest.resolve_paths(wanted, inventory, roots, **where)
    if rows is None:
        return found.withColumn("content", F.lit(None).cast("binary"))
    held = rows.select(F.col("folder").alias("__f"), F.col("frame_id").alias("__i"), F.col(column).alias("content"))
    return found.join(held, (F.col("folder") == F.col("__f")) & (F.col("frame_id") == F.col("__i")), "left").drop("__f", "__i")


def results(found: DataFrame) -> DataFrame:
    """The columns that a search result of a container shows; those that are absent are null."""
    return found.select(*[F.col(c) if c in found.columns else F.lit(None).cast("string").alias(c) for c in RESULT_KEYS])


def build_system(files: DataFrame, path: str, frame_map: DataFrame | None = None, *, rebuild: bool = False, **options) -> tuple[dict, DataFrame]:
    """From listed files ``path, hash, folder, stem, content`` to a checked container: manifest and rows.

    Frame ids come from the map, else from names; a healthy container is
    reused and only grows by what it lacks; one that isn't is built anew.  A
    failed build leaves the chunks it committed and no manifest, so it is
    resumed and never read as whole.
    """
    spark = files.sparkSession
    if rebuild or (manifest(spark, path) is not None and not healthy(spark, path)):
        storage.delete(spark, path)
    empty = spark.createDataFrame([], "folder string, stem string, frame_id long")
    numbered = ingest.positions(ingest.attach_frame_ids(files, frame_map if frame_map is not None else empty))
    storage.delete(spark, f"{path}/manifest.json")
    build(numbered, path, **options)
    return load(spark, path)
