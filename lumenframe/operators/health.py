"""Consistency and health: checks are rows ``component, check, ok, issue``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: hours after which files of a kind are cleaned up
MAINTENANCE_HOURS = {"cache": 7 * 24, "temp": 24, "log": 30 * 24}


def valid_keyframe() -> Column:
    """Three non-empty strings and an id."""
    text = [F.coalesce(F.length(c) > 0, F.lit(False)) for c in ("folder_name", "image_name", "file_path")]
    return text[0] & text[1] & text[2] & F.col("frame_id").isNotNull()


def consistency(index: DataFrame, metadata: DataFrame, key: str, valid: Column) -> DataFrame:
    """Sizes, rows without a partner on either side, invalid rows, and the verdict; one row."""
    both = index.select(F.col(key), F.lit(True).alias("in_index")).join(metadata.select(F.col(key), valid.alias("ok"), F.lit(True).alias("in_meta")), key, "full_outer")
    c = both.agg(
        F.count("in_index").alias("index_rows"), F.count("in_meta").alias("metadata_rows"),
        F.count_if(F.col("in_meta").isNull()).alias("missing_metadata"), F.count_if(F.col("in_index").isNull()).alias("orphan_metadata"),
        F.count_if(F.col("in_meta").isNotNull() & ~F.col("ok")).alias("invalid_rows"),
    )
    good = (F.col("missing_metadata") == 0) & (F.col("orphan_metadata") == 0) & (F.col("invalid_rows") == 0)
    advice = F.when(good, "none").when(F.col("missing_metadata") + F.col("orphan_metadata") > 0, "rebuild").otherwise("repair")
    return c.withColumn("consistent", good).withColumn("recommendation", advice)


def rollup(checks: DataFrame) -> DataFrame:
    """Whether every component is healthy, the prefixed issues, the rate, and recovery options by keyword; one row."""
    issue = F.when(~F.col("ok"), F.concat_ws(": ", "component", "issue"))
    r = checks.agg(
        F.bool_and("ok").alias("healthy"), F.array_join(F.sort_array(F.collect_list(issue)), "; ").alias("issues"),
        F.round(F.avg(F.col("ok").cast("double")), 6).alias("health_rate"),
    )
    hint = F.when(F.col("issues").contains("missing"), "rebuild").when(F.col("issues").contains("invalid"), "repair").when(F.col("issues") != "", "inspect").otherwise("none")
    return r.withColumn("recovery", hint)


def gates(rows: DataFrame, checks: dict[str, tuple[Column, str]], component: str) -> DataFrame:
    """Stage gates as check rows: each condition is an aggregate over ``rows``."""
    one = rows.agg(*[c.alias(f"c{i}") for i, (c, _) in enumerate(checks.values())])
    parts = [F.struct(F.lit(component).alias("component"), F.lit(n).alias("check"), F.col(f"c{i}").alias("ok"), F.lit(issue).alias("issue")) for i, (n, (_, issue)) in enumerate(checks.items())]
    return one.select(F.inline(F.array(*parts)))


def assert_unique(df: DataFrame, key: str) -> None:
    if not df.groupBy(key).count().where("count > 1").isEmpty():
        raise ValueError(f"duplicate values of {key}")


def registry(announcements: DataFrame, now: Column, timeout: str, self_id=None) -> DataFrame:
    """Newest announcement per node, expired ones marked offline; an own node is ignored."""
    rows = announcements if self_id is None else announcements.where(F.col("node_id") != self_id)
    latest = rows.groupBy("node_id").agg(F.max("last_seen").alias("last_seen"), F.max_by("status", F.struct("last_seen", "seq")).alias("status"), F.count("*").alias("announcements"))
    return latest.withColumn("online", F.col("last_seen") >= now - F.expr(f"interval {timeout}"))


def prune_offline(nodes: DataFrame, offline: DataFrame, local_id=None) -> DataFrame:
    """Nodes without those that are offline; the local row stays."""
    gone = offline.select("node_id") if local_id is None else offline.where(F.col("node_id") != local_id).select("node_id")
    return nodes.join(gone, "node_id", "left_anti")


def compatible_structure(expected: DataFrame, present: DataFrame, least: float = 0.8) -> DataFrame:
    """Share of the expected folders that are present, and whether it reaches ``least``."""
    found = expected.select("folder").distinct().join(present.select("folder", F.lit(1).alias("f")).distinct(), "folder", "left")
    return found.agg(F.round(F.count("f") / F.count("*"), 6).alias("present")).withColumn("compatible", F.col("present") >= least)


def sweep(nodes: DataFrame, now: Column, timeout: str = "300 seconds", local_id=None) -> DataFrame:
    """Sessions or nodes with ``silent_seconds`` and whether they are ``expired``; the local one never is."""
    silent = (F.unix_micros(now) - F.unix_micros("last_seen")) / 1e6
    late = F.col("last_seen") < now - F.expr(f"interval {timeout}")
    if local_id is not None:
        late = late & ~F.col("node_id").eqNullSafe(F.lit(local_id))
    return nodes.withColumn("silent_seconds", F.round(silent, 3)).withColumn("expired", late)


def maintenance(files: DataFrame, now: Column, ages: dict[str, int] | None = None) -> DataFrame:
    """What a clean-up would delete, by kind: ``kind, files, expired, bytes`` (a dry run).

    ``files``: ``kind, bytes, mtime``; ``ages``: hours after which a kind expires.
    """
    ages = ages or MAINTENANCE_HOURS
    limit = F.coalesce(*[F.when(F.col("kind") == k, F.lit(h)) for k, h in ages.items()])
    hours = (F.unix_micros(now) - F.unix_micros("mtime")) / 3.6e9
    gone = F.coalesce(hours > limit, F.lit(False))
    return files.groupBy("kind").agg(F.count("*").alias("files"), F.count_if(gone).alias("expired"), F.coalesce(F.sum(F.when(gone, F.col("bytes"))), F.lit(0)).cast("long").alias("bytes"))


def component_health(components: DataFrame) -> DataFrame:
    """Check rows of ``component, handlers, errors``: it has a handler, and started without an error."""
    parts = F.array(
        F.struct(F.lit("handlers").alias("check"), (F.col("handlers") > 0).alias("ok"), F.lit("missing handlers").alias("issue")),
        F.struct(F.lit("errors").alias("check"), (F.col("errors") == 0).alias("ok"), F.concat(F.col("errors").cast("string"), F.lit(" errors at start")).alias("issue")),
    )
    return components.select("component", F.explode(parts).alias("c")).select("component", "c.check", "c.ok", "c.issue")


def retriever_health(frames: DataFrame, metadata: DataFrame) -> DataFrame:
    """Check rows of an index and its metadata: rows, one dimension, finite vectors, ids once, a row for each vector."""
    size = F.size("v")
    finite = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    one = gates(frames, {
        "rows": (F.count("*") > 0, "missing rows"),
        "dimension": (F.min(size) == F.max(size), "invalid dimensions"),
        "finite": (F.bool_and(F.coalesce(finite, F.lit(False))), "invalid vectors"),
        "ids": (F.count("*") == F.count_distinct("frame_id"), "invalid ids"),
    }, "retriever")
    lone = frames.select("frame_id").join(metadata.select(F.col("frame_id").alias("m")), F.col("frame_id") == F.col("m"), "left_anti")
    two = gates(lone, {"partners": (F.count("*") == 0, "missing metadata")}, "metadata")
    return one.unionByName(two)


def build_gates(files: DataFrame, *, free_bytes: int, index_bytes: int | None = None, least_images: int = 10) -> DataFrame:
    """Check rows before and after a build: folders, images, free disk, and the size of the index where there is one."""
    checks = {
        "folders": (F.count_distinct("folder") >= 1, "missing folders"),
        "images": (F.count("*") >= least_images, "missing images"),
        "disk": (F.lit(free_bytes >= 1 << 30), "under 1 GB of disk free"),
    }
    if index_bytes is not None:
        checks["index"] = (F.lit(index_bytes >= 1000), "invalid index file")
    return gates(files, checks, "build")
