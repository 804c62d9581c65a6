"""Change detection, resume, joins with frame maps, point lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.functions import text as T


def detect_changes(current: DataFrame, stored: DataFrame) -> DataFrame:
    """``path, change``: new, modified, deleted or unchanged, from ``(path, hash)`` inventories."""
    c = current.select("path", F.col("hash").alias("new_hash"), F.lit(True).alias("here"))
    s = stored.select("path", F.col("hash").alias("old_hash"), F.lit(True).alias("there"))
    change = F.when(F.col("there").isNull(), "new").when(F.col("here").isNull(), "deleted").when(~F.col("new_hash").eqNullSafe(F.col("old_hash")), "modified").otherwise("unchanged")
    return c.join(s, "path", "full_outer").select("path", change.alias("change"))


def change_ratio(changes: DataFrame, rebuild: float = 0.1) -> DataFrame:
    """Counts by change, the share of new and modified in the current files, and the decision; 0 for no files."""
    n = {k: F.count_if(F.col("change") == k) for k in ("new", "modified", "deleted", "unchanged")}
    c = changes.agg(*[v.alias(f"n_{k}") for k, v in n.items()])
    current = F.col("n_new") + F.col("n_modified") + F.col("n_unchanged")
    ratio = F.when(current == 0, 0.0).otherwise((F.col("n_new") + F.col("n_modified")) / current)
    return c.withColumn("ratio", F.round(ratio, 6)).withColumn("decision", F.when(F.col("ratio") > rebuild, "rebuild").when(F.col("n_new") + F.col("n_modified") + F.col("n_deleted") > 0, "incremental").otherwise("none"))


def apply_changes(index: DataFrame, changes: DataFrame, current: DataFrame) -> DataFrame:
    """The index after an incremental update: unchanged rows stay, new and modified ones come from ``current``."""
    stays = index.join(changes.where("change = 'unchanged'").select("path"), "path", "left_semi")
    comes = current.join(changes.where("change in ('new', 'modified')").select("path"), "path", "left_semi")
    return stays.unionByName(comes)


def pending(current: DataFrame, stored: DataFrame) -> DataFrame:
    """Files whose content is not known yet, even under another path."""
    return current.join(stored.select("hash").distinct(), "hash", "left_anti")


def attach_frame_ids(files: DataFrame, frame_map: DataFrame) -> DataFrame:
    """Files ``(folder, stem)`` with frame ids from the map, else from the name."""
    m = frame_map.select("folder", "stem", F.col("frame_id").alias("mapped"))
    return files.join(m, ["folder", "stem"], "left").withColumn("frame_id", T.frame_id(F.col("stem"), F.col("mapped"))).drop("mapped")


def positions(files: DataFrame) -> DataFrame:
    """``sequence_position`` and ``total_frames`` per folder."""
    w = Window.partitionBy("folder")
    return files.withColumn("sequence_position", F.row_number().over(w.orderBy("frame_id", "stem")) - 1).withColumn("total_frames", F.count("*").over(w).cast("int"))


def candidates(path: Column, roots: list[str], *, cwd: str | None = None, registered: dict[str, str] | None = None, parents: int = 3) -> Column:
    """Where a file may be, first choice first.

    As it is; under the working folder; beside its folder (the same name in
    the folder above); under each of its ``parents`` nearest parent folders;
    under each root; with a registered prefix replaced.
    """
    slashed = F.replace(path, F.lit("\\"), F.lit("/"))
    parts, tail = F.split(slashed, "/"), T.relative_path(path)
    name = F.element_at(parts, -1)
    under = lambda up: F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - up, F.lit(0))), "/")
    found = [path]
    if cwd:
        found += [F.concat(F.lit(cwd.rstrip("/") + "/"), x) for x in (tail, name)]
    found.append(F.concat(under(2), F.lit("/"), name))
    found += [F.concat(under(k), F.lit("/"), tail) for k in range(2, 2 + parents)]
    found += [F.concat(F.lit(r.rstrip("/") + "/"), tail) for r in roots]
    found += [F.when(F.startswith(slashed, F.lit(a)), F.concat(F.lit(b), F.substring(slashed, len(a) + 1, F.length(slashed)))) for a, b in (registered or {}).items()]
    return F.array_distinct(F.array_compact(F.array(*found)))


def resolve_paths(wanted: DataFrame, inventory: DataFrame, roots: list[str], **where) -> DataFrame:
    """``wanted`` with ``resolved``: the first of the ``candidates`` that the inventory has; null if none."""
    paths = wanted.select("path").distinct()
    listed = paths.select("path", F.posexplode(candidates(F.col("path"), roots, **where)).alias("priority", "candidate"))
    found = listed.join(inventory.select(F.col("path").alias("candidate")).distinct(), "candidate", "left_semi")
    best = found.groupBy("path").agg(F.min_by("candidate", "priority").alias("resolved"))
    return wanted.join(best, "path", "left")


def resolution_report(resolved: DataFrame) -> DataFrame:
    """Total, found, rate; one row.  ``failures`` lists the others."""
    ok = F.col("resolved").isNotNull()
    return resolved.agg(F.count("*").alias("total"), F.count_if(ok).alias("found"), F.round(F.avg(ok.cast("double")), 6).alias("rate"))


def failures(resolved: DataFrame) -> DataFrame:
    """Paths that were not found, each once."""
    return resolved.where("resolved is null").select("path").distinct()


def with_image(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Rows of a frame map whose image ``(folder, stem)`` exists."""
    return rows.join(files.select("folder", "stem"), ["folder", "stem"], "left_semi")


def batches(rows: DataFrame, size: int = 32, key: str = "folder", order: str = "frame_id") -> DataFrame:
    """Numbered batches of at most ``size`` rows within each key, by order."""
    w = Window.partitionBy(key).orderBy(order)
    return rows.withColumn("batch", F.floor((F.row_number().over(w) - 1) / size).cast("long"))


def lookup(frames: DataFrame, folder, frame_id) -> DataFrame:
    """Point lookup; both equalities reach the scan."""
    return frames.where((F.col("folder") == folder) & (F.col("frame_id") == frame_id))
