"""Keyframe reduction: quality gates, greedy removal of near-duplicates, pipelines and reports."""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.functions import vectors as V
from lumenframe.operators import graph, temporal
from lumenframe.operators.fold import fold_sorted


def _reason(blur: Column, edge: Column, p_blur: Column, p_edge: Column) -> Column:
    return F.when(blur < p_blur, "blur").when(edge < p_edge, "low_edge").otherwise("acceptable")


def quality_adaptive(rows: DataFrame, percentile: float = 10.0, group: str = "folder", accuracy: int | None = None) -> DataFrame:
    """Adds ``reason``: under the group's percentile of blur, then of edge density (strictly).

    The exact percentile holds a group's distinct scores in one task.  With
    ``accuracy`` it comes from a sketch of bounded size instead, whose rank
    error is at most ``1 / accuracy`` of the group.
    """
    p = F.lit(percentile / 100)
    limit = (lambda c: F.percentile(c, p)) if accuracy is None else (lambda c: F.percentile_approx(c, p, accuracy))
    limits = rows.groupBy(group).agg(limit("blur_score").alias("p_blur"), limit("edge_density").alias("p_edge"))
    return rows.join(limits, group).withColumn("reason", _reason(F.col("blur_score"), F.col("edge_density"), F.col("p_blur"), F.col("p_edge")))


def quality_fixed(rows: DataFrame, blur: float = 10.0, edge: float = 5.0) -> DataFrame:
    return rows.withColumn("reason", _reason(F.col("blur_score"), F.col("edge_density"), F.lit(blur), F.lit(edge)))


def quality_report(judged: DataFrame, group: str = "folder") -> DataFrame:
    """Counts by reason, spread of the scores, and a warning where under 30 % stay."""
    kept = F.count_if(F.col("reason") == "acceptable")
    return judged.groupBy(group).agg(
        F.count("*").alias("total"), F.count_if(F.col("reason") == "blur").alias("rejected_blur"), F.count_if(F.col("reason") == "low_edge").alias("rejected_edge"),
        kept.alias("kept"), F.min("blur_score").alias("min_blur"), F.max("blur_score").alias("max_blur"), F.percentile("blur_score", F.lit(0.5)).alias("median_blur"),
        (kept / F.count("*") < 0.3).alias("low_keep_rate"),
    )


def _cos(a, b) -> float:
    if a is None or b is None:
        return 0.0
    scale = float(np.sqrt(a @ a) * np.sqrt(b @ b))
    return float(a @ b) / scale if scale else 0.0


def last_kept_dedup(frames: DataFrame, similarity: float = 0.98, keys: list[str] | None = None, order: str = "pos") -> DataFrame:
    """Keeps a frame if its cosine to the last kept one is under ``similarity``; state: one vector."""
    keys = keys or ["folder"]

    class Last:
        def __init__(self, key):
            self.kept = None

        def row(self, r):
            v = None if r["v"] is None else np.asarray(r["v"])
            if self.kept is None or _cos(v, self.kept) < similarity:
                self.kept = v
                return [(r["frame_id"],)]
            return []

    return _folded(frames, keys, order, Last)


def greedy_dedup(frames: DataFrame, similarity: float = 0.95, min_distance: int = 1, keys: list[str] | None = None) -> DataFrame:
    """Within a scene: first frame, then those far enough from the last kept and unlike it, and always the final frame.

    Needs ``pos`` and ``last_pos`` (the scene's final position).
    """
    keys = keys or ["folder"]

    class Greedy:
        def __init__(self, key):
            self.kept = self.pos = None

        def row(self, r):
            v = np.asarray(r["v"])
            first = self.kept is None
            far = first or r["pos"] - self.pos >= min_distance
            if first or (far and _cos(v, self.kept) < similarity) or r["pos"] == r["last_pos"]:
                self.kept, self.pos = v, r["pos"]
                return [(r["frame_id"],)]
            return []

    return _folded(frames, keys, "pos", Greedy)


def windowed_dedup(frames: DataFrame, similarity: float = 0.95, window: int = 5, keys: list[str] | None = None) -> DataFrame:
    """Drops a frame like any frame kept among the previous ``window`` positions."""
    keys = keys or ["folder"]

    class Window:
        def __init__(self, key):
            self.kept = deque()

        def row(self, r):
            v = np.asarray(r["v"])
            while self.kept and self.kept[0][0] < r["pos"] - window:
                self.kept.popleft()
            if any(_cos(v, k) >= similarity for _, k in self.kept):
                return []
            self.kept.append((r["pos"], v))
            return [(r["frame_id"],)]

    return _folded(frames, keys, "pos", Window)


def recent_dedup(frames: DataFrame, similarity: float = 0.95, last: int = 10, keys: list[str] | None = None) -> DataFrame:
    """Drops a frame like any of the last ``last`` kept."""
    keys = keys or ["folder"]

    class Recent:
        def __init__(self, key):
            self.kept = deque(maxlen=last)

        def row(self, r):
            v = np.asarray(r["v"])
            if any(_cos(v, k) >= similarity for k in self.kept):
                return []
            self.kept.append(v)
            return [(r["frame_id"],)]

    return _folded(frames, keys, "pos", Recent)


def hash_dedup(frames: DataFrame, distance: int = 5, last: int = 10, keys: list[str] | None = None, code: str = "code") -> DataFrame:
    """Drops a frame whose 64-bit code is within ``distance`` bits of any of the last ``last`` kept."""
    keys = keys or ["folder"]

    class Codes:
        def __init__(self, key):
            self.kept = deque(maxlen=last)

        def row(self, r):
            c = r[code] & (1 << 64) - 1
            if any((c ^ k).bit_count() <= distance for k in self.kept):
                return []
            self.kept.append(c)
            return [(r["frame_id"],)]

    return _folded(frames, keys, "pos", Codes)


def _folded(frames: DataFrame, keys: list[str], order: str, state) -> DataFrame:
    kinds = dict(frames.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + f", frame_id {kinds['frame_id']}"
    return fold_sorted(frames, keys, [order], state, schema)


@dataclass(frozen=True)
class ReductionConfig:
    """Settings of the quality pipeline."""

    adaptive: bool = True
    quality: bool = True
    percentile: float = 10.0
    fixed_blur: float = 10.0
    fixed_edge: float = 5.0
    transition: float = 0.75
    min_scene: int = 2
    dedup: bool = True
    windowed: bool = False
    similarity: float = 0.95
    min_distance: int = 1
    window: int = 5

    def gentle(self):
        return replace(self, percentile=5.0)

    def ultra_gentle(self):
        return replace(self, quality=False)

    def similarity_only(self):
        return replace(self, quality=False, transition=0.0)


def quality_pipeline(frames: DataFrame, config: ReductionConfig = ReductionConfig()) -> DataFrame:
    """Quality gate, similarity of the survivors, scenes, removal within scenes: ``folder, scene_id, frame_id, n``.

    One partitioning by folder serves the windows, and scenes are what the
    greedy step runs on in parallel; ``n`` renumbers the kept frames from 0.
    """
    if config.quality:
        judged = quality_adaptive(frames, config.percentile) if config.adaptive else quality_fixed(frames, config.fixed_blur, config.fixed_edge)
        frames = judged.where("reason = 'acceptable'")
    scenes = temporal.scene_labels(temporal.sequential_similarity(frames.select("folder", "frame_id", "v")), config.transition)
    w = temporal.Window.partitionBy("folder", "scene_id")
    scenes = scenes.withColumn("last_pos", F.max("pos").over(w)).withColumn("size", F.count("*").over(w)).where(F.col("size") >= config.min_scene)
    keys = ["folder", "scene_id"]
    if not config.dedup:
        kept = scenes.select(*keys, "frame_id")
    elif config.windowed:
        kept = windowed_dedup(scenes, config.similarity, config.window, keys)
    else:
        kept = greedy_dedup(scenes, config.similarity, config.min_distance, keys)
    order = temporal.Window.partitionBy("folder").orderBy("frame_id")
    return kept.withColumn("n", (F.row_number().over(order) - 1).cast("long"))


def multilevel_pipeline(frames: DataFrame, *, scene: float = 0.7, hash_distance: int = 5, last: int = 10, eps: float = 0.05, similarity: float = 0.95, noise: str = "one") -> DataFrame:
    """Scenes, removal by hash, clusters and their representatives per scene, then removal by vector across scenes."""
    labelled = temporal.scene_labels(temporal.sequential_similarity(frames), scene).withColumn("code", V.sign_code("v"))
    kept = hash_dedup(labelled, hash_distance, last, ["folder", "scene_id"])
    rows = labelled.join(kept, ["folder", "scene_id", "frame_id"], "left_semi")
    # clusters live within a scene: folder and scene are one key for the clustering
    keyed = rows.select(F.concat_ws(":", F.col("folder").cast("string"), "scene_id").alias("folder"), "frame_id", "v")
    clusters = graph.cosine_clusters(keyed, eps, noise)
    chosen = graph.representatives(keyed.join(clusters, ["folder", "frame_id"]))
    back = rows.join(chosen.select("frame_id"), "frame_id", "left_semi")
    return recent_dedup(back, similarity, last)


def tagged_pipeline(frames: DataFrame, config: ReductionConfig = ReductionConfig()) -> DataFrame:
    """Every frame with the stage that removed it: ``folder, frame_id, scene_id, sim, removed_by``.

    ``removed_by`` is ``quality``, ``scene`` (its scene is too short), ``dedup``
    or null for kept ones; ``scene_id`` and ``sim`` (to the frame before) are
    null for frames that the quality gate removed.
    """
    source = frames
    if config.quality:
        judged = quality_adaptive(frames, config.percentile) if config.adaptive else quality_fixed(frames, config.fixed_blur, config.fixed_edge)
        source = judged.where("reason = 'acceptable'")
    labelled = temporal.scene_labels(temporal.sequential_similarity(source.select("folder", "frame_id", "v")), config.transition)
    size = F.count("*").over(temporal.Window.partitionBy("folder", "scene_id"))
    labelled = labelled.select(F.col("frame_id").alias("__id"), "scene_id", "sim", (size < config.min_scene).alias("__short"))
    kept = quality_pipeline(frames, config).select(F.col("frame_id").alias("__kept"))
    every = frames.select("folder", "frame_id").join(labelled, F.col("frame_id") == F.col("__id"), "left").join(kept, F.col("frame_id") == F.col("__kept"), "left")
    removed = F.when(F.col("__id").isNull(), "quality").when(F.col("__short"), "scene").when(F.col("__kept").isNull(), "dedup")
    return every.select("folder", "frame_id", "scene_id", "sim", removed.alias("removed_by"))


def stage_report(tagged: DataFrame, transition: float) -> DataFrame:
    """Per folder: original, kept, removed by each stage, percent kept, scenes kept, transitions, mean similarity."""
    by = lambda stage: F.count_if(F.col("removed_by") == stage)
    kept = F.count_if(F.col("removed_by").isNull())
    return tagged.groupBy("folder").agg(
        F.count("*").alias("original"), kept.alias("kept"), by("quality").alias("removed_quality"), by("scene").alias("removed_scene"), by("dedup").alias("removed_dedup"),
        F.round(100 * kept / F.count("*"), 4).alias("kept_percent"),
        F.count_distinct(F.when(F.coalesce(F.col("removed_by"), F.lit("kept")).isin("kept", "dedup"), F.col("scene_id"))).alias("scenes"),
        F.count_if(F.col("sim") < transition).alias("transitions"), F.round(F.avg("sim"), 6).alias("average_similarity"),
    )


def stage_summary(report: DataFrame) -> DataFrame:
    """Over all folders, one row: sums, the mean of the folders' percentages, folders with a frame left."""
    return report.agg(
        F.count("*").alias("folders"), F.count_if(F.col("kept") > 0).alias("successful"), F.sum("original").alias("original"), F.sum("kept").alias("kept"),
        F.round(F.avg("kept_percent"), 4).alias("mean_kept_percent"),
    )


def batch_summary(report: DataFrame) -> DataFrame:
    """Totals, share removed, and whole frames kept per folder on average; one row."""
    t = report.agg(F.count("*").alias("videos"), F.sum("original").alias("frames"), F.sum("kept").alias("keyframes"))
    ratio = F.when(F.col("frames") > 0, F.round(1 - F.col("keyframes") / F.col("frames"), 6)).otherwise(F.lit(0.0))
    return t.withColumn("reduction", ratio).withColumn("per_video", F.when(F.col("videos") > 0, F.floor(F.col("keyframes") / F.col("videos"))).otherwise(F.lit(0)).cast("long"))


def dedup_report(scenes: DataFrame, kept: DataFrame) -> DataFrame:
    """Per folder and scene: frames before and after the removal, and how many went."""
    tagged = scenes.join(kept.select(F.col("frame_id").alias("__kept")), F.col("frame_id") == F.col("__kept"), "left")
    r = tagged.groupBy("folder", "scene_id").agg(F.count("*").alias("original"), F.count("__kept").alias("filtered"))
    return r.withColumn("removed", F.col("original") - F.col("filtered"))


def reduction_report(frames: DataFrame, kept: DataFrame) -> DataFrame:
    """Per folder and in total (``folder`` null): original, kept, removed, percent."""
    tagged = frames.join(kept.select("frame_id", F.lit(1).alias("__kept")), "frame_id", "left")
    r = tagged.rollup("folder").agg(F.count("*").alias("original"), F.count("__kept").alias("kept"))
    return r.withColumn("removed", F.col("original") - F.col("kept")).withColumn("kept_percent", F.round(100 * F.col("kept") / F.col("original"), 4))
