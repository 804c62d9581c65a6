"""Temporal operators over ``folder, frame_id, v``: order, neighbours, scenes, transitions, sequences, patterns."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.functions import vectors as V
from lumenframe.operators import split
from lumenframe.operators.fold import fold_sorted
from lumenframe.operators.split import BLOCK
from lumenframe.operators.tiles import CELL, least_hashed, near_matches, unit_rows
from lumenframe.storage import stored


def ordered(frames: DataFrame, *, block: int = BLOCK) -> DataFrame:
    """0-based ``pos`` in the folder; unknown frames (negative ids) are dropped."""
    return split.numbered(frames, split.is_long(frames, block), block)


def neighbours(frames: DataFrame, window: int = 3, *, block: int = BLOCK) -> DataFrame:
    """``context``: ids of up to ``window`` frames on either side, in order, without the frame itself."""

    def near(w):
        return {"context": F.filter(F.collect_list("frame_id").over(w.rowsBetween(-window, window)), lambda x: x != F.col("frame_id"))}

    return split.over(frames, split.is_long(frames, block), window, window, near, block)


def with_context(results: DataFrame, frames: DataFrame, window: int = 3) -> DataFrame:
    """``results`` with ``context``, the neighbours of each; only the folders of the results are sorted.

    Results are a bounded list; they are written first, so that their search
    runs once and the planner knows their size.
    """
    results = stored(results)
    folders = results.select(F.col("folder").alias("__in")).distinct()
    some = frames.select("folder", "frame_id").join(folders, F.col("folder").eqNullSafe(F.col("__in")), "left_semi")
    return results.join(neighbours(some, window).select("frame_id", "context"), "frame_id", "left")


def prev_next(frames: DataFrame, *, block: int = BLOCK) -> DataFrame:
    beside = lambda w: {"prev_id": F.lag("frame_id").over(w), "next_id": F.lead("frame_id").over(w)}
    return split.over(frames, split.is_long(frames, block), 1, 1, beside, block).select("folder", "frame_id", "prev_id", "next_id")


def centred_context(frames: DataFrame, reach: int = 5, window: int = 3, *, block: int = BLOCK) -> DataFrame:
    """``around``: frames within ``reach`` including the frame; ``centred``: a slice around its middle (off-centre at ends)."""
    near = lambda w: {"around": F.collect_list("frame_id").over(w.rowsBetween(-reach, reach))}
    f = split.over(frames, split.is_long(frames, block), reach, reach, near, block)
    start = F.greatest(F.lit(0), F.floor(F.size("around") / 2).cast("int") - window)
    return f.withColumn("centred", F.slice("around", start + 1, F.lit(2 * window + 1)))


def gap_scenes(frames: DataFrame, gap: int = 5, *, block: int = BLOCK) -> DataFrame:
    """``folder, scene_id, start_id, end_id``: a new scene where the step to the next frame exceeds ``gap``."""
    long = split.is_long(frames, block)
    cut = lambda w: {"cut": F.coalesce(F.col("frame_id") - F.lag("frame_id").over(w) > gap, F.lit(False)).cast("int")}
    f = split.running(split.over(frames, long, 1, 0, cut, block), long, F.col("cut"), "scene_id", block)
    return f.groupBy("folder", "scene_id").agg(F.min("frame_id").alias("start_id"), F.max("frame_id").alias("end_id"))


def sequential_similarity(frames: DataFrame, *, block: int = BLOCK, long: bool | None = None) -> DataFrame:
    """``sim``: cosine with the predecessor; null for the first, 1 where a vector is missing."""
    long = split.is_long(frames, block) if long is None else long
    f = split.over(frames, long, 1, 0, lambda w: {"__before": F.lag("v").over(w)}, block)
    sim = F.when(F.col("v").isNull() | F.col("__before").isNull(), F.lit(1.0)).otherwise(V.cosine("v", "__before"))
    return f.withColumn("sim", F.when(F.col("pos") > 0, sim)).drop("__before")


def transition_points(frames: DataFrame, threshold: float = 0.75, *, block: int = BLOCK) -> DataFrame:
    """Positions whose similarity to the predecessor is under the threshold."""
    return sequential_similarity(frames, block=block).where(F.col("sim") < threshold).select("folder", "pos", "sim")


def scene_groups(frames: DataFrame, threshold: float = 0.75, min_length: int = 2, *, block: int = BLOCK) -> DataFrame:
    """Segments between transitions, short ones dropped: ``folder, scene_id, start_pos, end_pos`` (inclusive)."""
    long = split.is_long(frames, block)
    f = scene_labels(sequential_similarity(frames, block=block, long=long), threshold, block=block, long=long)
    g = f.groupBy("folder", "scene_id").agg(F.min("pos").alias("start_pos"), F.max("pos").alias("end_pos"))
    return g.where(F.col("end_pos") - F.col("start_pos") + 1 >= min_length)


def scene_labels(with_sim: DataFrame, threshold: float, *, block: int = BLOCK, long: bool | None = None) -> DataFrame:
    cut = F.coalesce(F.col("sim") < threshold, F.lit(False)).cast("int")
    return split.running(with_sim, split.is_long(with_sim, block) if long is None else long, cut, "scene_id", block)


def scene_starts(frames: DataFrame, threshold: float = 0.7, *, block: int = BLOCK) -> DataFrame:
    """Starts of scenes with both sentinels: 0, every cut, and the number of frames."""
    f = sequential_similarity(frames, block=block)
    starts = f.where((F.col("pos") == 0) | (F.col("sim") < threshold)).select("folder", F.col("pos").alias("start_pos"))
    ends = f.groupBy("folder").agg(F.count("*").cast("long").alias("start_pos"))
    return starts.unionByName(ends)


def similarity_scenes(frames: DataFrame, threshold: float = 0.3, min_length: int = 5) -> DataFrame:
    """Scenes by similarity in which early cuts are ignored, so short scenes merge.

    A cut after position i is taken if at least ``min_length`` positions lie
    between the scene's start and i; folders of fewer than twice that many
    frames are one scene.  Which cuts count depends on the last one taken:
    rows stream through a fold per folder that holds two numbers.
    """
    size = frames.where("frame_id >= 0").groupBy(F.col("folder").alias("of")).agg(F.count("*").alias("n"))
    f = sequential_similarity(frames).join(size, F.col("folder").eqNullSafe(F.col("of"))).select("folder", "pos", "sim", "n")

    class Scenes:
        def __init__(self, key):
            self.start = 0

        def row(self, r):
            out = []
            if r["n"] >= 2 * min_length and r["pos"] and r["sim"] < threshold and r["pos"] - 1 - self.start >= min_length:
                out.append((self.start, r["pos"] - 1))
                self.start = r["pos"]
            if r["pos"] == r["n"] - 1:
                out.append((self.start, r["pos"]))
            return out

    kind = dict(f.dtypes)["folder"]
    return fold_sorted(f, ["folder"], ["pos"], Scenes, f"folder {kind}, start_pos long, end_pos long")


def transition_frames(scenes: DataFrame, counts: DataFrame) -> DataFrame:
    """Positions around the border of consecutive scenes: two before its end up to two after the next start."""
    w = Window.partitionBy("folder").orderBy("start_pos")
    pairs = scenes.withColumn("next_start", F.lead("start_pos").over(w)).where("next_start is not null").join(counts, "folder")
    low, high = F.greatest(F.lit(0), F.col("end_pos") - 2), F.least("n", F.col("next_start") + 3) - 1
    return pairs.where(low <= high).select("folder", F.explode(F.sequence(low, high)).alias("pos")).distinct()


#: From this threshold on windows are sought from seeds: below it nearly every frame has some.
SEEDED = 0.5
#: Cells around seeds that are always scored one by one.
CELLS = 2_000_000


def sequence_match(target: DataFrame, database: DataFrame, length: int = 5, threshold: float = 0.8, *, tile: int = 1024, target_block: int = 32_768) -> DataFrame:
    """Aligned windows of ``length`` frames whose mean cosine reaches the threshold: ``folder, target_start, start, score``.

    ``target`` is one sequence ``(pos, v)``, the database holds sequences
    ``(folder, pos, v)``.  From a threshold of ``SEEDED`` on, windows grow from
    seeds (``seeded_match``), below it all windows are scored
    (``dense_match``); the rows are the same.
    """
    if threshold >= SEEDED:
        return seeded_match(target, database, length, threshold)
    return dense_match(target, database, length, threshold, tile=tile, target_block=target_block)


def seeded_match(target: DataFrame, database: DataFrame, length: int, threshold: float, *, tile: int = 1024, cell: int = CELL) -> DataFrame:
    """``sequence_match`` from seeds: a window of mean ``t`` holds a frame whose cosine is ``t`` or more.

    Such pairs of frames come from the pruned similarity join.  The cells of their
    diagonals that a window through a seed may cover are scored, each once,
    and windows are sums along diagonals.

    Seeds are rows of their own, so they must be few.  Where the cells around
    them are over ``CELLS`` and a tenth of all or more, by a bounded sample of
    both sides, all windows are scored instead (``dense_match``): its tasks are tiles, and only windows leave them.
    """
    share, pairs = seed_share(target, database, threshold)
    if share * (2 * length - 1) >= 0.1 and pairs * share * (2 * length - 1) > CELLS:
        return dense_match(target, database, length, threshold, tile=tile)
    there, stored_there = target.where("v is not null").select(F.col("pos").cast("long").alias("pos"), "v"), database.where("v is not null").select("folder", F.col("pos").cast("long").alias("pos"), "v")
    # the margin covers rounding; the sum decides
    seeds = near_matches(there.withColumnRenamed("pos", "frame_id"), stored_there.withColumnRenamed("pos", "frame_id"), threshold - 1e-9, tile, cell)
    around = F.explode(F.sequence(F.lit(1 - length), F.lit(length - 1))).alias("k")
    cells = seeds.select("left_id", "folder", "right_id", around).select((F.col("left_id") + F.col("k")).alias("i"), "folder", (F.col("right_id") + F.col("k")).alias("j")).where("i >= 0 and j >= 0").distinct()
    a, b = there.toDF("t_pos", "t_v"), stored_there.toDF("d_folder", "d_pos", "d_v")
    scored = cells.join(a, F.col("i") == F.col("t_pos")).join(b, F.col("folder").eqNullSafe(F.col("d_folder")) & (F.col("j") == F.col("d_pos")))
    scored = scored.select("folder", "i", "j", F.least(F.greatest(V.cosine("t_v", "d_v"), F.lit(-1.0)), F.lit(1.0)).alias("c"))
    along = Window.partitionBy("folder", F.col("i") - F.col("j")).orderBy("i").rangeBetween(0, length - 1)
    windows = scored.select("folder", F.col("i").alias("target_start"), F.col("j").alias("start"), (F.sum("c").over(along) / length).alias("score"), F.count("*").over(along).alias("n"))
    return windows.where((F.col("n") == length) & (F.col("score") >= threshold)).drop("n")


def seed_share(target: DataFrame, database: DataFrame, threshold: float, sample: int = 512) -> tuple[float, int]:
    """Share of the pairs of a target and a database frame that are seeds, from ``sample`` frames of each side at most, and the pairs."""
    sides, pairs = [], 1
    for side in (target, database):
        some = side.where("v is not null").withColumn("__key", F.xxhash64(*[c for c in ("folder", "pos") if c in side.columns]))
        n = some.count()
        sides.append(unit_rows([r["v"] for r in least_hashed(some, "__key", sample, n).select("v").collect()]))
        pairs *= n
    return (float((sides[0] @ sides[1].T >= threshold).mean()) if len(sides[0]) and len(sides[1]) else 0.0), pairs


def dense_match(target: DataFrame, database: DataFrame, length: int, threshold: float, *, tile: int = 1024, target_block: int = 32_768) -> DataFrame:
    """``sequence_match`` by scoring every window.

    The target is the stated query: it is counted and meets the database in blocks of at most ``target_block`` positions.
    Sequences of the database are dealt into tiles of
    ``tile`` positions that overlap by a window, so each window lies in one
    tile; cosines are matrix products and windows their diagonals.
    """
    n = target.where("v is not null").agg(F.max("pos")).first()[0]
    kind = dict(database.dtypes)["folder"]
    first, last = F.greatest(F.lit(0), F.floor((F.col("pos") - (length - 1)) / tile)), F.floor(F.col("pos") / tile)
    tiled = database.where("v is not null").select("folder", "pos", "v", F.explode(F.sequence(first, last)).alias("tile"))
    found = None
    for at in range(0, (n if n is not None else -1) + 1, target_block):
        rows = target.where(F.col("v").isNotNull() & F.col("pos").between(at, at + target_block + length - 2)).select("pos", "v").orderBy("pos").collect()
        if rows:
            one = _match_block(tiled, np.array([r["pos"] for r in rows]), unit_rows([r["v"] for r in rows]), at, target_block, length, threshold, tile, kind)
            found = one if found is None else found.unionByName(one)
    return database.sparkSession.createDataFrame([], f"folder {kind}, target_start long, start long, score double") if found is None else found


def _match_block(tiled: DataFrame, places: np.ndarray, vectors: np.ndarray, at: int, block: int, length: int, threshold: float, tile: int, kind: str) -> DataFrame:
    shared = tiled.sparkSession.sparkContext.broadcast((places, vectors))

    def laid(pos: np.ndarray, m: np.ndarray, n: int):
        """Unit vectors by position, and which positions are there."""
        out, here = np.zeros((n, m.shape[1])), np.zeros(n, bool)
        out[pos], here[pos] = m, True
        return out, here

    def match(key, rows):
        import pandas as pd

        begin, out = int(key[1]) * tile, []
        pos, m = shared.value
        d, d_here = laid(rows["pos"].to_numpy() - begin, unit_rows(rows["v"]), tile + length - 1)
        for lo in range(at, at + block, 2048):
            n = min(2048, at + block - lo)
            a, b = np.searchsorted(pos, [lo, lo + n + length - 1])
            if a == b:
                continue
            t, t_here = laid(pos[a:b] - lo, m[a:b], n + length - 1)
            sims = np.clip(t @ d.T, -1.0, 1.0)
            whole = t_here[:, None] & d_here[None, :]
            score = sum(sims[k : k + n, k : k + tile] for k in range(length)) / length
            ok = np.logical_and.reduce([whole[k : k + n, k : k + tile] for k in range(length)])
            i, j = np.nonzero(ok & (score >= threshold))
            out.append(pd.DataFrame({"target_start": i + lo, "start": j + begin, "score": score[i, j]}))
        found = pd.concat(out) if out else pd.DataFrame({"target_start": [], "start": [], "score": []})
        found.insert(0, "folder", key[0])
        return found

    return tiled.groupBy("folder", "tile").applyInPandas(match, f"folder {kind}, target_start long, start long, score double")


def interval_patterns(frames: DataFrame, *, block: int = BLOCK) -> DataFrame:
    """Statistics of the steps between valid frames, and a label: irregular, dense, sparse or regular."""
    step = lambda w: {"step": (F.col("frame_id") - F.lag("frame_id").over(w)).cast("double")}
    steps = split.over(frames, split.is_long(frames, block), 1, 0, step, block)
    s = steps.groupBy("folder").agg(
        F.count("*").alias("valid"), F.avg("step").alias("mean"), F.stddev_pop("step").alias("std"), F.min("step").alias("least"), F.max("step").alias("most")
    )
    every = frames.groupBy("folder").agg(F.count("*").alias("total"))
    s = every.join(s, "folder", "left")
    valid = F.coalesce("valid", F.lit(0))
    label = (
        F.when(valid < 2, "insufficient_data").when(F.col("std") > 0.5 * F.col("mean"), "irregular").when(F.col("mean") < 2, "dense").when(F.col("mean") > 10, "sparse").otherwise("regular")
    )
    return s.select("folder", F.when(valid < 2, F.col("total")).otherwise(valid).cast("long").alias("total"), "mean", "std", "least", "most", label.alias("pattern"))


def as_of_scene(rows: DataFrame, boundaries: DataFrame) -> DataFrame:
    """Backward as-of: the last scene start at or before each position, by one sort of both sides."""
    both = rows.select("folder", "pos", F.lit(1).alias("o")).unionByName(boundaries.select("folder", F.col("start_pos").alias("pos"), F.lit(0).alias("o")))
    w = Window.partitionBy("folder").orderBy("pos", "o").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("scene_start", F.last(F.when(F.col("o") == 0, F.col("pos")), ignorenulls=True).over(w)).where("o = 1").drop("o")
