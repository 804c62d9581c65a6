"""Ranking and fusion of result lists ``folder, frame_id, score[, rank]``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.operators import search
from lumenframe.storage import stored


def rank_results(results: DataFrame, limit: int | None = None) -> DataFrame:
    """Ranks 1..n by score, then id; at most ``limit`` rows.

    Without a limit the rows are sorted in ranges, and a rank is the place in
    its range after the rows of the ranges before: no task sees all rows.
    """
    order = (F.desc("score"), F.asc("frame_id"))
    if limit is not None:
        return results.orderBy(*order).limit(limit).withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    placed = stored(results.orderBy(*order).withColumn("__place", F.monotonically_increasing_id()))
    part, at = F.shiftright("__place", 33), F.col("__place").bitwiseAND(F.lit((1 << 33) - 1))
    before, starts = 0, []
    for r in placed.groupBy(part.alias("part")).count().orderBy("part").collect():  # one row for each range
        starts.append((r["part"], before))
        before += r["count"]
    ranges = results.sparkSession.createDataFrame(starts, "__part long, __before long")
    ranked = placed.join(F.broadcast(ranges), part == F.col("__part"))
    return ranked.select(*results.columns, (F.col("__before") + at + 1).cast("int").alias("rank"))


def weighted_fusion(first: DataFrame, second: DataFrame, w1: float = 0.7, w2: float = 0.3) -> DataFrame:
    """Full outer join of two lists on the frame; a missing score counts 0."""
    a = first.select("folder", "frame_id", F.col("score").alias("s1"))
    b = second.select("folder", "frame_id", F.col("score").alias("s2"))
    both = a.join(b, ["folder", "frame_id"], "full_outer")
    return both.select("folder", "frame_id", (F.coalesce("s1", F.lit(0.0)) * w1 + F.coalesce("s2", F.lit(0.0)) * w2).alias("score"))


def merge_dedup(lists: list[DataFrame], key: list[str] | None = None, order: Column | None = None) -> DataFrame:
    """Union of lists in which the first occurrence of a key wins (list number, then rank)."""
    tagged = [d.withColumn("list_no", F.lit(i)) for i, d in enumerate(lists)]
    every = reduce(DataFrame.unionByName, tagged)
    first = Window.partitionBy(*(key or ["folder", "frame_id"])).orderBy("list_no", *([] if order is None else [order]), "rank")
    return every.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")


def expanded_search(frames: DataFrame, vectors: list[list[float]], limit: int) -> DataFrame:
    """Every expansion gets ``max(1, limit // n)`` results; concatenated, first wins, then the limit."""
    each = max(1, limit // max(1, len(vectors)))
    merged = merge_dedup([search.topk(frames, v, each) for v in vectors])
    return merged.orderBy("list_no", "rank").limit(limit).drop("list_no")


def hybrid(frames: DataFrame, vector: list[float], expansions: list[list[float]] | None = None, *, limit: int = 50, threshold: float = 0.0, w1: float = 0.7, w2: float = 0.3, early_out: int = 5, strict: bool = False) -> DataFrame:
    """Vector results, fused with the expanded search once there are at least ``early_out`` of them.

    The expanded search has no threshold, so frames below it return with the
    second weight alone; ``strict`` applies it to both.  Either list is planned
    once: the first one's count is carried along as a window over at most
    ``2 * limit`` rows, and nothing runs until the action.
    """
    first = search.above(search.topk(frames, vector, limit), threshold)
    second = expanded_search(frames, expansions or [vector], limit)
    if strict:
        second = search.above(second, threshold)
    a, b = first.select("folder", "frame_id", F.col("score").alias("s1")), second.select("folder", "frame_id", F.col("score").alias("s2"))
    both = a.join(b, ["folder", "frame_id"], "full_outer").withColumn("__n", F.count("s1").over(Window.partitionBy(F.lit(1))))
    fused = F.coalesce("s1", F.lit(0.0)) * w1 + F.coalesce("s2", F.lit(0.0)) * w2
    kept = both.where((F.col("__n") >= early_out) | F.col("s1").isNotNull())
    return rank_results(kept.select("folder", "frame_id", F.when(F.col("__n") >= early_out, fused).otherwise(F.col("s1")).alias("score")), limit)


def federated_topk(indexes: list[DataFrame], vector: list[float], k: int, threshold: float = 0.0) -> DataFrame:
    """Top-k of each index, then of all; the threshold comes last."""
    every = reduce(DataFrame.unionByName, [search.topk(f, vector, k) for f in indexes])
    return search.above(rank_results(every.drop("rank"), k), threshold)


def multi_server(results: dict[str, DataFrame]) -> DataFrame:
    """Union of the servers' results with their source, best first; nothing is dropped."""
    tagged = [d.withColumn("source_server", F.lit(name)) for name, d in results.items()]
    return reduce(DataFrame.unionByName, tagged).orderBy(F.desc("score"), "source_server", "frame_id")


def explain(results: DataFrame, query: str, top: int = 10) -> DataFrame:
    """Adds an explanation to the first ``top`` results that have none."""
    # fixed value: the sentence
    text = F.format_string(f"This frame matches your query '{query.replace('%', '%%')}' based on visual similarity (score: %.3f).", "score")
    known = F.col("explanation") if "explanation" in results.columns else F.lit(None).cast("string")
    return results.withColumn("explanation", F.when((F.col("rank") <= top) & known.isNull(), text).otherwise(known))


def validate(results: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Drops rows without identity and clamps scores into [0, 1]; with an inventory (``path``), rows whose file is gone as well."""
    ok = F.col("folder").isNotNull() & F.col("frame_id").isNotNull()
    if files is not None:
        results = results.join(files.select(F.col("path").alias("__file")).distinct(), F.col("file_path") == F.col("__file"), "left_semi")
    return results.where(ok).withColumn("score", F.least(F.greatest("score", F.lit(0.0)), F.lit(1.0)))


def hide_displayed(results: DataFrame, seen: DataFrame, key: str = "frame_id") -> tuple[DataFrame, DataFrame]:
    """Results that were not displayed, and the keys displayed from now on."""
    fresh = results.join(seen.select(key), key, "left_anti")
    return fresh, seen.select(key).unionByName(fresh.select(key)).distinct()


def selection_list(current: DataFrame, added: DataFrame, cap: int = 100) -> DataFrame:
    """Appends what is not yet selected, in rank order, up to ``cap`` rows in all."""
    new = added.join(current.select("frame_id"), "frame_id", "left_anti")
    tagged = current.select("folder", "frame_id", "rank", F.lit(0).alias("o")).unionByName(new.select("folder", "frame_id", "rank", F.lit(1).alias("o")))
    return tagged.orderBy("o", "rank").limit(cap).drop("o")
