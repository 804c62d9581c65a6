"""Clusters as connected components, and their representatives."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.functions import vectors as V
from lumenframe.operators import tiles
from lumenframe.storage import stored


def components(nodes: DataFrame, edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """``id, root`` with the least id reachable: minimum of the neighbours' labels, then pointer jumping."""
    both = stored(edges.select("src", "dst").union(edges.select("dst", "src")).distinct())
    labels = stored(nodes.select(F.col("id"), F.col("id").alias("root")))
    for _ in range(max_rounds):
        told = both.join(labels, both.dst == labels.id).groupBy("src").agg(F.min("root").alias("low"))
        near = labels.join(told, labels.id == told.src, "left").select("id", F.least("root", F.coalesce("low", "root")).alias("mid"), F.col("root").alias("old"))
        jump = near.select(F.col("id").alias("jid"), F.col("mid").alias("jroot"))
        new = stored(near.join(jump, near.mid == jump.jid).select("id", F.least("mid", "jroot").alias("root"), "old"))
        if new.where("root <> old").isEmpty():
            return new.select("id", "root")
        labels = new.select("id", "root")
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def cosine_clusters(frames: DataFrame, eps: float = 0.05, noise: str = "one", *, tile: int = tiles.TILE, cell: int = tiles.CELL) -> DataFrame:
    """``folder, frame_id, cluster``: density clusters of at least two within cosine distance ``eps``.

    With two as the least size every clustered point is a core point, so the
    clusters are components.  Frames meet those that the triangle inequality
    leaves room for, tile by tile; a tile sends on a spanning forest of its links, never its
    pairs.  ``noise``: points without a neighbour form
    ``one`` cluster (-1) per folder, ``each`` its own, or are dropped.
    """
    kind = dict(frames.dtypes)["frame_id"]

    def compare(a, x, b, y, same):
        linked = 1 - x @ y.T <= eps if len(a) and len(b) else np.zeros((len(a), len(b)), bool)
        return tiles.forest(a, b, np.triu(linked, 1) if same else linked)

    edges = tiles.near_pairs(frames, compare, f"src {kind}, dst {kind}", 1 - eps, tile, cell).select("src", "dst")
    found = components(frames.select(F.col("frame_id").alias("id")), edges)
    size = found.groupBy(F.col("root").alias("of")).agg(F.count("*").alias("n"))  # counted before it is joined: a component may hold most rows
    sized = found.join(size, F.col("root") == F.col("of")).drop("of")
    named = frames.select("folder", "frame_id").join(sized, F.col("frame_id") == F.col("id"))
    lone = F.col("n") == 1
    if noise == "drop":
        named = named.where(~lone)
    cluster = F.when(lone, F.lit(-1).cast("long")).otherwise(F.col("root")) if noise == "one" else F.col("root")
    return named.select("folder", "frame_id", cluster.alias("cluster"))


def representatives(members: DataFrame) -> DataFrame:
    """``folder, cluster, frame_id``: the member nearest to its cluster's mean vector, the first on ties."""
    dims = members.select("folder", "cluster", F.posexplode("v").alias("dim", "x")).groupBy("folder", "cluster", "dim").agg(F.avg("x").alias("m"))
    means = dims.groupBy("folder", "cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "m"))), lambda s: s["m"]).alias("mean"))
    scored = members.join(means, ["folder", "cluster"]).withColumn("sim", F.round(V.cosine("v", "mean"), 9))
    return scored.groupBy("folder", "cluster").agg(F.max_by("frame_id", F.struct("sim", -F.col("frame_id"))).alias("frame_id"), F.count("*").alias("members"))
