"""Windows over blocks of a folder are those over the whole folder, in many tasks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.operators import split, temporal


def _frames(spark, seed=0, n=400):
    rng = np.random.default_rng(seed)
    ids = np.cumsum(rng.choice([1, 1, 2, 9], size=n))
    rows = [(None if i % 9 == 0 else 1 if i < 300 else int(rng.integers(2, 5)), int(ids[i]), None if rng.random() < 0.05 else rng.standard_normal(3).tolist()) for i in range(n)]
    rows += [(1, -5, [1.0, 0.0, 0.0]), (9, 7, [1.0, 0.0, 0.0])]
    return spark.createDataFrame(rows, "folder int, frame_id long, v array<double>").repartition(4)


CASES = {
    "ordered": temporal.ordered,
    "neighbours": lambda f, **k: temporal.neighbours(f, 3, **k),
    "prev_next": temporal.prev_next,
    "centred": lambda f, **k: temporal.centred_context(f, 5, 3, **k),
    "gap_scenes": lambda f, **k: temporal.gap_scenes(f, 3, **k),
    "similarity": temporal.sequential_similarity,
    "transitions": lambda f, **k: temporal.transition_points(f, 0.2, **k),
    "scenes": lambda f, **k: temporal.scene_groups(f, 0.1, 2, **k),
    "patterns": temporal.interval_patterns,
    "starts": lambda f, **k: temporal.scene_starts(f, 0.2, **k),
}


@pytest.mark.parametrize("name", CASES)
@pytest.mark.parametrize("block", [7, 64])
def test_blocks_change_nothing(spark, name, block):
    f = _frames(spark)
    whole, blocks = CASES[name](f), CASES[name](f, block=block)
    assert whole.columns == blocks.columns and whole.dtypes == blocks.dtypes
    assert sorted(map(str, blocks.collect())) == sorted(map(str, whole.collect()))
    assert CASES[name](f.limit(0), block=block).count() == 0


def test_one_long_folder_runs_in_many_tasks(spark):
    """Two million frames of one folder: no group of a window holds more than a block and its halo, and eight tasks or more have rows."""
    n = 2_000_000
    f = spark.range(n).select(F.lit(1).alias("folder"), (F.col("id") * 2).alias("frame_id"))
    keep = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        seen = split.over(f, True, 3, 3, lambda w: {"near": F.count("*").over(w.rowsBetween(-3, 3)), "last": F.lag("frame_id").over(w)}).withColumn("task", F.spark_partition_id())
        by = seen.groupBy("task").agg(F.count("*").alias("rows"), F.sum("near").alias("near"), F.sum((F.col("frame_id") == 2 * F.col("pos")).cast("int")).alias("right"), F.count_if(F.col("last") == F.col("frame_id") - 2).alias("follow")).collect()
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)
    assert len(by) >= 8 and sum(r.rows for r in by) == sum(r.right for r in by) == n
    assert sum(r.near for r in by) == 7 * n - 2 * (3 + 2 + 1) and sum(r.follow for r in by) == n - 1
    assert max(r.rows for r in by) <= 6 * split.BLOCK


def test_a_window_beyond_a_block_is_an_error(spark):
    with pytest.raises(ValueError):
        temporal.neighbours(_frames(spark), 9, block=8)
