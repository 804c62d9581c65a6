import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.operators import graph, reduce, temporal


def _frames(spark, rows):
    return spark.createDataFrame([(f, i, v) for f, i, v in rows], "folder int, frame_id long, v array<double>")


def _line(spark, angles, folder=0):
    return _frames(spark, [(folder, i, [float(np.cos(a)), float(np.sin(a))]) for i, a in enumerate(angles)])


def test_gap_is_strict_and_negative_ids_drop(spark):
    f = _frames(spark, [(0, i, [1.0]) for i in (0, 5, 10, 16, -1)])
    assert sorted((r.start_id, r.end_id) for r in temporal.gap_scenes(f).collect()) == [(0, 10), (16, 16)]
    assert temporal.ordered(f).count() == 4


def test_neighbours_clip_at_ends(spark):
    f = _frames(spark, [(0, i, [1.0]) for i in range(5)])
    r = {x.frame_id: x.context for x in temporal.neighbours(f, 2).collect()}
    assert r[0] == [1, 2] and r[2] == [0, 1, 3, 4]


def test_missing_vector_counts_as_similar(spark):
    f = _frames(spark, [(0, 0, [1.0, 0.0]), (0, 1, None), (0, 2, [0.0, 1.0])])
    assert [r.sim for r in temporal.sequential_similarity(f).orderBy("pos").collect()] == [None, 1.0, 1.0]


def _scenes_model(sims, n, threshold, least):
    start, out = 0, []
    if n >= 2 * least:
        for i in range(n - 1):
            if sims[i] < threshold and i - start >= least:
                out.append((start, i))
                start = i + 1
    return [*out, (start, n - 1)] if n else []


def test_merging_scenes_equal_the_sequential_model(spark):
    rng = np.random.default_rng(3)
    for n in (1, 9, 10, 40):
        angles = np.cumsum(rng.choice([0.1, 2.0], n, p=[0.7, 0.3]))
        sims = np.cos(np.diff(angles))
        got = sorted((r.start_pos, r.end_pos) for r in temporal.similarity_scenes(_line(spark, angles), 0.3, 5).collect())
        assert got == _scenes_model(sims, n, 0.3, 5)


def test_pattern_precedence(spark):
    rows = [(0, 5)] + [(1, i) for i in range(6)] + [(2, 20 * i) for i in range(6)] + [(3, 5 * i) for i in range(6)] + [(4, i * i * i) for i in range(6)] + [(5, -1), (5, -1)]
    f = spark.createDataFrame(rows, "folder int, frame_id long")
    got = {r.folder: r.pattern for r in temporal.interval_patterns(f).collect()}
    assert got == {0: "insufficient_data", 1: "dense", 2: "sparse", 3: "regular", 4: "irregular", 5: "insufficient_data"}


def test_sequence_match_needs_whole_windows(spark):
    a = temporal.ordered(_line(spark, [0.0, 0.5, 1.0]))
    b = temporal.ordered(_line(spark, [9.0, 0.0, 0.5, 1.0]))
    r = temporal.sequence_match(a, b, 3, 0.99).collect()
    assert [(x.target_start, x.start) for x in r] == [(0, 1)]


def _cos(a, b):
    return float(a @ b / (np.linalg.norm(a) * np.linalg.norm(b)))


@pytest.mark.parametrize("seed", [0, 1])
def test_folds_equal_sequential_models(spark, seed):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((60, 3))
    f = temporal.ordered(_frames(spark, [(i % 2, i, x[i].tolist()) for i in range(60)])).withColumn("last_pos", F.max("pos").over(temporal.Window.partitionBy("folder")))

    def model(rule):
        out = set()
        for folder in (0, 1):
            ids, kept = [i for i in range(60) if i % 2 == folder], []
            for p, i in enumerate(ids):
                if rule(kept, p, x[i], len(ids)):
                    kept.append((p, x[i]))
                    out.add(i)
        return out

    ids = lambda d: {r.frame_id for r in d.collect()}
    assert ids(reduce.last_kept_dedup(f, 0.5)) == model(lambda k, p, v, n: not k or _cos(v, k[-1][1]) < 0.5)
    assert ids(reduce.greedy_dedup(f, 0.5, 2)) == model(lambda k, p, v, n: not k or (p - k[-1][0] >= 2 and _cos(v, k[-1][1]) < 0.5) or p == n - 1)
    assert ids(reduce.windowed_dedup(f, 0.5, 4)) == model(lambda k, p, v, n: all(_cos(v, w) < 0.5 for q, w in k if q >= p - 4))
    assert ids(reduce.recent_dedup(f, 0.5, 3)) == model(lambda k, p, v, n: all(_cos(v, w) < 0.5 for _, w in k[-3:]))


def test_hash_distance_is_inclusive_and_looks_at_ten_kept(spark):
    codes = [0, 0b11111, 0b111111] + [(0xFF << (4 * i)) + (1 << 62) for i in range(1, 13)]
    f = spark.createDataFrame([(0, i, i, c) for i, c in enumerate(codes)], "folder int, frame_id long, pos long, code long")
    got = {r.frame_id for r in reduce.hash_dedup(f, 5, 10).collect()}
    assert 0 in got and 1 not in got and 2 in got


def test_clusters_are_transitive_and_noise_is_a_choice(spark):
    f = _line(spark, [0.0, 0.3, 0.6, 2.0, 4.0])
    got = {r.frame_id: r.cluster for r in graph.cosine_clusters(f, 0.05, "each").collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4}
    assert {r.frame_id: r.cluster for r in graph.cosine_clusters(f, 0.05, "one").collect()}[4] == -1
    assert graph.cosine_clusters(f, 0.05, "drop").count() == 3
    members = f.join(graph.cosine_clusters(f, 0.05, "each"), ["folder", "frame_id"])
    assert {r.frame_id for r in graph.representatives(members).collect()} == {1, 3, 4}


def test_quality_thresholds_are_strict(spark):
    q = spark.createDataFrame([(0, i, float(i), 5.0) for i in range(11)], "folder int, frame_id long, blur_score double, edge_density double")
    got = {r.frame_id: r.reason for r in reduce.quality_adaptive(q).collect()}
    assert got[0] == "blur" and got[1] == "acceptable"
    assert {r.reason for r in reduce.quality_fixed(q, 0.0, 5.0).collect()} == {"acceptable"}


def test_presets():
    c = reduce.ReductionConfig()
    assert c.gentle().percentile == 5.0 and not c.ultra_gentle().quality and c.similarity_only().transition == 0.0


def test_bounded_percentiles_are_near_the_exact_ones(spark):
    rows = spark.createDataFrame([("v", i, float(i), float(1000 - i)) for i in range(1000)], "folder string, frame_id long, blur_score double, edge_density double")
    exact, near = (set(map(tuple, reduce.quality_adaptive(rows, 10.0, accuracy=a).select("frame_id", "reason").collect())) for a in (None, 1000))
    assert len(exact ^ near) <= 2 * 3


def test_presets():
    c = reduce.ReductionConfig()
    assert c.gentle().percentile == 5.0 and not c.ultra_gentle().quality and c.similarity_only().transition == 0.0 and not c.similarity_only().quality
