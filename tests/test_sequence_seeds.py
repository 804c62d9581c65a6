"""Windows from seeds are those of all windows."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lumenframe.operators import temporal, tiles


def _tables(spark, seed, n=60):
    """A target and three sequences that repeat parts of it, with noise, gaps and repeated frames."""
    rng = np.random.default_rng(seed)
    t = rng.standard_normal((n, 4))
    t[20:26] = t[20]
    rows = []
    for folder in range(3):
        x = rng.standard_normal((50, 4))
        a, b, k = int(rng.integers(40)), int(rng.integers(30)), int(rng.integers(3, 18))
        x[b : b + k] = t[a : a + k][: len(x[b : b + k])] if a + k <= n else x[b : b + k]
        x += rng.choice([0, 0.1, 0.4]) * rng.standard_normal(x.shape)
        rows += [(folder or None, i, None if rng.random() < 0.05 else x[i].tolist()) for i in range(50)]
    rows[3] = (None, 3, [0.0] * 4)
    target = spark.createDataFrame([(i, None if rng.random() < 0.05 else t[i].tolist()) for i in range(n)], "pos long, v array<double>")
    return target, spark.createDataFrame(rows, "folder long, pos long, v array<double>").repartition(3)


@settings(max_examples=4, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 5), st.sampled_from([0.5, 0.8, 0.97]), st.sampled_from([7, 1000]))
def test_seeds_find_all_windows(spark, seed, length, threshold, cell):
    target, database = _tables(spark, seed)
    key = lambda r: (r.folder, r.target_start, r.start)
    dense = {key(r): r.score for r in temporal.dense_match(target, database, length, threshold, tile=16, target_block=25).collect()}
    seeded = temporal.seeded_match(target, database, length, threshold, tile=16, cell=cell).collect()
    assert len(seeded) == len({key(r) for r in seeded})
    seeded = {key(r): r.score for r in seeded}
    # windows at the threshold itself may fall on either side by rounding
    sure = lambda found: {k for k, s in found.items() if s > threshold + 1e-9}
    assert sure(seeded) == sure(dense) and all(abs(seeded[k] - dense[k]) < 1e-9 for k in sure(dense))


def test_empty_sides(spark):
    target, database = _tables(spark, 1)
    assert temporal.sequence_match(target.limit(0), database, 3, 0.8).count() == 0
    assert temporal.sequence_match(target, database.limit(0), 3, 0.8).count() == 0
    assert temporal.sequence_match(target.limit(0), database, 3, 0.2).count() == 0


@pytest.mark.parametrize("cell", [5, 1000])
def test_matches_of_two_tables(spark, cell):
    rng = np.random.default_rng(8)
    x, y = rng.standard_normal((40, 3)), rng.standard_normal((90, 3))
    left = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "frame_id long, v array<double>")
    right = spark.createDataFrame([("f", i, v) for i, v in enumerate(y.tolist())], "folder string, frame_id long, v array<double>")
    got = [(r.left_id, r.right_id) for r in tiles.near_matches(left, right, 0.9, 16, cell).collect()]
    s = tiles.unit_rows(x) @ tiles.unit_rows(y).T
    assert len(got) == len(set(got)) and set(got) == {(int(i), int(j)) for i, j in zip(*np.nonzero(s >= 0.9), strict=True)}


def test_seeds_that_are_nearly_all_pairs_are_never_rows(spark, monkeypatch):
    """Many seeds: windows come from tiles. Few seeds, or few cells: they come from seeds."""
    target, database = _tables(spark, 2)
    key = lambda found: {(r.folder, r.target_start, r.start) for r in found.collect()}
    want = key(temporal.dense_match(target, database, 3, 0.1))
    assert key(temporal.seeded_match(target, database, 3, 0.1)) == want
    sought = []
    monkeypatch.setattr(temporal, "near_matches", lambda *a: sought.append(a[2]) or tiles.near_matches(*a))
    monkeypatch.setattr(temporal, "CELLS", 1_000)
    assert key(temporal.seeded_match(target, database, 3, 0.1)) == want and not sought
    temporal.seeded_match(target, database, 3, 0.999).collect()
    assert len(sought) == 1
