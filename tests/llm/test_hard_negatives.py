"""Hard negatives against the plain model, the brackets against true scores, and what they prune."""

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumenframe.llm import hard_negatives, queries

SMALL = {"anchor_block": 4, "row_block": 16, "sample": 40, "pivots": 5}


def mined(t, **options):
    got = hard_negatives.mine(t, F.col("vec_id") % 10 == 0, scale=1, **options)
    return sorted(tuple(r) for r in got.collect())


def table(spark, rows):
    return spark.createDataFrame([(i, [float(v) for v in x], lab) for i, x, lab in rows], "vec_id long, embedding array<double>, label int").repartition(4)


@pytest.mark.parametrize("options", [{}, SMALL, {"sample": 1, "row_block": 30, "anchor_block": 7}])
def test_equals_brute_force(spark, options):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 8)) * 200
    rows = [(i, np.round(centres[i % 6] + rng.normal(size=8) * 60).tolist(), int(rng.integers(4))) for i in range(400)]
    rows += [(400 + i, rows[7][1], i % 3) for i in range(80)] + [(500 + i, [3.0, i - 10.0], i % 2) for i in range(30)] + [(990, [1.0], 1)]
    rows += [(600 + i, np.round(rng.normal(size=8) * 2).tolist(), 9) for i in range(40)]  # small scores: ties, zeros and negative ones
    assert mined(table(spark, rows), **options) == hard_negatives.brute(rows, lambda i: i % 10 == 0)


def test_defined_cases(spark):
    bad = [(None, [1.0, 2.0], 1), (1, None, 1), (2, [], 1), (3, [1.0, None], 1), (4, [1.0, float("nan")], 1), (5, [float("inf"), 1.0], 1), (6, [1.0, 1.0], None)]
    good = [(10, [4.0, 0.0], 1), (11, [5.0, 0.0], 1), (12, [2.0, 1.0], 2), (13, [3.0, 3.0], 2), (14, [0.0, 1.0], 2), (20, [0.0, 4.0], 3), (30, [9.0], 1), (40, [0.0, 0.0], 4), (41, [0.0, 0.0], 4)]
    t = spark.createDataFrame(bad + good, "vec_id long, embedding array<double>, label int").withColumns({c: F.lit("x") for c in ("a", "id", "x", "d", "home", "to", "ask", "score", "rank", "slot", "anchor", "partner")})
    want = hard_negatives.brute(good, lambda i: i % 10 == 0)
    assert want and mined(t) == want
    assert (40, 41, 1, 10, 0, 0) in want  # of a positive of score 0, negatives of score 0
    assert mined(t.limit(0)) == [] and mined(t.where("vec_id is null")) == []


def test_repeated_rows(spark):
    rows = [(0, [4.0, 0.0], 1), (1, [5.0, 0.0], 1), (2, [2.0, 1.0], 2)]
    t = table(spark, rows + rows)
    # an anchor is answered once; its partners count as often as they are there
    assert mined(t) == [(0, 1, 1, 2, 20, 8)] * 2 + [(0, 1, 2, 2, 20, 8)] * 2


def test_scores_beyond_doubles_are_exact(spark):
    big = 2.0**31
    rows = [(0, [big, 1.0], 1), (1, [big, 3.0], 1), (2, [big, 5.0], 1), (3, [big / 2, 7.0], 2), (4, [big / 2, 6.0], 2), (5, [big, 9.0], 2)]
    assert mined(table(spark, rows)) == hard_negatives.brute(rows, lambda i: i % 10 == 0)


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 2**31), st.integers(1, 6), st.integers(1, 5), st.sampled_from([1, 30, 5000]))
def test_brackets_hold_the_score(seed, d, pivots, size):
    rng = np.random.default_rng(seed)
    x, q = np.round(rng.normal(size=(40, d)) * size), np.round(rng.normal(size=(7, d)) * size * 2)
    p = hard_negatives.Pivots(np.arange(40), np.zeros(40, object), x, float((x * x).sum(axis=1).max()), pivots)
    ask, to, square, s = p.of_anchors(q), p.of_rows(x), (q * q).sum(axis=1), q @ x.T
    low, high = hard_negatives.bracket(ask[:, None], ask[:, None], to[None], to[None], square[:, None], square[:, None], p.most)
    assert (low <= s).all() and (s <= high).all()
    low, high = hard_negatives.bracket(ask.min(axis=0), ask.max(axis=0), to.min(axis=0), to.max(axis=0), square.min(), square.max(), p.most)
    assert low <= s.min() and s.max() <= high
    least, highest = np.quantile(s, 0.6, axis=1), np.quantile(s, 0.9, axis=1)
    kept = hard_negatives.survivors(ask, to, square, p.most, least, highest)
    assert kept[(s >= least[:, None]) & (s <= highest[:, None])].all()


@given(st.integers(-(10**19), 10**19))
def test_bands_are_whole(score):
    low, high = hard_negatives.band(score, 30, 90)
    assert 100 * low >= 30 * score > 100 * (low - 1) and 100 * high <= 90 * score < 100 * (high + 1)


def test_far_clusters_are_pruned():
    """Rows of other clusters survive neither as runs nor one by one."""
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(20, 32)) * 1000
    at = np.repeat(np.arange(20), 200)
    x = np.round(centres[at] + rng.normal(size=(4000, 32)) * 20)
    p = hard_negatives.Pivots(np.arange(4000), np.zeros(4000, object), x, float((x * x).sum(axis=1).max()), 16)
    q = x[::50]
    square = (q * q).sum(axis=1)
    kept = hard_negatives.survivors(p.of_anchors(q), p.of_rows(x), square, p.most, 0.8 * square, np.full(len(q), np.inf))
    assert kept.mean() < 0.35 and kept[np.arange(len(q)), np.arange(0, 4000, 50)].all()


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01"])
def test_query_equals_sql(spark, scale):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '/root/testdata/{scale}/embeddings.parquet'")
    cur = con.execute(hard_negatives.ORACLE)
    names = [d[0] for d in cur.description]
    got = queries.op13_hard_negatives(spark, f"/root/testdata/{scale}")
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(cur.fetchall())
