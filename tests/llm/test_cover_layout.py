"""The coarse tree: whatever the sample, results are those of brute force, and clustered rows go to few cells."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumenframe.llm import cover_tree


def brute(rows, k=5):
    out = []
    for q, x in rows:
        if q % 50 == 0:
            s = sorted((-sum(int(a) * int(b) for a, b in zip(x, y, strict=True)), c) for c, y in rows if c != q and len(y) == len(x))[:k]
            out += [(q, r + 1, c, -v) for r, (v, c) in enumerate(s)]
    return sorted(out)


@pytest.mark.parametrize(("sample", "blocks"), [(1, 64), (40, 16), (4096, 4096)])
def test_equals_brute_force_whatever_the_sample(spark, sample, blocks):
    rng = np.random.default_rng(sample)
    centres = rng.normal(size=(9, 6)) * 3
    rows = [(i, np.round(256 * (centres[i % 9] + rng.normal(size=6) * 0.05)).tolist()) for i in range(600)]
    rows += [(600 + i, rows[7][1]) for i in range(120)] + [(800 + i, [1.0 + i, 2.0]) for i in range(60)] + [(950, [5.0])]
    t = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    got = cover_tree.exact_topk(t, F.col("vec_id") % 50 == 0, scale=1, sample=sample, query_block=max(2, blocks // 8), cand_block=blocks)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows)


def test_clustered_rows_are_sent_a_few_times(spark):
    def sent(n):
        rng = np.random.default_rng(4)
        clusters = n // 125
        centres = 1000 * np.eye(64)
        rows = [(i, (centres[i % clusters] + rng.integers(-3, 4, 64)).tolist()) for i in range(n)]
        t = spark.createDataFrame(rows, "id long, x array<double>").withColumn("q", F.col("id") % 5 == 0)
        q, c = cover_tree.sent(t, 5, 64, 128, 512)
        return q.count(), c.count()

    # four times the rows and clusters: every row goes to the blocks that hold its own cluster, however many others there are
    small, large = sent(2_000), sent(8_000)
    assert large[0] < 5 * small[0] and large[1] < 5 * small[1]
    assert large[1] < 3 * 8_000 and large[0] < 4 * 1_600


def test_rows_of_null_id_take_no_part(spark):
    t = spark.createDataFrame([(None, [9.0]), (0, [1.0]), (1, [2.0])], "vec_id long, embedding array<double>")
    got = cover_tree.exact_topk(t, F.col("vec_id") % 50 == 0, scale=1)
    assert [tuple(r) for r in got.collect()] == [(0, 1, 1, 2)]


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(0, 40), st.integers(1, 500), min_size=1), st.integers(1, 100))
def test_blocks_are_bounded_and_cover_all(counts, size):
    dealt = cover_tree.deal(counts, size)
    held = {}
    for node, n in counts.items():
        first, parts = dealt[node]
        for b in range(first, first + parts):
            held[b] = held.get(b, 0) + n / parts
    assert max(held.values()) <= max(size, 1) * 2 and sorted(held) == list(range(max(held) + 1))


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 1000))
def test_pruned_pairs_hold_no_result(seed):
    rng = np.random.default_rng(seed)
    x = rng.integers(-50, 50, (80, 3)).astype(float) + 300 * np.eye(3)[rng.integers(3, size=80)]
    ids = np.arange(80)
    coarse = cover_tree.Coarse(ids[:30].tolist(), x[:30].tolist(), 3)
    node, away = coarse.place(x)
    floor = coarse.floors(x, ids)
    asks = {n: (away[node == n].max(), floor[node == n].min()) for n in set(node.tolist())}
    pairs, least = coarse.reach(asks, {n: (r, (node == n).sum() > 3) for n, (r, _) in asks.items()})
    kept = set(pairs)
    s = x @ x.T
    np.fill_diagonal(s, -np.inf)
    for i in range(80):
        kth = np.sort(s[i])[-3]
        assert max(floor[i], least[node[i]]) <= kth
        assert all((node[i], node[j]) in kept for j in range(80) if i != j and s[i, j] >= kth)
