"""The pruned similarity join against all pairs, its split homes, and what it shuffles."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lumenframe.operators import graph, search, tiles


def _frames(spark, x, folder):
    return spark.createDataFrame(pd.DataFrame({"folder": folder, "frame_id": np.arange(len(x)), "v": [list(map(float, v)) for v in x]}), "folder long, frame_id long, v array<double>").repartition(4)


def _data(seed, n=260, d=5, folders=2):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((12, d))[rng.integers(12, size=n)] + rng.choice([0.02, 0.2, 0.8]) * rng.standard_normal((n, d))
    x[rng.integers(n, size=6)] = x[0]  # copies
    x[rng.integers(1, n, size=2)] = 0  # no direction
    x *= rng.uniform(0.1, 5, (n, 1))
    return x, rng.integers(folders, size=n)


def _pairs(x, folder, least):
    m = tiles.unit_rows(x)
    s = m @ m.T
    return {(i, j) for i in range(len(x)) for j in range(len(x)) if i < j and folder[i] == folder[j] and s[i, j] >= least}


@settings(max_examples=5, deadline=None)
@given(st.integers(0, 10**6), st.sampled_from([0.3, 0.7, 0.95]), st.sampled_from([8, 40]), st.sampled_from([10, 60]))
def test_all_pairs_are_met_once(spark, seed, least, tile, cell):
    x, folder = _data(seed)

    def compare(a, x, b, y, same):
        s = x @ y.T if len(a) and len(b) else np.zeros((len(a), len(b)))
        i, j = np.nonzero(np.triu(s >= least, 1) if same else s >= least)
        return [np.minimum(a[i], b[j]), np.maximum(a[i], b[j])]

    got = [(r.src, r.dst) for r in tiles.near_pairs(_frames(spark, x, folder), compare, "src long, dst long", least, tile, cell).collect()]
    assert len(got) == len(set(got)) and set(got) == _pairs(x, folder, least)


@pytest.mark.parametrize("cell", [20, 10_000])
def test_graph_and_clusters_are_those_of_all_pairs(spark, cell):
    x, folder = _data(11, n=300)
    f = _frames(spark, x, folder)
    got = sorted(map(tuple, search.similarity_graph(f, 4, 0.8, tile=32, cell=cell).select("src", "dst", "rank").collect()))
    m, want = tiles.unit_rows(x), []
    for i in range(len(x)):
        s = [(-(m[i] @ m[j]), j) for j in range(len(x)) if j != i and folder[i] == folder[j] and m[i] @ m[j] > 0.8]
        want += [(i, j, r + 1) for r, (_, j) in enumerate(sorted((round(a, 12), j) for a, j in s)[:4])]
    assert {(a, b) for a, b, _ in got} >= {(a, b) for a, b, r in want if r < 4} and len(got) == len(want)
    found = {r.frame_id: r.cluster for r in graph.cosine_clusters(f, 0.1, "each", tile=32, cell=cell).collect()}
    links = _pairs(x, folder, 0.9)
    assert all(found[a] == found[b] for a, b in links)
    parent = list(range(len(x)))
    for _ in range(len(x)):
        changed = False
        for a, b in links:
            low = min(parent[a], parent[b])
            changed |= parent[a] != low or parent[b] != low
            parent[a] = parent[b] = low
        if not changed:
            break
    assert found == dict(enumerate(parent))


def test_rows_that_are_sent_grow_with_the_table(spark):
    """Four times the rows in four times the clusters, about two homes to a cluster: each row still goes to a few homes."""

    def sent(n):
        rng = np.random.default_rng(2)
        x = rng.standard_normal((n // 50, 24))[np.arange(n) % (n // 50)] + 0.05 * rng.standard_normal((n, 24))
        return tiles._met(_frames(spark, x, np.zeros(n, int)), 25, float(np.sqrt(2 - 2 * 0.95))).count() / n

    small, large = sent(1_500), sent(6_000)
    print(small, large)
    assert large < 3 and large < 1.3 * small


def test_a_home_of_very_many_rows_is_split(spark):
    """All rows in one place: tasks are bounded by tiles, and the clusters are right."""
    x = np.ones((700, 3)) + 0.001 * np.random.default_rng(0).standard_normal((700, 3))
    f = _frames(spark, x, np.zeros(700, int))
    tasks = tiles.near_pairs(f, lambda a, x, b, y, same: [np.array([len(a)]), np.array([len(b)])], "m long, n long", 0.9, 64, 50).collect()
    assert len(tasks) > 60 and max(max(r.m, r.n) for r in tasks) < 150
    assert {r.cluster for r in graph.cosine_clusters(f, 0.1, tile=64, cell=50).collect()} == {0}


def test_bounds_that_prune_nothing_send_no_guests(spark, monkeypatch):
    """Vectors in all directions: a row meets the tiles of its folder, not nearly all homes; clustered ones keep their homes."""
    rng = np.random.default_rng(6)
    wide, narrow = rng.standard_normal((1_200, 16)), np.eye(24, 24)[np.arange(1_200) % 24] + 0.01 * rng.standard_normal((1_200, 24))
    chosen, link = [], lambda a, x, b, y, same: tiles.forest(a, b, np.triu(x @ y.T >= 0.6, 1) if same else x @ y.T >= 0.6)
    met = tiles._met
    monkeypatch.setattr(tiles, "_met", lambda *a, **b: chosen.append(met(*a, **b)) or chosen[-1])
    for x in (wide, narrow):
        tiles.near_pairs(_frames(spark, x, np.zeros(len(x), int)), link, "src long, dst long", 0.6, 200, 25).collect()
    assert chosen[0] is None and chosen[1].count() < 2 * len(narrow)
