"""The neighbour graph: quality of its lists, recall of searches, bounded rounds and lists."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lumenframe.operators import neighbour_graph, search
from lumenframe.operators.neighbour_graph import NeighbourGraph


def _frames(spark, x):
    return spark.createDataFrame(pd.DataFrame({"folder": np.arange(len(x)) % 3, "frame_id": np.arange(len(x)), "v": list(x)}), "folder long, frame_id long, v array<double>").repartition(6)


def _true(x, ids, k=10):
    return {(int(q), int(f)) for q in ids for f in np.lexsort((np.arange(len(x)), -(x @ x[q])))[:k]}


def test_recall_on_clustered_vectors(spark, tmp_path):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((60, 24))[rng.integers(60, size=3_000)] + 0.5 * rng.standard_normal((3_000, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    frames = _frames(spark, x)
    NeighbourGraph.build(frames, f"{tmp_path}/g", sample=1_500)
    index = NeighbourGraph.open(spark, f"{tmp_path}/g")
    lists = index.rows().select("frame_id", F.size("near").alias("n")).agg(F.max("n").alias("most"), F.count("*").alias("rows")).first()
    assert lists["most"] <= 16 and lists["rows"] == 3_000 and not index.exact
    ids = list(range(7, 3_000, 100))
    queries = spark.createDataFrame([(i, x[i].tolist()) for i in ids], "query_id long, v array<double>")
    found = index.search(queries, 10).collect()
    true = _true(x, ids)
    exact = {(r.query_id, r.frame_id) for r in search.topk_batch(frames, queries, 10).collect()}
    assert exact == true
    recall = len(true & {(r.query_id, r.frame_id) for r in found}) / len(true)
    print("width", index.width, "recall", recall)
    assert recall >= 0.9 and len(found) == len(true)
    assert all(abs(r.score - float(x[r.query_id] @ x[r.frame_id])) < 1e-9 for r in found)


def test_descent_finds_neighbours_that_no_first_group_holds(spark):
    """From groups dealt at random, lists come to hold nearly all true neighbours."""
    rng = np.random.default_rng(0)
    x = rng.standard_normal((1_500, 6))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "id long, v array<double>")
    # two groups a row, so that groups share rows
    homes = rows.select(F.explode(F.array(F.pmod(F.xxhash64("id"), F.lit(60)), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(60)) + 60)).alias("g"), "id", "v")
    lists = neighbour_graph.descend(rows, homes, 10, rounds=6).collect()
    true = _true(x, range(1_500), 11)
    true = {(a, b) for a, b in true if a != b}
    first = len({(r.id, r.near) for r in neighbour_graph._lists(neighbour_graph.meetings(homes, 10), 10).collect()} & true) / len(true)
    last = len({(r.id, r.near) for r in lists} & true) / len(true)
    assert first < 0.2 and last > 0.9
    assert max(pd.Series([r.id for r in lists]).value_counts()) == 10 and all(r.id != r.near for r in lists)


def test_a_hot_row_is_cut_in_parts(spark):
    """One row that all others list: no window holds all of its list."""
    pairs = spark.range(20_000).select(F.lit(7).cast("long").alias("id"), F.col("id").alias("near"), F.rand(1).alias("score"))
    got = neighbour_graph.best_of(pairs, "id", 5, F.desc("score"), "near")
    assert [r.near for r in got.orderBy(F.desc("score")).collect()] == [r.near for r in pairs.orderBy(F.desc("score")).limit(5).collect()]


def test_odd_tables(spark, tmp_path):
    schema = "folder string, frame_id int, v array<double>"
    one = spark.createDataFrame([(0, [1.0, 0.0])], "query_id long, v array<double>")
    empty = NeighbourGraph.build(spark.createDataFrame([], schema), f"{tmp_path}/e")
    assert empty.search(one, 3).count() == 0 and dict(NeighbourGraph.open(spark, f"{tmp_path}/e").search(one, 3).dtypes)["frame_id"] == "int"
    rows = [("a", 1, [2.0, 0.0]), ("a", 2, None), (None, 3, [0.0, 0.0]), ("b", 4, [-1.0, 0.0])] + [("c", 10 + i, [1.0, 1.0]) for i in range(40)]
    index = NeighbourGraph.build(spark.createDataFrame(rows, schema), f"{tmp_path}/r", k=3)
    got = index.search(one, 3, width=40).orderBy("rank").collect()
    assert [r.frame_id for r in got] == [1, 10, 11]
    assert index.search(one.limit(0), 3).count() == 0
    with pytest.raises(ValueError):
        NeighbourGraph.build(spark.createDataFrame(rows + rows, schema), f"{tmp_path}/d")


def test_a_large_table_is_walked_in_shards(spark, tmp_path, monkeypatch):
    """Rows without clusters, in several shards: the graph answers, not the exact search, and opens a part of the table."""
    monkeypatch.setattr(neighbour_graph, "SHARD", 1_000)
    x = np.random.default_rng(4).standard_normal((6_000, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    index = NeighbourGraph.build(_frames(spark, x), f"{tmp_path}/g")
    assert not index.exact and index.width < 1_000 and 6 <= len(index.centres) <= 15
    assert index.rows().groupBy("cell").count().agg(F.max("count")).first()[0] < 1_200
    ids = list(range(3, 6_000, 100))
    found = index.search(spark.createDataFrame([(i, x[i].tolist()) for i in ids], "query_id long, v array<double>"), 10).collect()
    true = _true(x, ids)
    assert len(true & {(r.query_id, r.frame_id) for r in found}) >= 0.9 * len(true)


def test_copies_come_in_the_order_of_their_ids(spark, tmp_path):
    x = np.random.default_rng(5).standard_normal((1_500, 8))
    x[200:900] = x[200]
    index = NeighbourGraph.build(_frames(spark, x), f"{tmp_path}/g")
    found = index.search(spark.createDataFrame([(0, x[200].tolist())], "query_id long, v array<double>"), 10, width=20).orderBy("rank").collect()
    assert not index.exact and [r.frame_id for r in found] == list(range(200, 210))
