import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.functions import vectors as V
from lumenframe.operators import fusion, search
from lumenframe.plans import catalog

ROWS = [(0, 1, [1.0, 0.0]), (0, 2, [0.0, 0.0]), (0, 3, [1.0, 0.0]), (0, 4, [-1.0, 0.0]), (1, 5, [0.6, 0.8])]


@pytest.fixture(scope="module")
def frames(spark):
    return spark.createDataFrame(ROWS, "folder int, frame_id long, v array<double>")


def test_cosine_zero_missing_and_clip(frames):
    q = F.array(F.lit(1.0), F.lit(0.0))
    r = {x.frame_id: (x.c, x.k) for x in frames.select("frame_id", V.cosine("v", q).alias("c"), V.cosine("v", q, clip=True).alias("k")).collect()}
    assert r[2] == (0.0, 0.0) and r[4] == (-1.0, 0.0) and r[1] == (1.0, 1.0)


def test_normalise_keeps_zero_vector(frames):
    r = {x.frame_id: x.v for x in V.normalise_columns(frames, "l2").collect()}
    assert r[2] == [0.0, 0.0] and r[5] == pytest.approx([0.6, 0.8])


def test_normalise_columns_zero_range(spark):
    df = spark.createDataFrame([(1, [1.0, 5.0]), (2, [3.0, 5.0])], "frame_id long, v array<double>")
    assert {x.frame_id: x.v for x in V.normalise_columns(df, "minmax").collect()} == {1: [0.0, 0.0], 2: [1.0, 0.0]}
    assert {x.frame_id: x.v for x in V.normalise_columns(df, "standard").collect()} == {1: [-1.0, 0.0], 2: [1.0, 0.0]}
    with pytest.raises(ValueError):
        V.normalise_columns(df, "other")


def test_validity(spark):
    df = spark.createDataFrame([(1, [1.0]), (2, [float("nan")]), (3, None), (4, []), (5, [1.0, 2.0])], "i int, v array<double>")
    assert [x.ok for x in df.select("i", V.is_valid("v", 1).alias("ok")).orderBy("i").collect()] == [True, False, False, False, False]


def test_topk_ties_and_order(frames):
    assert [x.frame_id for x in search.topk(frames, [1.0, 0.0], 3).orderBy("rank").collect()] == [1, 3, 5]
    assert [x.frame_id for x in search.topk(frames, [1.0, 0.0], 3, metric="l2").orderBy("rank").collect()][:2] == [1, 3]


def test_example_includes_itself_and_unknown_is_empty(frames):
    assert search.topk_by_example(frames, 5, 1).first().frame_id == 5
    assert search.topk_by_example(frames, 99, 1).count() == 0


def test_post_filter_returns_fewer(frames):
    where = F.col("folder") == 1
    assert search.topk(frames, [1.0, 0.0], 2, where=where).count() == 1
    assert search.topk(frames, [1.0, 0.0], 2, where=where, post_filter=True).count() == 0


def test_batch_equals_numpy_in_any_number_of_blocks(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((300, 8))
    frames = spark.createDataFrame([(i % 3, i, x[i].tolist()) for i in range(300)], "folder int, frame_id long, v array<double>").repartition(5)
    queries = frames.where("frame_id % 7 = 0").select(F.col("frame_id").alias("query_id"), "v")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {(q, int(f)) for q in range(0, 300, 7) for f in np.argsort(-(unit @ unit[q]), kind="stable")[:5]}
    for block in (4096, 10):
        got = search.topk_batch(frames, queries, 5, query_block=block).collect()
        assert {(r.query_id, r.frame_id) for r in got} == want


def test_graph_excludes_self_not_copies(frames):
    g = search.similarity_graph(frames, 10, 0.7).collect()
    assert {(r.src, r.dst) for r in g} == {(1, 3), (3, 1)}


def test_options():
    with pytest.raises(ValueError):
        search.SearchOptions(limit=0)
    with pytest.raises(ValueError):
        search.SearchOptions(mode="x")
    with pytest.raises(ValueError):
        search.SearchOptions(similarity_threshold=1.5)
    assert search.SearchOptions().cache_key("a") != search.SearchOptions(limit=10).cache_key("a")


def test_hybrid_early_out_and_subthreshold_rows(spark):
    frames = spark.createDataFrame([(0, i, [1.0, i / 10.0]) for i in range(12)], "folder int, frame_id long, v array<double>")
    few = fusion.hybrid(frames, [1.0, 0.0], limit=12, threshold=0.98).collect()
    assert len(few) == 3  # under five: vector results alone
    many = fusion.hybrid(frames, [1.0, 0.0], limit=12, threshold=0.9).collect()
    assert len(many) == 12  # frames under the threshold come back with the second weight
    strict = fusion.hybrid(frames, [1.0, 0.0], limit=12, threshold=0.9, strict=True).collect()
    assert len(strict) == 5
    low = [r for r in many if r.score < 0.3 * 0.9]
    assert low


def test_merge_first_wins_and_selection_cap(frames):
    a, b = search.topk(frames, [1.0, 0.0], 2), search.topk(frames, [0.0, 1.0], 2)
    m = fusion.merge_dedup([a, b]).collect()
    assert len({r.frame_id for r in m}) == len(m)
    s = fusion.selection_list(a, b, cap=3).collect()
    assert len(s) == 3


def test_lsh_and_cells_find_exact_copies(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((200, 16))
    frames = spark.createDataFrame([(0, i, x[i].tolist()) for i in range(200)], "folder int, frame_id long, v array<double>")
    assert search.lsh_topk(frames, x[3].tolist(), 5, candidates=50).orderBy("rank").first().frame_id == 3
    centres, coded = search.kmeans_cells(frames, 6)
    exact = {r.frame_id for r in search.topk(frames, x[3].tolist(), 10).collect()}
    got = {r.frame_id for r in search.cell_topk(coded, centres, x[3].tolist(), 10, probes=6).collect()}
    assert got == exact


@pytest.mark.parametrize("name", ["ann_lsh", "ann_kmeans_cells"])
def test_approximate_queries_recall(spark, name):
    sf = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    true = {(int(ids[i]), int(ids[j])) for i in np.flatnonzero(ids % 20 == 0) for j in np.lexsort((ids, -(x @ x[i])))[:10]}
    got = catalog.QUERIES[name](spark, sf).collect()
    assert len(got) == len(true) and {r.query_id for r in got} == {i for i, _ in true}
    recall = len(true & {(r.query_id, r.frame_id) for r in got}) / len(true)
    print(name, "recall", recall)
    assert recall >= 0.9


def test_approximate_recall_holds_on_a_larger_table(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((20_000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    frames = spark.createDataFrame([(0, i, v) for i, v in enumerate(x.tolist())], "folder int, frame_id long, v array<double>").repartition(6).persist()
    queries = frames.where("frame_id % 400 = 0").select(F.col("frame_id").alias("query_id"), "v")
    true = {(q, int(j)) for q in range(0, 20_000, 400) for j in np.argsort(-(x @ x[q]), kind="stable")[:10]}
    centres, coded = search.kmeans_cells(frames, 40, sample=4000)
    for name, found in (("lsh", search.lsh_topk_batch(frames, queries, 10)), ("cells", search.cell_topk_batch(coded, centres, queries, 10))):
        recall = len(true & {(r.query_id, r.frame_id) for r in found.collect()}) / len(true)
        print(name, "recall on 20,000 rows", recall)
        assert recall >= 0.9


def test_a_large_batch_has_bounded_blocks():
    """The scores that a task of a large batch holds at once take 64 MB at most."""
    import inspect

    block = inspect.signature(search.topk_batch).parameters["frame_block"].default
    assert block * 256 * 8 <= 64 << 20


def test_cells_are_fitted_by_all_cores_and_assigned_once(spark, monkeypatch):
    from pyspark.ml.clustering import KMeans

    x = np.random.default_rng(9).standard_normal((400, 8))
    frames = spark.createDataFrame([(0, i, v) for i, v in enumerate(x.tolist())], "folder long, frame_id long, v array<double>")
    parts, fit = [], KMeans.fit
    monkeypatch.setattr(KMeans, "fit", lambda self, df, *a: parts.append(df.rdd.getNumPartitions()) or fit(self, df, *a))
    centres, coded = search.kmeans_cells(frames, 6)
    assert parts == [spark.sparkContext.defaultParallelism] and len(coded.inputFiles()) > 0
    queries = frames.where("frame_id < 300").select(F.col("frame_id").alias("query_id"), "v")
    got = {(r.query_id, r.frame_id) for r in search.cell_topk_batch(coded, centres, queries, 5, 6).collect()}
    assert got == {(r.query_id, r.frame_id) for r in search.topk_batch(frames, queries, 5).collect()}
