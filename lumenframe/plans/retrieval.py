"""Vector search, ranking and fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe import schemas, storage
from lumenframe.functions import vectors as V
from lumenframe.operators import fusion, search, temporal
from lumenframe.operators.neighbour_graph import NeighbourGraph
from lumenframe.operators.stored_index import StoredIndex
from lumenframe.sources import sinks

from . import service
from .registry import FRAMES, POSITIONS, registrar

QUERIES: dict = {}
ORACLES: dict = {}
query = registrar(QUERIES, ORACLES)


def _topk(of: int, k: int, source: str = "f", where: str = "TRUE") -> str:
    """SQL of a top-k: frame ``of`` against ``source``."""
    return (
        f"SELECT folder, frame_id, list_cosine_similarity(v, (SELECT v FROM f WHERE frame_id = {of})) AS score, "
        f"row_number() OVER (ORDER BY list_cosine_similarity(v, (SELECT v FROM f WHERE frame_id = {of})) DESC, frame_id) AS rank "
        f"FROM {source} WHERE {where} ORDER BY rank LIMIT {k}"
    )


def _out(results: DataFrame) -> DataFrame:
    return results.select("folder", "frame_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


_OUT = "SELECT folder, frame_id, round(score, 6) AS score, rank FROM"


@query(f"WITH {FRAMES}, t AS ({_topk(0, 20)}) {_OUT} t")
def topk_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = schemas.frames(spark, sf_dir)
    return _out(search.topk_by_example(f, 0, 20))


@query(
    f"WITH {FRAMES}, q AS (SELECT v AS qv FROM f WHERE frame_id = 0), d AS (SELECT folder, frame_id, list_cosine_similarity(v, qv) AS score, list_distance(v, qv) AS dist FROM f, q), "
    f"t AS (SELECT *, row_number() OVER (ORDER BY dist, frame_id) AS rank FROM d ORDER BY rank LIMIT 20) SELECT folder, frame_id, round(least(greatest(score, 0), 1), 6) AS score, rank FROM t"
)
def topk_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(search.topk_by_example(schemas.frames(spark, sf_dir), 0, 20, metric="l2", clip=True))


@query(
    f"WITH {FRAMES}, t AS (SELECT q.frame_id AS query_id, c.folder, c.frame_id, list_cosine_similarity(q.v, c.v) AS score, row_number() OVER (PARTITION BY q.frame_id ORDER BY list_cosine_similarity(q.v, c.v) DESC, c.frame_id) AS rank "
    "FROM f q, f c WHERE q.frame_id % 20 = 0) SELECT query_id, folder, frame_id, round(score, 6) AS score, rank FROM t WHERE rank <= 10"
)
def topk_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = schemas.frames(spark, sf_dir)
    return _out_batch(search.topk_batch(f, _every_20th(f), 10))


def flagship(spark: SparkSession, sf_dir: str, of: int = 0, k: int = 20) -> DataFrame:
    f = schemas.frames(spark, sf_dir)
    r = temporal.with_context(search.topk_by_example(f, of, k), f)
    return r.select("folder", "frame_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"), F.array_join(F.col("context").cast("array<string>"), ",").alias("context"))


_CONTEXT = "c AS (SELECT folder, frame_id, list(frame_id) OVER (PARTITION BY folder ORDER BY frame_id ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS l FROM f WHERE frame_id >= 0)"


@query(
    f"WITH {FRAMES}, {_CONTEXT}, t AS ({_topk(7, 10)}) SELECT t.folder, t.frame_id, round(score, 6) AS score, rank, array_to_string(list_filter(l, lambda x: x <> t.frame_id), ',') AS context FROM t JOIN c ON t.frame_id = c.frame_id"
)
def search_by_example_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flagship(spark, sf_dir, 7, 10)


@query(f"WITH {FRAMES}, t AS ({_topk(7, 50)}) {_OUT} t WHERE score >= 0.2")
def topk_threshold_post(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(search.above(search.topk_by_example(schemas.frames(spark, sf_dir), 7, 50), 0.2))


@query(f"WITH {FRAMES}, t AS ({_topk(7, 20, where='folder < 5')}) {_OUT} t")
def topk_filtered_pre(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(search.topk_by_example(schemas.frames(spark, sf_dir), 7, 20, where=F.col("folder") < 5))


@query(f"WITH {FRAMES}, t AS ({_topk(7, 20)}) {_OUT} t WHERE folder < 5")
def topk_filtered_post(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(search.topk_by_example(schemas.frames(spark, sf_dir), 7, 20, where=F.col("folder") < 5, post_filter=True))


@query(f"WITH {FRAMES}, t AS ({_topk(7, 20)}) SELECT folder, frame_id, round(1 - score, 6) AS score, rank - 1 AS rank FROM t")
def container_score_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(search.container_scores(search.topk_by_example(schemas.frames(spark, sf_dir), 7, 20)))


def _exploded(frames: DataFrame) -> DataFrame:
    return frames.select("frame_id", F.posexplode("v").alias("dim", "x")).select("frame_id", F.col("dim").cast("long").alias("dim"), F.round("x", 6).alias("x"))


_DIMS = f"{FRAMES}, e AS (SELECT frame_id, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS dim FROM f)"


@query(f"WITH {_DIMS}, n AS (SELECT frame_id, sqrt(sum(x * x)) AS n FROM e GROUP BY 1) SELECT e.frame_id, dim, round(x / CASE WHEN n = 0 THEN 1 ELSE n END, 6) AS x FROM e JOIN n USING (frame_id)")
def normalize_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _exploded(V.normalise_columns(schemas.frames(spark, sf_dir), "l2"))


@query(f"WITH {_DIMS}, n AS (SELECT dim, min(x) AS a, max(x) - min(x) AS b FROM e GROUP BY 1) SELECT frame_id, dim, round((x - a) / CASE WHEN b = 0 THEN 1 ELSE b END, 6) AS x FROM e JOIN n USING (dim)")
def normalize_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _exploded(V.normalise_columns(schemas.frames(spark, sf_dir), "minmax"))


@query(f"WITH {_DIMS}, n AS (SELECT dim, avg(x) AS a, stddev_pop(x) AS b FROM e GROUP BY 1) SELECT frame_id, dim, round((x - a) / CASE WHEN b = 0 THEN 1 ELSE b END, 6) AS x FROM e JOIN n USING (dim)")
def normalize_standard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _exploded(V.normalise_columns(schemas.frames(spark, sf_dir), "standard"))


_GRAPH = (
    f"{FRAMES}, g AS (SELECT a.folder, a.frame_id AS src, b.frame_id AS dst, list_cosine_similarity(a.v, b.v) AS score, "
    "row_number() OVER (PARTITION BY a.frame_id ORDER BY list_cosine_similarity(a.v, b.v) DESC, b.frame_id) AS rank FROM f a JOIN f b ON a.folder = b.folder AND a.frame_id <> b.frame_id)"
)


@query(f"WITH {_GRAPH} SELECT folder, src, dst, round(score, 6) AS score, rank FROM g WHERE rank <= 10 AND score > 0.25")
def similarity_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = search.similarity_graph(schemas.frames(spark, sf_dir), 10, 0.25)
    return g.select("folder", "src", "dst", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(f"WITH {_GRAPH} SELECT folder, src, dst, round(score, 6) AS score, rank FROM g WHERE rank <= 10 AND score > 0.25 AND src = 7")
def similar_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = search.similar_frames(schemas.frames(spark, sf_dir), 7, 10, 0.25)
    return g.select("folder", "src", "dst", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


_CODE = "list_aggregate(list_transform(range(0, 63), lambda i: CASE WHEN v[i + 1] > 0 THEN (1::BIGINT << i::INT) ELSE 0 END), 'sum')::HUGEINT + CASE WHEN v[64] > 0 THEN -9223372036854775808::HUGEINT ELSE 0 END"


@query(
    f"WITH {FRAMES}, c AS (SELECT folder, frame_id, CAST({_CODE} AS BIGINT) AS code FROM f), q AS (SELECT code AS qc FROM c WHERE frame_id = 0) SELECT folder, frame_id, code, CAST(bit_count(xor(code, qc)) AS INTEGER) AS distance FROM c, q"
)
def lsh_codes_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = schemas.frames(spark, sf_dir).withColumn("code", V.sign_code("v"))
    q = f.where("frame_id = 0").select(F.col("code").alias("qc"))  # one row
    return f.crossJoin(F.broadcast(q)).select("folder", "frame_id", "code", V.hamming("code", "qc").alias("distance"))


def _every_20th(frames: DataFrame) -> DataFrame:
    return frames.where("frame_id % 20 = 0").select(F.col("frame_id").alias("query_id"), "v")


def _out_batch(results: DataFrame) -> DataFrame:
    return results.select("query_id", "folder", "frame_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query()
def ann_lsh(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = schemas.frames(spark, sf_dir)
    return _out_batch(search.lsh_topk_batch(f, _every_20th(f), 10))


@query()
def ann_kmeans_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = schemas.frames(spark, sf_dir)
    centres, coded = search.kmeans_cells(f)
    return _out_batch(search.cell_topk_batch(coded, centres, _every_20th(f), 10))


def _stored_recall(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """Every 20th frame searched in a stored index or graph: queries, true neighbours, and whether nine tenths of them are found."""
    f = schemas.frames(spark, sf_dir)
    path = storage.shared_path(spark) + "-index"
    index = NeighbourGraph.build(f, path) if kind == "graph" else StoredIndex.build(f, path, kind)
    storage.delete_at_exit(spark, path)
    found = index.search(_every_20th(f), 10).select(F.col("query_id").alias("q"), F.col("frame_id").alias("near"))
    exact = search.topk_batch(f, _every_20th(f), 10).select("query_id", "frame_id")
    met = exact.join(found, (F.col("query_id") == F.col("q")) & (F.col("frame_id") == F.col("near")), "left")
    return met.agg(F.count_distinct("query_id").alias("queries"), F.count("*").alias("neighbours"), (10 * F.count("near") >= 9 * F.count("*")).alias("recall_reached"))


_RECALL = f"WITH {FRAMES} SELECT count(*) AS queries, CAST(sum((SELECT least(10, count(*)) FROM f)) AS BIGINT) AS neighbours, TRUE AS recall_reached FROM f WHERE frame_id % 20 = 0"


@query(_RECALL)
def ann_ivf_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored_recall(spark, sf_dir, "ivf")


@query(_RECALL)
def ann_lsh_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored_recall(spark, sf_dir, "lsh")


@query(_RECALL)
def ann_graph_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored_recall(spark, sf_dir, "graph")


# --- ranking and fusion


@query(
    f"WITH {FRAMES}, a AS ({_topk(0, 30)}), b AS ({_topk(1, 30)}) SELECT coalesce(a.folder, b.folder) AS folder, coalesce(a.frame_id, b.frame_id) AS frame_id, "
    "round(coalesce(a.score, 0) * 0.7 + coalesce(b.score, 0) * 0.3, 6) AS score, row_number() OVER (ORDER BY coalesce(a.score, 0) * 0.7 + coalesce(b.score, 0) * 0.3 DESC, coalesce(a.frame_id, b.frame_id)) AS rank "
    "FROM a FULL OUTER JOIN b ON a.frame_id = b.frame_id"
)
def fusion_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = schemas.frames(spark, sf_dir)
    return _out(fusion.rank_results(fusion.weighted_fusion(search.topk_by_example(f, 0, 30), search.topk_by_example(f, 1, 30))))


def _hybrid(second: str) -> str:
    return (
        f"WITH {FRAMES}, a AS (SELECT * FROM ({_topk(7, 50)}) WHERE score >= 0.2), e0 AS ({_topk(7, 25)}), e1 AS ({_topk(8, 25)}), "
        "u AS (SELECT *, 0 AS l FROM e0 UNION ALL SELECT *, 1 AS l FROM e1), "
        "m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY l, rank) AS k FROM u) WHERE k = 1 ORDER BY l, rank LIMIT 50), "
        f"b AS (SELECT * FROM m WHERE {second}), "
        "j AS (SELECT coalesce(a.folder, b.folder) AS folder, coalesce(a.frame_id, b.frame_id) AS frame_id, coalesce(a.score, 0) * 0.7 + coalesce(b.score, 0) * 0.3 AS score FROM a FULL OUTER JOIN b ON a.frame_id = b.frame_id), "
        "z AS (SELECT * FROM j WHERE (SELECT count(*) FROM a) >= 5 UNION ALL SELECT folder, frame_id, score FROM a WHERE (SELECT count(*) FROM a) < 5) "
        "SELECT folder, frame_id, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, frame_id) AS rank FROM z QUALIFY rank <= 50"
    )


def _run_hybrid(spark: SparkSession, sf_dir: str, strict: bool) -> DataFrame:
    f = schemas.frames(spark, sf_dir)
    vectors = [search.vector_of(f, i) for i in (7, 8)]
    return _out(fusion.hybrid(f, vectors[0], vectors, limit=50, threshold=0.2, strict=strict))


@query(_hybrid("TRUE"))
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run_hybrid(spark, sf_dir, False)


@query(_hybrid("score >= 0.2"))
def hybrid_search_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run_hybrid(spark, sf_dir, True)


@query(
    f"WITH {FRAMES}, a AS ({_topk(0, 20)}), b AS ({_topk(1, 20)}), c AS ({_topk(2, 20)}), u AS (SELECT *, 0 AS list_no FROM a UNION ALL SELECT *, 1 FROM b UNION ALL SELECT *, 2 FROM c), "
    "k AS (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY list_no, rank) AS n FROM u) SELECT folder, frame_id, round(score, 6) AS score, rank, CAST(list_no AS INTEGER) AS list_no FROM k WHERE n = 1"
)
def merge_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = schemas.frames(spark, sf_dir)
    m = fusion.merge_dedup([search.topk_by_example(f, i, 20) for i in range(3)])
    return m.select("folder", "frame_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"), "list_no")


@query(f"WITH {FRAMES}, t AS ({_topk(7, 10)}) {_OUT} t")
def federated_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = schemas.frames(spark, sf_dir)
    parts = [f.where(F.col("folder") % 3 == i) for i in range(3)]
    return _out(fusion.federated_topk(parts, search.vector_of(f, 7), 10))


@query(
    f"WITH {FRAMES}, " + ", ".join(f"t{i} AS ({_topk(7, 10, where=f'folder % 3 = {i}')})" for i in range(3)) + " "
    + " UNION ALL ".join(f"SELECT folder, frame_id, round(score, 6) AS score, rank, 'node{i}' AS source_server FROM t{i}" for i in range(3))
)
def multi_server_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = schemas.frames(spark, sf_dir)
    q = search.vector_of(f, 7)
    r = fusion.multi_server({f"node{i}": search.topk(f.where(F.col("folder") % 3 == i), q, 10) for i in range(3)})
    return r.select("folder", "frame_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"), "source_server")


@query(
    f"WITH {FRAMES}, t AS ({_topk(7, 20)}) SELECT folder, frame_id, rank, CASE WHEN rank <= 10 THEN printf('This frame matches your query ''red car'' based on visual similarity (score: %.3f).', score) END AS explanation FROM t"
)
def explain_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = fusion.explain(search.topk_by_example(schemas.frames(spark, sf_dir), 7, 20), "red car")
    return r.select("folder", "frame_id", F.col("rank").cast("long").alias("rank"), "explanation")


@query(
    f"WITH {FRAMES}, {_CONTEXT}, t AS ({_topk(7, 10)}), n AS (SELECT t.rank, t.folder, unnest(list_filter(l, lambda x: x <> t.frame_id)) AS near_id, generate_subscripts(list_filter(l, lambda x: x <> t.frame_id), 1) AS j FROM t JOIN c ON t.frame_id = c.frame_id) "
    "SELECT 'rank' || rank AS key, folder AS keyframe, frame_id AS frameid, round(score, 4) AS similarity_score FROM t UNION ALL SELECT 'near' || rank || '.' || j, folder, near_id, NULL FROM n"
)
def detail_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = schemas.frames(spark, sf_dir)
    d = search.detail(temporal.with_context(search.topk_by_example(f, 7, 10), f), "standard")
    p = F.from_json("payload", "keyframe int, frameid long, similarity_score double")
    return d.select("key", p["keyframe"].alias("keyframe"), p["frameid"].alias("frameid"), p["similarity_score"].alias("similarity_score"))


@query(f"WITH {FRAMES}, t AS ({_topk(7, 30)}), s AS ({_topk(8, 10)}) {_OUT} t WHERE frame_id NOT IN (SELECT frame_id FROM s)")
def hide_displayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = schemas.frames(spark, sf_dir)
    fresh, _ = fusion.hide_displayed(search.topk_by_example(f, 7, 30), search.topk_by_example(f, 8, 10))
    return _out(fresh)


@query(f"WITH {FRAMES}, t AS ({_topk(7, 20)}) SELECT folder, frame_id, round(least(greatest(score, 0), 1), 6) AS score, rank FROM t")
def result_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(fusion.validate(search.topk_by_example(schemas.frames(spark, sf_dir), 7, 20)))


@query(f"""WITH {FRAMES}, t AS ({_topk(7, 100)}) SELECT rank, folder || '.csv,' || frame_id || ',"three red cars"' AS line FROM t""")
def submission_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = search.topk_by_example(schemas.frames(spark, sf_dir), 7, 100).withColumn("image", F.col("frame_id"))
    return sinks.submission_lines(r, "three red cars").select(F.col("rank").cast("long").alias("rank"), "line")


@query(f"WITH {FRAMES}, t AS ({_topk(7, 20)}) SELECT rank AS Rank, folder AS Folder, frame_id AS FrameID, printf('%.4f', score) AS Similarity FROM t")
def export_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = search.topk_by_example(schemas.frames(spark, sf_dir), 7, 20).withColumn("image", F.col("frame_id")).withColumn("file_path", F.lit(""))
    return sinks.export_rows(r).select(F.col("Rank").cast("long").alias("Rank"), "Folder", "FrameID", "Similarity")


_SEQUENCES = (
    f"WITH {POSITIONS}, x AS (SELECT b.folder, a.pos AS i, b.pos AS j, b.pos - a.pos AS d, list_cosine_similarity(a.v, b.v) AS sim FROM p a, p b WHERE a.folder = 0 AND b.folder <> 0), "
    "w AS (SELECT folder, i, j, avg(sim) OVER r AS score, count(*) OVER r AS n FROM x WINDOW r AS (PARTITION BY folder, d ORDER BY i ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)) "
    "SELECT folder, i AS target_start, j AS start, round(score, 6) AS score FROM w WHERE n = 3 AND score >= 0.10"
)


@query(_SEQUENCES)
def sequence_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sequence of folder 0 against those of all other folders."""
    p = temporal.ordered(schemas.frames(spark, sf_dir))
    m = temporal.sequence_match(p.where("folder = 0"), p.where("folder <> 0"), 3, 0.10)
    return m.select("folder", "target_start", "start", F.round("score", 6).alias("score"))


@query(_SEQUENCES)
def sequence_match_seeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same windows, grown from pairs of near frames; in large tables, where these are a fifth of all pairs, all windows are scored."""
    p = temporal.ordered(schemas.frames(spark, sf_dir))
    m = temporal.seeded_match(p.where("folder = 0"), p.where("folder <> 0"), 3, 0.10)
    return m.select("folder", "target_start", "start", F.round("score", 6).alias("score"))


@query(
    f"WITH {FRAMES}, i AS ({_topk(7, 10)}), d AS (SELECT folder, frame_id, row_number() OVER (ORDER BY list_distance(v, (SELECT v FROM f WHERE frame_id = 7)), frame_id) AS rank FROM f) "
    "SELECT s AS strategy, frame_id, rank FROM i, (VALUES ('exact_ip'), ('hnsw')) t(s) UNION ALL SELECT 'exact_l2', frame_id, rank FROM d WHERE rank <= 10"
)
def index_strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = schemas.frames(spark, sf_dir)
    vector = search.vector_of(f, 7)
    lists = {s: search.VectorIndex(f, s, recall=1.0).build().search(vector, 10) for s in ("exact_ip", "exact_l2", "hnsw")}
    return fusion.multi_server(lists).select(F.col("source_server").alias("strategy"), "frame_id", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {FRAMES}, t AS ({_topk(7, 20)}) SELECT folder, frame_id, round(score, 6) AS score, rank FROM t WHERE score >= 0.2")
def remote_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answer of a remote handle, as JSON without ranks, read back as results."""
    found = search.topk_by_example(schemas.frames(spark, sf_dir), 7, 20).orderBy("rank")
    item = F.struct(F.struct(F.col("folder").cast("string").alias("folder_name"), "frame_id").alias("metadata"), F.col("score").alias("similarity_score"))
    payload = "[" + ",".join(r[0] for r in found.select(F.to_json(item)).collect()) + "]"  # at most 20 results
    rows = service.remote_rows(spark, payload, 50, 0.2)
    return rows.select(F.col("folder").cast("int").alias("folder"), "frame_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))
