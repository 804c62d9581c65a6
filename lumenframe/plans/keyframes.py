"""Temporal order, scenes, keyframe reduction, clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe import schemas
from lumenframe.functions import vectors as V
from lumenframe.operators import graph, reduce, temporal

from .registry import FRAMES, POSITIONS, SIMILARITIES, registrar

QUERIES: dict = {}
ORACLES: dict = {}
query = registrar(QUERIES, ORACLES)


def _ids(column: str):
    return F.array_join(F.col(column).cast("array<string>"), ",")


@query(f"WITH {POSITIONS} SELECT folder, frame_id, pos, count(*) OVER (PARTITION BY folder) AS total_frames FROM p")
def temporal_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = temporal.ordered(schemas.frames(spark, sf_dir))
    return p.select("folder", "frame_id", "pos", F.count("*").over(temporal.Window.partitionBy("folder")).alias("total_frames"))


@query(
    f"WITH {POSITIONS}, c AS (SELECT folder, frame_id, list(frame_id) OVER (PARTITION BY folder ORDER BY frame_id ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS l FROM p) "
    "SELECT folder, frame_id, array_to_string(list_filter(l, lambda x: x <> frame_id), ',') AS context FROM c"
)
def temporal_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.neighbours(schemas.frames(spark, sf_dir), 3).select("folder", "frame_id", _ids("context").alias("context"))


@query(f"WITH {POSITIONS} SELECT folder, frame_id, lag(frame_id) OVER w AS prev_id, lead(frame_id) OVER w AS next_id FROM p WINDOW w AS (PARTITION BY folder ORDER BY frame_id)")
def prev_next_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.prev_next(schemas.frames(spark, sf_dir))


@query(
    f"WITH {POSITIONS}, c AS (SELECT folder, frame_id, list(frame_id) OVER (PARTITION BY folder ORDER BY frame_id ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS l FROM p) "
    "SELECT folder, frame_id, array_to_string(l, ',') AS around, array_to_string(l[greatest(0, len(l) // 2 - 3) + 1 : greatest(0, len(l) // 2 - 3) + 7], ',') AS centred FROM c"
)
def centered_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.centred_context(schemas.frames(spark, sf_dir), 5, 3).select("folder", "frame_id", _ids("around").alias("around"), _ids("centred").alias("centred"))


def _gap(gap: int) -> str:
    return (
        f"WITH {POSITIONS}, g AS (SELECT folder, frame_id, CASE WHEN frame_id - lag(frame_id) OVER (PARTITION BY folder ORDER BY frame_id) > {gap} THEN 1 ELSE 0 END AS c FROM p), "
        "h AS (SELECT *, CAST(sum(c) OVER (PARTITION BY folder ORDER BY frame_id) AS BIGINT) AS scene_id FROM g) SELECT folder, scene_id, min(frame_id) AS start_id, max(frame_id) AS end_id FROM h GROUP BY 1, 2"
    )


@query(_gap(10))
def gap_scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.gap_scenes(schemas.frames(spark, sf_dir), 10)


@query(_gap(5))
def gap_scenes_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.gap_scenes(schemas.frames(spark, sf_dir))


@query(f"WITH {SIMILARITIES} SELECT folder, frame_id, round(sim, 6) AS sim FROM s")
def neighbor_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.sequential_similarity(schemas.frames(spark, sf_dir)).select("folder", "frame_id", F.round("sim", 6).alias("sim"))


@query(f"WITH {SIMILARITIES} SELECT folder, round(avg(sim), 6) AS avg_sim, count(sim) AS pairs FROM s GROUP BY 1")
def average_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.sequential_similarity(schemas.frames(spark, sf_dir)).groupBy("folder").agg(F.round(F.avg("sim"), 6).alias("avg_sim"), F.count("sim").alias("pairs"))


@query(f"WITH {SIMILARITIES} SELECT folder, pos, round(sim, 6) AS sim FROM s WHERE sim < -0.1")
def scene_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.transition_points(schemas.frames(spark, sf_dir), -0.1).select("folder", "pos", F.round("sim", 6).alias("sim"))


_LABELS = "l AS (SELECT *, CAST(sum(CASE WHEN sim < {t} THEN 1 ELSE 0 END) OVER (PARTITION BY folder ORDER BY frame_id) AS BIGINT) AS scene_id FROM s)"
_GROUPS = f"{SIMILARITIES}, {_LABELS.format(t=-0.1)}, g AS (SELECT folder, scene_id, min(pos) AS start_pos, max(pos) AS end_pos FROM l GROUP BY 1, 2 HAVING max(pos) - min(pos) + 1 >= 2)"


@query(f"WITH {_GROUPS} SELECT * FROM g")
def scene_groups_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.scene_groups(schemas.frames(spark, sf_dir), -0.1, 2)


@query(f"WITH {SIMILARITIES} SELECT folder, pos AS start_pos FROM s WHERE pos = 0 OR sim < 0.0 UNION ALL SELECT folder, count(*) FROM s GROUP BY 1")
def scene_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.scene_starts(schemas.frames(spark, sf_dir), 0.0)


@query(
    f"WITH {_GROUPS}, n AS (SELECT folder, count(*) AS n FROM p GROUP BY 1), x AS (SELECT g.folder, end_pos, lead(start_pos) OVER (PARTITION BY g.folder ORDER BY start_pos) AS ns, n FROM g JOIN n USING (folder)) "
    "SELECT DISTINCT folder, unnest(range(greatest(0, end_pos - 2), least(n, ns + 3))) AS pos FROM x WHERE ns IS NOT NULL"
)
def transition_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = schemas.frames(spark, sf_dir)
    counts = f.groupBy("folder").agg(F.count("*").alias("n"))
    return temporal.transition_frames(temporal.scene_groups(f, -0.1, 2), counts)


@query(
    f"WITH RECURSIVE {SIMILARITIES}, n AS (SELECT folder, count(*) AS n FROM p GROUP BY 1), "
    "r AS (SELECT folder, 0::BIGINT AS start_pos, n FROM n UNION ALL SELECT r.folder, (SELECT min(s.pos) FROM s WHERE s.folder = r.folder AND s.sim < 0.0 AND s.pos - 1 - r.start_pos >= 5 AND r.n >= 10), r.n FROM r WHERE r.start_pos IS NOT NULL) "
    "SELECT folder, start_pos, coalesce(lead(start_pos) OVER (PARTITION BY folder ORDER BY start_pos) - 1, n - 1) AS end_pos FROM r WHERE start_pos IS NOT NULL"
)
def similarity_scenes_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.similarity_scenes(schemas.frames(spark, sf_dir), 0.0, 5)


@query(
    f"WITH {FRAMES}, d AS (SELECT folder, (frame_id - lag(frame_id) OVER (PARTITION BY folder ORDER BY frame_id))::DOUBLE AS step FROM f), "
    "a AS (SELECT folder, count(*) AS total, avg(step) AS mean, stddev_pop(step) AS std, min(step) AS least, max(step) AS most FROM d GROUP BY 1) "
    "SELECT folder, total, round(mean, 6) AS mean, round(std, 6) AS std, least, most, CASE WHEN total < 2 THEN 'insufficient_data' WHEN std > 0.5 * mean THEN 'irregular' WHEN mean < 2 THEN 'dense' WHEN mean > 10 THEN 'sparse' ELSE 'regular' END AS pattern FROM a"
)
def interval_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = temporal.interval_patterns(schemas.frames(spark, sf_dir))
    return p.select("folder", "total", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "least", "most", "pattern")


@query(f"WITH {_GROUPS}, b AS (SELECT p.folder, p.pos, max(g.start_pos) AS scene_start FROM p LEFT JOIN g ON p.folder = g.folder AND g.start_pos <= p.pos GROUP BY 1, 2) SELECT * FROM b")
def as_of_scene(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = schemas.frames(spark, sf_dir)
    return temporal.as_of_scene(temporal.ordered(f), temporal.scene_groups(f, -0.1, 2))


# --- removal of near-duplicates

_PAIRS = "m AS (SELECT a.folder, a.pos AS i, b.pos AS j, list_cosine_similarity(a.v, b.v) AS c FROM p a JOIN p b ON a.folder = b.folder AND a.pos < b.pos)"


@query(
    f"WITH RECURSIVE {POSITIONS}, {_PAIRS}, r AS (SELECT folder, 0::BIGINT AS pos FROM p WHERE pos = 0 UNION ALL SELECT r.folder, (SELECT min(m.j) FROM m WHERE m.folder = r.folder AND m.i = r.pos AND m.c < 0.05) FROM r WHERE r.pos IS NOT NULL) "
    "SELECT p.folder, p.frame_id FROM r JOIN p ON p.folder = r.folder AND p.pos = r.pos"
)
def last_kept_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reduce.last_kept_dedup(temporal.ordered(schemas.frames(spark, sf_dir)), 0.05)


@query(
    f"WITH RECURSIVE {POSITIONS}, {_PAIRS}, n AS (SELECT folder, max(pos) AS last FROM p GROUP BY 1), "
    "r AS (SELECT folder, 0::BIGINT AS pos FROM p WHERE pos = 0 UNION ALL SELECT r.folder, (SELECT min(m.j) FROM m JOIN n ON n.folder = m.folder WHERE m.folder = r.folder AND m.i = r.pos AND ((m.c < 0.05 AND m.j - m.i >= 2) OR m.j = n.last)) FROM r WHERE r.pos IS NOT NULL) "
    "SELECT p.folder, p.frame_id FROM r JOIN p ON p.folder = r.folder AND p.pos = r.pos"
)
def greedy_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = temporal.ordered(schemas.frames(spark, sf_dir))
    p = p.withColumn("last_pos", F.max("pos").over(temporal.Window.partitionBy("folder")))
    return reduce.greedy_dedup(p, 0.05, 2)


def _stepped(similar: str, recent: str) -> str:
    """SQL fold that steps row by row with the list of kept positions."""
    return (
        f"w AS (SELECT p.folder, p.pos, p.frame_id, coalesce((SELECT list(m.i) FROM m WHERE m.folder = p.folder AND m.j = p.pos AND {similar}), []) AS alike FROM p), "
        "r AS (SELECT folder, pos, frame_id, TRUE AS keep, [pos] AS kept FROM w WHERE pos = 0 UNION ALL "
        f"SELECT w.folder, w.pos, w.frame_id, NOT list_has_any({recent}, w.alike), CASE WHEN list_has_any({recent}, w.alike) THEN r.kept ELSE list_append(r.kept, w.pos) END FROM r JOIN w ON w.folder = r.folder AND w.pos = r.pos + 1) "
        "SELECT folder, frame_id FROM r WHERE keep"
    )


@query(f"WITH RECURSIVE {POSITIONS}, {_PAIRS}, " + _stepped("m.c >= 0.1 AND m.i >= m.j - 5", "r.kept"))
def windowed_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reduce.windowed_dedup(temporal.ordered(schemas.frames(spark, sf_dir)), 0.1, 5)


@query(f"WITH RECURSIVE {POSITIONS}, {_PAIRS}, " + _stepped("m.c >= 0.2", "r.kept[-10:]"))
def recent_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reduce.recent_dedup(temporal.ordered(schemas.frames(spark, sf_dir)), 0.2, 10)


_BITS = "list_transform(v[1:64], lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END)"


@query(
    f"WITH RECURSIVE {POSITIONS}, b AS (SELECT folder, pos, {_BITS} AS b FROM p), m AS (SELECT x.folder, x.pos AS i, y.pos AS j, list_sum(list_transform(list_zip(x.b, y.b), lambda z: CASE WHEN z[1] <> z[2] THEN 1 ELSE 0 END)) AS c FROM b x JOIN b y ON x.folder = y.folder AND x.pos < y.pos), "
    + _stepped("m.c <= 24", "r.kept[-10:]")
)
def hash_window_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = temporal.ordered(schemas.frames(spark, sf_dir)).withColumn("code", V.sign_code("v"))
    return reduce.hash_dedup(p, 24, 10)


_COMPONENTS = (
    f"{FRAMES}, e AS (SELECT a.frame_id AS x, b.frame_id AS y FROM f a JOIN f b ON a.folder = b.folder AND a.frame_id <> b.frame_id AND 1 - list_cosine_similarity(a.v, b.v) <= 0.75), "
    "r AS (SELECT frame_id AS id, frame_id AS root FROM f UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.id), c AS (SELECT id, min(root) AS root FROM r GROUP BY 1)"
)


@query(f"WITH RECURSIVE {_COMPONENTS} SELECT f.folder, f.frame_id, c.root AS cluster FROM f JOIN c ON c.id = f.frame_id")
def cluster_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.cosine_clusters(schemas.frames(spark, sf_dir), 0.75, "each")


@query(
    f"WITH RECURSIVE {_COMPONENTS}, n AS (SELECT root, count(*) AS n FROM c GROUP BY 1) SELECT f.folder, f.frame_id, CASE WHEN n.n = 1 THEN -1 ELSE c.root END AS cluster FROM f JOIN c ON c.id = f.frame_id JOIN n ON n.root = c.root"
)
def cluster_noise_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.cosine_clusters(schemas.frames(spark, sf_dir), 0.75, "one")


@query(
    f"WITH RECURSIVE {_COMPONENTS}, k AS (SELECT f.folder, f.frame_id, f.v, c.root FROM f JOIN c ON c.id = f.frame_id), "
    "d AS (SELECT folder, root, i, avg(v[i]) AS m FROM k, range(1, 65) t(i) GROUP BY 1, 2, 3), q AS (SELECT folder, root, list(m ORDER BY i) AS m FROM d GROUP BY 1, 2), "
    "s AS (SELECT k.folder, k.root, k.frame_id, row_number() OVER (PARTITION BY k.folder, k.root ORDER BY round(list_cosine_similarity(k.v, q.m), 9) DESC, k.frame_id) AS n, count(*) OVER (PARTITION BY k.folder, k.root) AS members FROM k JOIN q USING (folder, root)) "
    "SELECT folder, root AS cluster, frame_id, members FROM s WHERE n = 1"
)
def cluster_representative(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = schemas.frames(spark, sf_dir)
    members = f.join(graph.cosine_clusters(f, 0.75, "each"), ["folder", "frame_id"])
    return graph.representatives(members)


# --- quality and pipelines; documents stand in for scored frames

_QUALITY = "q AS (SELECT source AS folder, doc_id AS frame_id, n_chars::DOUBLE AS blur_score, len(list_distinct(string_split(text, ' '))) / len(string_split(text, ' '))::DOUBLE AS edge_density FROM documents)"


def _quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = schemas.table(spark, sf_dir, "documents")
    words = F.split("text", " ")
    return d.select(F.col("source").alias("folder"), F.col("doc_id").alias("frame_id"), F.col("n_chars").cast("double").alias("blur_score"), (F.size(F.array_distinct(words)) / F.size(words).cast("double")).alias("edge_density"))


_ADAPTIVE = f"{_QUALITY}, t AS (SELECT folder, quantile_cont(blur_score, 0.1) AS pb, quantile_cont(edge_density, 0.1) AS pe FROM q GROUP BY 1), j AS (SELECT q.*, CASE WHEN blur_score < pb THEN 'blur' WHEN edge_density < pe THEN 'low_edge' ELSE 'acceptable' END AS reason FROM q JOIN t USING (folder))"


@query(f"WITH {_ADAPTIVE} SELECT folder, frame_id, reason FROM j")
def quality_gate_adaptive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reduce.quality_adaptive(_quality(spark, sf_dir)).select("folder", "frame_id", "reason")


@query(f"WITH {_QUALITY} SELECT folder, frame_id, CASE WHEN blur_score < 500 THEN 'blur' WHEN edge_density < 0.5 THEN 'low_edge' ELSE 'acceptable' END AS reason FROM q")
def quality_gate_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reduce.quality_fixed(_quality(spark, sf_dir), 500.0, 0.5).select("folder", "frame_id", "reason")


@query(
    f"WITH {_ADAPTIVE} SELECT folder, count(*) AS total, count(*) FILTER (WHERE reason = 'blur') AS rejected_blur, count(*) FILTER (WHERE reason = 'low_edge') AS rejected_edge, count(*) FILTER (WHERE reason = 'acceptable') AS kept, "
    "min(blur_score) AS min_blur, max(blur_score) AS max_blur, quantile_cont(blur_score, 0.5) AS median_blur, count(*) FILTER (WHERE reason = 'acceptable') / count(*) < 0.3 AS low_keep_rate FROM j GROUP BY 1"
)
def quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reduce.quality_report(reduce.quality_adaptive(_quality(spark, sf_dir)))


_PIPE = (
    f"{SIMILARITIES}, {_LABELS.format(t=-0.1)}, z AS (SELECT *, row_number() OVER (PARTITION BY folder, scene_id ORDER BY pos) - 1 AS q, count(*) OVER (PARTITION BY folder, scene_id) AS size FROM l), y AS (SELECT * FROM z WHERE size >= 2), "
    "m AS (SELECT a.folder, a.scene_id, a.q AS i, b.q AS j, list_cosine_similarity(a.v, b.v) AS c, b.size FROM y a JOIN y b ON a.folder = b.folder AND a.scene_id = b.scene_id AND a.q < b.q), "
    "r AS (SELECT folder, scene_id, 0::BIGINT AS q FROM y WHERE q = 0 UNION ALL SELECT r.folder, r.scene_id, (SELECT min(m.j) FROM m WHERE m.folder = r.folder AND m.scene_id = r.scene_id AND m.i = r.q AND (m.c < 0.05 OR m.j = m.size - 1)) FROM r WHERE r.q IS NOT NULL), "
    "o AS (SELECT y.folder, y.scene_id, y.frame_id FROM r JOIN y ON y.folder = r.folder AND y.scene_id = r.scene_id AND y.q = r.q)"
)


def _pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = reduce.ReductionConfig(quality=False, transition=-0.1, similarity=0.05)
    return reduce.quality_pipeline(schemas.frames(spark, sf_dir), config)


@query(f"WITH RECURSIVE {_PIPE} SELECT folder, scene_id, frame_id, row_number() OVER (PARTITION BY folder ORDER BY frame_id) - 1 AS n FROM o")
def keyframe_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pipeline(spark, sf_dir)


@query(
    f"WITH RECURSIVE {_PIPE}, k AS (SELECT f.folder, f.frame_id, o.frame_id AS kept FROM f LEFT JOIN o ON o.frame_id = f.frame_id) "
    "SELECT folder, count(*) AS original, count(kept) AS kept, count(*) - count(kept) AS removed, round(100 * count(kept) / count(*), 4) AS kept_percent FROM k GROUP BY ROLLUP (folder)"
)
def reduction_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reduce.reduction_report(schemas.frames(spark, sf_dir), _pipeline(spark, sf_dir).select("frame_id"))


# --- the whole pipeline, with the quality gate: documents give the scores of the frames with their ids

_JUDGED = (
    "f AS (SELECT label AS folder, vec_id AS frame_id, list_transform(embedding, lambda x: x::DOUBLE) AS v, n_chars::DOUBLE AS blur_score, len(list_distinct(string_split(text, ' '))) / len(string_split(text, ' '))::DOUBLE AS edge_density FROM embeddings JOIN documents ON doc_id = vec_id), "
    "t AS (SELECT folder, quantile_cont(blur_score, 0.1) AS pb, quantile_cont(edge_density, 0.1) AS pe FROM f GROUP BY 1), g AS (SELECT f.* FROM f JOIN t USING (folder) WHERE blur_score >= pb AND edge_density >= pe), "
    "p AS (SELECT folder, frame_id, v, row_number() OVER (PARTITION BY folder ORDER BY frame_id) - 1 AS pos FROM g), "
    "s AS (SELECT *, CASE WHEN pos > 0 THEN list_cosine_similarity(v, lag(v) OVER (PARTITION BY folder ORDER BY frame_id)) END AS sim FROM p), "
)
_STAGED = _JUDGED + _PIPE.removeprefix(SIMILARITIES + ", ")
_TAGGED = (
    _STAGED + ", k AS (SELECT f.folder, f.frame_id, z.scene_id, z.sim, CASE WHEN z.frame_id IS NULL THEN 'quality' WHEN z.size < 2 THEN 'scene' WHEN o.frame_id IS NULL THEN 'dedup' END AS removed_by "
    "FROM f LEFT JOIN z ON z.frame_id = f.frame_id LEFT JOIN o ON o.frame_id = f.frame_id)"
)
_REPORT = (
    _TAGGED + ", h AS (SELECT folder, count(*) AS original, count(*) FILTER (WHERE removed_by IS NULL) AS kept, count(*) FILTER (WHERE removed_by = 'quality') AS removed_quality, count(*) FILTER (WHERE removed_by = 'scene') AS removed_scene, "
    "count(*) FILTER (WHERE removed_by = 'dedup') AS removed_dedup, round(100 * count(*) FILTER (WHERE removed_by IS NULL) / count(*), 4) AS kept_percent, count(DISTINCT scene_id) FILTER (WHERE removed_by IS NULL OR removed_by = 'dedup') AS scenes, "
    "count(*) FILTER (WHERE sim < -0.1) AS transitions, round(avg(sim), 6) AS average_similarity FROM k GROUP BY 1)"
)
_CONFIG = reduce.ReductionConfig(transition=-0.1, similarity=0.05)


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = _quality(spark, sf_dir).select(F.col("frame_id").alias("scored"), "blur_score", "edge_density")
    return schemas.frames(spark, sf_dir).join(q, F.col("frame_id") == F.col("scored")).drop("scored")


@query(f"WITH RECURSIVE {_TAGGED} SELECT folder, frame_id, scene_id, round(sim, 6) AS sim, removed_by FROM k")
def staged_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reduce.tagged_pipeline(_scored(spark, sf_dir), _CONFIG).withColumn("sim", F.round("sim", 6))


@query(f"WITH RECURSIVE {_REPORT} SELECT * FROM h")
def stage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reduce.stage_report(reduce.tagged_pipeline(_scored(spark, sf_dir), _CONFIG), -0.1)


@query(f"WITH RECURSIVE {_REPORT} SELECT count(*) AS folders, count(*) FILTER (WHERE kept > 0) AS successful, CAST(sum(original) AS BIGINT) AS original, CAST(sum(kept) AS BIGINT) AS kept, round(avg(kept_percent), 4) AS mean_kept_percent FROM h")
def stage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reduce.stage_summary(stage_report(spark, sf_dir))


@query(
    f"WITH RECURSIVE {_REPORT}, y2 AS (SELECT count(*) AS videos, CAST(sum(original) AS BIGINT) AS frames, CAST(sum(kept) AS BIGINT) AS keyframes FROM h) SELECT *, round(1 - keyframes / frames, 6) AS reduction, keyframes // videos AS per_video FROM y2"
)
def batch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reduce.batch_summary(stage_report(spark, sf_dir))


@query(f"WITH RECURSIVE {_STAGED} SELECT y.folder, y.scene_id, count(*) AS original, count(o.frame_id) AS filtered, count(*) - count(o.frame_id) AS removed FROM y LEFT JOIN o ON o.frame_id = y.frame_id GROUP BY 1, 2")
def dedup_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    tagged = reduce.tagged_pipeline(_scored(spark, sf_dir), _CONFIG)
    return reduce.dedup_report(tagged.where("removed_by is null or removed_by = 'dedup'"), tagged.where("removed_by is null"))


_WINDOWED = (
    _JUDGED + "l AS (SELECT *, CAST(sum(CASE WHEN sim < -0.1 THEN 1 ELSE 0 END) OVER (PARTITION BY folder ORDER BY frame_id) AS BIGINT) AS scene_id FROM s), "
    "z AS (SELECT *, row_number() OVER (PARTITION BY folder, scene_id ORDER BY pos) - 1 AS q, count(*) OVER (PARTITION BY folder, scene_id) AS size FROM l), y AS (SELECT * FROM z WHERE size >= 2), "
    "m AS (SELECT a.folder, a.scene_id, a.q AS i, b.q AS j, list_cosine_similarity(a.v, b.v) AS c FROM y a JOIN y b ON a.folder = b.folder AND a.scene_id = b.scene_id AND a.q < b.q), "
    "w AS (SELECT y.folder, y.scene_id, y.q, y.frame_id, coalesce((SELECT list(m.i) FROM m WHERE m.folder = y.folder AND m.scene_id = y.scene_id AND m.j = y.q AND m.c >= 0.1 AND m.i >= m.j - 5), []) AS alike FROM y), "
    "r AS (SELECT folder, scene_id, q, frame_id, TRUE AS keep, [q] AS kept FROM w WHERE q = 0 UNION ALL SELECT w.folder, w.scene_id, w.q, w.frame_id, NOT list_has_any(r.kept, w.alike), CASE WHEN list_has_any(r.kept, w.alike) THEN r.kept ELSE list_append(r.kept, w.q) END "
    "FROM r JOIN w ON w.folder = r.folder AND w.scene_id = r.scene_id AND w.q = r.q + 1)"
)


@query(f"WITH RECURSIVE {_WINDOWED} SELECT folder, scene_id, frame_id, row_number() OVER (PARTITION BY folder ORDER BY frame_id) - 1 AS n FROM r WHERE keep")
def windowed_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = reduce.ReductionConfig(transition=-0.1, similarity=0.1, windowed=True)
    return reduce.quality_pipeline(_scored(spark, sf_dir), config)


_LEVELS = (
    f"{SIMILARITIES}, {_LABELS.format(t=0.0)}, z AS (SELECT *, row_number() OVER (PARTITION BY folder, scene_id ORDER BY pos) - 1 AS q, {_BITS} AS b FROM l), "
    # by hash, within scenes
    "hm AS (SELECT x.folder, x.scene_id, x.q AS i, y.q AS j FROM z x JOIN z y ON x.folder = y.folder AND x.scene_id = y.scene_id AND x.q < y.q WHERE list_sum(list_transform(list_zip(x.b, y.b), lambda e: CASE WHEN e[1] <> e[2] THEN 1 ELSE 0 END)) <= 20), "
    "hw AS (SELECT z.folder, z.scene_id, z.q, z.frame_id, coalesce((SELECT list(hm.i) FROM hm WHERE hm.folder = z.folder AND hm.scene_id = z.scene_id AND hm.j = z.q), []) AS alike FROM z), "
    "hr AS (SELECT folder, scene_id, q, frame_id, TRUE AS keep, [q] AS kept FROM hw WHERE q = 0 UNION ALL SELECT w.folder, w.scene_id, w.q, w.frame_id, NOT list_has_any(r.kept[-10:], w.alike), CASE WHEN list_has_any(r.kept[-10:], w.alike) THEN r.kept ELSE list_append(r.kept, w.q) END "
    "FROM hr r JOIN hw w ON w.folder = r.folder AND w.scene_id = r.scene_id AND w.q = r.q + 1), hk AS (SELECT z.folder, z.scene_id, z.frame_id, z.v FROM hr JOIN z ON z.frame_id = hr.frame_id WHERE hr.keep), "
    # clusters of a scene, and the member nearest to each mean
    "ce AS (SELECT a.frame_id AS x, b.frame_id AS y FROM hk a JOIN hk b ON a.folder = b.folder AND a.scene_id = b.scene_id AND a.frame_id <> b.frame_id AND 1 - list_cosine_similarity(a.v, b.v) <= 0.8), "
    "cr AS (SELECT frame_id AS id, frame_id AS root FROM hk UNION SELECT ce.y, cr.root FROM cr JOIN ce ON ce.x = cr.id), cc AS (SELECT id, min(root) AS root FROM cr GROUP BY 1), cn AS (SELECT root, count(*) AS n FROM cc GROUP BY 1), "
    "cm AS (SELECT hk.*, CASE WHEN cn.n = 1 THEN -1 ELSE cc.root END AS cluster FROM hk JOIN cc ON cc.id = hk.frame_id JOIN cn ON cn.root = cc.root), "
    "cd AS (SELECT folder, scene_id, cluster, i, avg(v[i]) AS m FROM cm, range(1, 65) t(i) GROUP BY 1, 2, 3, 4), cq AS (SELECT folder, scene_id, cluster, list(m ORDER BY i) AS m FROM cd GROUP BY 1, 2, 3), "
    "cs AS (SELECT cm.frame_id, row_number() OVER (PARTITION BY cm.folder, cm.scene_id, cm.cluster ORDER BY round(list_cosine_similarity(cm.v, cq.m), 9) DESC, cm.frame_id) AS n FROM cm JOIN cq ON cq.folder = cm.folder AND cq.scene_id = cm.scene_id AND cq.cluster = cm.cluster), "
    # by vector, across scenes
    "bk AS (SELECT l.folder, l.frame_id, l.v, row_number() OVER (PARTITION BY l.folder ORDER BY l.pos) - 1 AS q FROM l JOIN cs ON cs.frame_id = l.frame_id WHERE cs.n = 1), "
    "bm AS (SELECT a.folder, a.q AS i, b.q AS j FROM bk a JOIN bk b ON a.folder = b.folder AND a.q < b.q AND list_cosine_similarity(a.v, b.v) >= 0.2), "
    "bw AS (SELECT bk.folder, bk.q, bk.frame_id, coalesce((SELECT list(bm.i) FROM bm WHERE bm.folder = bk.folder AND bm.j = bk.q), []) AS alike FROM bk), "
    "br AS (SELECT folder, q, frame_id, TRUE AS keep, [q] AS kept FROM bw WHERE q = 0 UNION ALL SELECT w.folder, w.q, w.frame_id, NOT list_has_any(r.kept[-10:], w.alike), CASE WHEN list_has_any(r.kept[-10:], w.alike) THEN r.kept ELSE list_append(r.kept, w.q) END "
    "FROM br r JOIN bw w ON w.folder = r.folder AND w.q = r.q + 1)"
)


@query(f"WITH RECURSIVE {_LEVELS} SELECT folder, frame_id FROM br WHERE keep")
def multilevel_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reduce.multilevel_pipeline(schemas.frames(spark, sf_dir), scene=0.0, hash_distance=20, eps=0.8, similarity=0.2)
