"""Vector search: exact top-k, by example, in batches, thresholds, detail levels, approximate strategies."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.functions import text as T
from lumenframe.functions import vectors as V
from lumenframe.operators import health, tiles
from lumenframe.storage import delete_at_exit, shared_path, stored

MODES = ("hybrid", "vector", "semantic")
# fixed values: other names of modes that requests may use
MODE_NAMES = {"clip_only": "vector", "llm_enhanced": "semantic"}
#: Frames of a block, and queries that are scored against it at once: what a task of a large batch holds.
FRAME_BLOCK, QUERY_STEP = 16_384, 256
STRATEGIES = ("exact_ip", "exact_l2", "hnsw", "lsh", "kmeans_cells")


@dataclass(frozen=True)
class SearchOptions:
    """Validated options of a search."""

    mode: str = "hybrid"
    limit: int = 50
    similarity_threshold: float = 0.0
    include_temporal_context: bool = True
    temporal_window: int = 3
    include_explanations: bool = True

    def __post_init__(self):
        object.__setattr__(self, "mode", MODE_NAMES.get(self.mode, self.mode))
        if self.mode not in MODES:
            raise ValueError(f"mode must be one of {MODES}")
        if not 0 < self.limit <= 1000:
            raise ValueError("limit must be in 1..1000")
        if not 0 <= self.similarity_threshold <= 1:
            raise ValueError("similarity_threshold must be in 0..1")

    def cache_key(self, query: str) -> tuple:
        """All that decides the result."""
        return (query, *self.__dict__.values())


def topk(frames: DataFrame, query: list[float], k: int, *, metric: str = "ip", clip: bool = False, where: Column | None = None, post_filter: bool = False) -> DataFrame:
    """The k best frames for one vector: ``folder, frame_id, score, rank``.

    ``metric='l2'`` ranks by squared distance and reports the cosine.  A
    predicate filters before the ranking, or after it with ``post_filter``,
    which then may return fewer rows.  One scan and a bounded heap per task.
    """
    q = F.array(*[F.lit(float(x)) for x in query])
    source = frames if where is None or post_filter else frames.where(where)
    scored = source.withColumn("score", V.cosine("v", q, clip))
    order = F.desc("score") if metric == "ip" else F.asc("__distance")
    if metric == "l2":
        scored = scored.withColumn("__distance", V.squared_distance("v", q))
    best = scored.orderBy(order, "frame_id").limit(k)
    ranked = best.withColumn("rank", F.row_number().over(Window.orderBy(order, "frame_id")))  # k rows
    if where is not None and post_filter:
        ranked = ranked.where(where)
    return ranked.select("folder", "frame_id", "score", "rank")


def vector_of(frames: DataFrame, frame_id: int) -> list[float] | None:
    """The stored vector of a frame; None if it is unknown or has none."""
    row = frames.where(F.col("frame_id") == frame_id).select("v").first()
    return None if row is None else row["v"]


def topk_by_example(frames: DataFrame, frame_id: int, k: int, **options) -> DataFrame:
    """Search by a stored frame; that frame itself is included; an unknown one gives no rows."""
    vector = vector_of(frames, frame_id)
    if vector is None:
        return topk(frames.limit(0), [], k)
    return topk(frames, vector, k, **options)


def topk_batch(frames: DataFrame, queries: DataFrame, k: int, *, query_block: int = 4096, frame_block: int = FRAME_BLOCK) -> DataFrame:
    """The k best frames of every query (``query_id, v``): ``query_id, folder, frame_id, score, rank``.

    Queries are a stated set and are counted.  Up to ``query_block`` of them
    meet the frames in one pass without a shuffle, one matrix product per
    Arrow batch.  A larger set is dealt into blocks, as are the frames, and
    each pair of blocks is one task: one pass for any number of queries, and
    no query comes to the driver.  Either way a task sends on at most k rows
    for each query.
    """
    queries = queries.where("v is not null")
    if (n := queries.count()) <= query_block:
        found = _score_block(frames, queries.select("query_id", "v").toArrow(), k)
    else:
        found = _score_cells(frames, queries, k, -(-n // query_block), frame_block)
    return _ranked(found, k)


def _score_cells(frames: DataFrame, queries: DataFrame, k: int, q_blocks: int, frame_block: int) -> DataFrame:
    frames = frames.select("folder", "frame_id", "v").where("v is not null")
    f_blocks = max(1, -(-frames.count() // frame_block))
    kinds = dict(frames.dtypes)
    deal = lambda n: F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = queries.select("query_id", "v", deal(q_blocks).alias("__q")).withColumn("__f", every(f_blocks))
    f = frames.select(*[F.col(c).alias(c) for c in frames.columns], deal(f_blocks).alias("__f")).withColumn("__q", every(q_blocks))

    def cell(q, f):
        import pandas as pd

        if not len(q) or not len(f):
            return pd.DataFrame({"query_id": [], "folder": [], "frame_id": [], "score": []})
        m, other, frame = tiles.unit_rows(q["v"]), tiles.unit_rows(f["v"]).T, f["frame_id"].to_numpy()
        rows, cols, scores = [], [], []
        for at in range(0, len(m), QUERY_STEP):
            for i, line in enumerate(m[at : at + QUERY_STEP] @ other, at):
                best = np.flatnonzero(line >= np.partition(line, len(line) - k)[len(line) - k]) if len(line) > k else np.arange(len(line))
                best = best[np.lexsort((frame[best], -line[best]))][:k]
                rows.append(np.full(len(best), i))
                cols.append(best)
                scores.append(line[best])
        rows, cols = np.concatenate(rows), np.concatenate(cols)
        return pd.DataFrame({"query_id": q["query_id"].to_numpy()[rows], "folder": f["folder"].to_numpy()[cols], "frame_id": frame[cols], "score": np.concatenate(scores)})

    schema = f"query_id {dict(queries.dtypes)['query_id']}, folder {kinds['folder']}, frame_id {kinds['frame_id']}, score double"
    return q.groupBy("__q", "__f").cogroup(f.groupBy("__q", "__f")).applyInPandas(cell, schema)


def _score_block(frames: DataFrame, queries: pa.Table, k: int) -> DataFrame:
    ids = queries.column("query_id").to_numpy()
    matrix = _matrix(queries.column("v").combine_chunks())
    shared = frames.sparkSession.sparkContext.broadcast((ids, _unit(matrix)))
    kinds = dict(frames.dtypes)

    def score(batches: Iterator[pa.RecordBatch]):
        ids, q = shared.value
        for batch in batches:
            if not batch.num_rows or not len(q):
                continue
            frame = batch.column(1).to_numpy(zero_copy_only=False)
            s = q @ _unit(_matrix(batch.column(2))).T
            rows, cols = [], []
            for i, line in enumerate(s):
                if len(line) > k:
                    kth = np.partition(line, len(line) - k)[len(line) - k]
                    best = np.flatnonzero(line >= kth - 1e-12)  # ties at the kth are settled later
                else:
                    best = np.arange(len(line))
                best = best[np.lexsort((frame[best], -line[best]))][:k]
                rows.append(np.full(len(best), i))
                cols.append(best)
            rows, cols = np.concatenate(rows), np.concatenate(cols)
            take = pa.array(cols)
            yield pa.RecordBatch.from_arrays([pa.array(ids[rows]), batch.column(0).take(take), batch.column(1).take(take), pa.array(s[rows, cols])], names=["query_id", "folder", "frame_id", "score"])

    return frames.select("folder", "frame_id", "v").where("v is not null").mapInArrow(score, f"query_id long, folder {kinds['folder']}, frame_id {kinds['frame_id']}, score double")


def _matrix(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _unit(m: np.ndarray) -> np.ndarray:
    if not m.size:
        return m
    length = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return m / np.where(length == 0, 1.0, length)


def above(results: DataFrame, threshold: float) -> DataFrame:
    """Drops results under the threshold, after the ranking; 0 keeps all."""
    return results.where(F.col("score") >= threshold) if threshold > 0 else results


def container_scores(results: DataFrame) -> DataFrame:
    """The container's convention: 0-based rank and ``1 - inner product`` as score."""
    return results.withColumn("score", 1 - F.col("score")).withColumn("rank", F.col("rank") - 1)


def similarity_graph(frames: DataFrame, neighbours: int = 10, threshold: float = 0.7, *, sources: Column | None = None, tile: int = tiles.TILE, cell: int = tiles.CELL) -> DataFrame:
    """``folder, src, dst, score, rank``: most similar frames of the same folder above the threshold, never a frame itself.

    Frames meet those that the triangle inequality leaves room for, tile by
    tile, with matrix products; a tile sends on at most ``neighbours`` rows for each frame, never its pairs.  ``sources``
    restricts whose neighbours are wanted.
    """
    if sources is not None:
        return _neighbours_of(frames, neighbours, threshold, sources)
    kind = dict(frames.dtypes)["frame_id"]

    def compare(a, x, b, y, same):
        s = x @ y.T if len(a) and len(b) else np.zeros((len(a), len(b)))
        one = tiles.best_of_rows(a, b, s, neighbours, threshold, same)
        if same:
            return one
        two = tiles.best_of_rows(b, a, s.T, neighbours, threshold, False)
        return [np.concatenate(c) for c in zip(one, two, strict=True)]

    pairs = tiles.near_pairs(frames, compare, f"src {kind}, dst {kind}, score double", threshold, tile, cell)
    order = Window.partitionBy("src").orderBy(F.desc("score"), "dst")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= neighbours)


def _neighbours_of(frames: DataFrame, neighbours: int, threshold: float, sources: Column) -> DataFrame:
    """The same rows for some sources: an equi-join on their folders alone."""
    unit = frames.where("v is not null").select("folder", "frame_id", V.l2_normalise("v").alias("v"))
    a, b = unit.where(sources).toDF("folder", "src", "va"), unit.toDF("folder_b", "dst", "vb")
    pairs = a.join(b, (F.col("folder") == F.col("folder_b")) & (F.col("src") != F.col("dst"))).select("folder", "src", "dst", V.dot("va", "vb").alias("score"))
    order = Window.partitionBy("src").orderBy(F.desc("score"), "dst")
    return pairs.where(F.col("score") > threshold).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= neighbours)


def similar_frames(frames: DataFrame, frame_id: int, limit: int = 10, threshold: float = 0.7) -> DataFrame:
    """The neighbours of one frame in its folder; no other frame's are computed."""
    return similarity_graph(frames, limit, threshold, sources=F.col("frame_id") == frame_id).orderBy("rank").limit(limit)


def lsh_topk(frames: DataFrame, query: list[float], k: int, *, bits: int = 64, candidates: int = 200, recall: float = 0.95, seed: int = 7) -> DataFrame:
    """``lsh_topk_batch`` for one vector: ``folder, frame_id, score, rank``."""
    one = frames.sparkSession.createDataFrame([(0, [float(x) for x in query])], "query_id long, v array<double>")
    return lsh_topk_batch(frames, one, k, bits=bits, candidates=candidates, recall=recall, seed=seed).drop("query_id")


def lsh_topk_batch(frames: DataFrame, queries: DataFrame, k: int, *, bits: int = 64, candidates: int = 200, recall: float = 0.95, seed: int = 7, query_block: int = 4096) -> DataFrame:
    """Approximate search by hyperplane codes: ``query_id, folder, frame_id, score, rank``.

    A first pass scores the ``candidates`` nearest codes of every batch; the
    kth score it finds is at most the true one, so its angle ``t`` is at least
    that of every true neighbour.  The Hamming distance of two vectors at the
    angle ``t`` is binomial (``bits``, t / pi), so the distance that holds
    ``recall`` of that law holds each true neighbour at least as likely, at
    any table size.  A second pass scores all codes within it exactly.
    Where no positive kth score bounds the angle, all rows are scored.
    """
    first = queries.where("v is not null").select("v").first()
    planes = np.random.default_rng(seed).standard_normal((bits, len(first["v"]) if first else 0))
    found = None
    for rows in _blocks(queries, query_block):
        ids, q = rows
        codes = _codes(q, planes)

        def nearest(m, _, codes=codes):
            apart = _hamming(codes, m, planes)
            if apart.shape[1] <= candidates:
                return np.ones(apart.shape, bool)
            return apart <= np.partition(apart, candidates - 1, axis=1)[:, candidates - 1 : candidates]

        bound = _ranked(_score_kept(frames, rows, k, nearest), k).where(F.col("rank") == k).select("query_id", "score").collect()
        kth = {r["query_id"]: r["score"] for r in bound}
        reach = np.array([_reach(kth.get(i, -1.0), bits, recall) for i in ids.tolist()])

        def within(m, _, codes=codes, reach=reach):
            return _hamming(codes, m, planes) <= reach[:, None]

        one = _score_kept(frames, rows, k, within)
        found = one if found is None else found.unionByName(one)
    return _ranked(found, k)


def _reach(score: float, bits: int, recall: float) -> int:
    """Least Hamming distance that holds ``recall`` of the codes at the angle of ``score``."""
    if score <= 0:
        return bits
    p, mass = math.acos(min(1.0, score)) / math.pi, 0.0
    for d in range(bits):
        mass += math.comb(bits, d) * p**d * (1 - p) ** (bits - d)
        if mass >= recall:
            return d
    return bits


def _codes(m: np.ndarray, planes: np.ndarray) -> np.ndarray:
    return np.packbits(m @ planes.T > 0, axis=1)


def _hamming(codes: np.ndarray, m: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """Distances of all codes to those of the rows of ``m``; zero vectors have no angle and are near all."""
    own = _codes(m, planes)
    apart = np.zeros((len(codes), len(own)), np.uint16)
    for byte in range(own.shape[1]):
        apart += np.bitwise_count(codes[:, byte, None] ^ own[None, :, byte])
    apart[:, ~m.any(axis=1)] = 0
    return apart


def _blocks(queries: DataFrame, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and unit vectors of the counted query set, dealt into blocks."""
    queries = queries.where("v is not null")
    blocks = max(1, -(-queries.count() // size))
    for b in range(blocks):
        part = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)
        rows = part.select("query_id", "v").toArrow()
        yield rows.column("query_id").to_numpy(), _unit(_matrix(rows.column("v").combine_chunks()))


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "frame_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _score_kept(frames: DataFrame, queries: tuple[np.ndarray, np.ndarray], k: int, kept, cell: str | None = None) -> DataFrame:
    """The k best of the rows that ``kept(unit vectors, cells)`` marks for each query, of every Arrow batch."""
    shared = frames.sparkSession.sparkContext.broadcast(queries)
    kinds = dict(frames.dtypes)

    def score(batches: Iterator[pa.RecordBatch]):
        ids, q = shared.value
        for batch in batches:
            if not batch.num_rows or not len(q):
                continue
            frame, m = batch.column(1).to_numpy(zero_copy_only=False), _unit(_matrix(batch.column(2)))
            rows, cols, scores = [], [], []
            marks = kept(m, batch.column(3).to_numpy() if cell else None)
            for at in range(0, len(q), QUERY_STEP):
                s = np.where(marks[at : at + QUERY_STEP], q[at : at + QUERY_STEP] @ m.T, -np.inf)
                # those as good as the kth, ties with them; the first k of each query in the order of score and id
                kth = np.partition(s, len(m) - k, axis=1)[:, len(m) - k, None] if len(m) > k else -np.inf
                i, c = np.nonzero((s >= kth) & marks[at : at + QUERY_STEP])
                order = np.lexsort((frame[c], -s[i, c], i))
                i, c = i[order], c[order]
                first = np.arange(len(i)) - np.searchsorted(i, np.arange(len(s)))[i] < k
                rows.append(i[first] + at)
                cols.append(c[first])
                scores.append(s[i[first], c[first]])
            rows, take = np.concatenate(rows), pa.array(np.concatenate(cols))
            yield pa.RecordBatch.from_arrays([pa.array(ids[rows]), batch.column(0).take(take), batch.column(1).take(take), pa.array(np.concatenate(scores))], names=["query_id", "folder", "frame_id", "score"])

    source = frames.select("folder", "frame_id", "v", *([cell] if cell else [])).where("v is not null")
    return source.mapInArrow(score, f"query_id long, folder {kinds['folder']}, frame_id {kinds['frame_id']}, score double")


def kmeans_cells(frames: DataFrame, cells: int | None = None, *, sample: int = 100_000, seed: int = 7):
    """Coarse cells: centres fitted on a bounded sample, and the frames with their ``cell``.

    ``cells`` defaults to the square root of the row count, at most 1000.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    n = frames.count()
    cells = cells or max(2, min(1000, int(n**0.5)))
    # the sample's order comes from one task; it is dealt out again, so that all cores fit
    some = tiles.least_hashed(frames, "frame_id", sample, n).repartition(frames.sparkSession.sparkContext.defaultParallelism)
    model = KMeans(k=cells, seed=seed, featuresCol="__f", predictionCol="cell").fit(some.select(array_to_vector(V.l2_normalise("v")).alias("__f")))
    coded = model.transform(frames.withColumn("__f", array_to_vector(V.l2_normalise("v")))).drop("__f")
    return [c.tolist() for c in model.clusterCenters()], stored(coded)  # read by every search: rows are assigned once


def fitted_probes(coded: DataFrame, centres: list[list[float]], k: int, *, recall: float = 0.95, sample: int = 200) -> int:
    """The least number of cells that hold ``recall`` of the true neighbours, measured on this table.

    A bounded sample of frames is searched exactly, in one pass; a frame is
    no neighbour of its own.  The number so grows with table and cells.
    """
    some = tiles.least_hashed(coded.where("v is not null"), "frame_id", sample, coded.count()).select(F.col("frame_id").alias("query_id"), "v").collect()
    queries = coded.sparkSession.createDataFrame([(r["query_id"], r["v"]) for r in some], "query_id long, v array<double>")
    true = topk_batch(coded.select(F.col("cell").alias("folder"), "frame_id", "v"), queries, k + 1).where("query_id <> frame_id").collect()
    place = {r["query_id"]: np.argsort(np.argsort(-(np.asarray(centres) @ np.asarray(r["v"])), kind="stable")) for r in some}
    at = np.sort([place[r["query_id"]][r["folder"]] for r in true])
    return int(at[math.ceil(recall * len(at)) - 1]) + 1 if len(at) else len(centres)


def cell_topk(coded: DataFrame, centres: list[list[float]], query: list[float], k: int, probes: int | None = None) -> DataFrame:
    """Exact scores within the cells whose centres are nearest, by one scan; ``stored_index`` has the form that prunes files.

    ``probes`` defaults to ``fitted_probes``; fit it once for many searches.
    """
    probes = probes or fitted_probes(coded, centres, k)
    order = np.argsort([-float(np.dot(c, query)) for c in centres])[:probes]
    return topk(coded.where(F.col("cell").isin(*map(int, order))), query, k)


def cell_topk_batch(coded: DataFrame, centres: list[list[float]], queries: DataFrame, k: int, probes: int | None = None, *, query_block: int = 4096) -> DataFrame:
    """``cell_topk`` of every query: ``query_id, folder, frame_id, score, rank``."""
    probes = probes or fitted_probes(coded, centres, k)
    found = None
    for rows in _blocks(queries, query_block):
        open_ = np.zeros((len(rows[0]), len(centres)), bool)
        if len(open_):
            np.put_along_axis(open_, np.argsort(-(rows[1] @ np.asarray(centres).T), axis=1, kind="stable")[:, :probes], True, axis=1)

        def probed(_, cell, open_=open_):
            return open_[:, cell]

        one = _score_kept(coded, rows, k, probed, "cell")
        found = one if found is None else found.unionByName(one)
    return _ranked(found, k)


@dataclass
class VectorIndex:
    """Frames under one search strategy, built once for many searches.

    ``exact_ip`` ranks by inner product of unit vectors, ``exact_l2`` by
    distance; ``lsh`` and ``kmeans_cells`` are stored indexes
    (``stored_index``), ``hnsw`` is a stored graph (``neighbour_graph``), whose
    measured recall is at least ``recall``.
    """

    frames: DataFrame
    strategy: str = "exact_ip"
    recall: float = 0.95
    cells: int | None = None

    def __post_init__(self):
        if self.strategy not in STRATEGIES:
            raise ValueError(f"strategy must be one of {STRATEGIES}")
        self.index = None

    def build(self) -> VectorIndex:
        """Checks ids and dimensions; fits and stores the index where the strategy has one."""
        seen = self.frames.agg(F.count("frame_id").alias("n"), F.count_if(F.col("v").isNull()).alias("missing"), F.min(F.size("v")).alias("low"), F.max(F.size("v")).alias("high")).first()
        if seen["n"] and seen["low"] != seen["high"] and seen["missing"] < seen["n"]:
            raise ValueError(f"vectors of {seen['low']} and of {seen['high']} dimensions")
        health.assert_unique(self.frames, "frame_id")
        if self.strategy in _STORED and self.index is None:
            from lumenframe.operators.neighbour_graph import NeighbourGraph
            from lumenframe.operators.stored_index import StoredIndex

            spark = self.frames.sparkSession
            path = shared_path(spark) + "-index"
            if self.strategy == "hnsw":
                self.index = NeighbourGraph.build(self.frames, path, cells=self.cells, recall=self.recall)
            else:
                self.index = StoredIndex.build(self.frames, path, _STORED[self.strategy], cells=self.cells, recall=self.recall)
            delete_at_exit(spark, path)
        return self

    def search(self, query: list[float], k: int) -> DataFrame:
        if self.strategy in _STORED:
            one = self.frames.sparkSession.createDataFrame([(0, [float(x) for x in query])], "query_id long, v array<double>")
            return self.build().index.search(one, k).drop("query_id")
        return topk(self.frames, query, k, metric="l2" if self.strategy == "exact_l2" else "ip")

    def search_batch(self, queries: DataFrame, k: int) -> DataFrame:
        if self.strategy in _STORED:
            return self.build().index.search(queries, k)
        return topk_batch(self.frames, queries, k)  # unit vectors: the nearest have the largest product


#: Strategies that store an index, and its kind.
_STORED = {"lsh": "lsh", "kmeans_cells": "ivf", "hnsw": "graph"}


def detail(results: DataFrame, level: str = "standard") -> DataFrame:
    """Rows of results as ``key, payload`` (JSON), with the context as ``near<i>.<j>`` from level standard on."""
    name = lambda c: F.concat(c.cast("string"), F.lit(".jpg"))
    base = [F.col("folder").alias("keyframe"), name(F.col("frame_id")).alias("name"), F.col("frame_id").alias("frameid"), F.round("score", 4).alias("similarity_score")]
    more = {
        "minimal": [],
        "standard": [F.col("rank"), F.col("explanation")],
        "rich": [F.col("rank"), F.col("explanation"), F.col("sequence_position"), F.col("total_frames")],
        "full": [F.col("rank"), F.col("explanation"), F.col("sequence_position"), F.col("total_frames"), (F.size("context") > 0).alias("has_temporal_context"), F.size("context").alias("temporal_context_count")],
    }[level]
    columns = results.columns
    for c in ("explanation", "sequence_position", "total_frames"):
        if c not in columns:
            results = results.withColumn(c, F.lit(None).cast("string"))
    rows = results.select(F.concat(F.lit("rank"), F.col("rank")).alias("key"), F.to_json(F.struct(*base, *more)).alias("payload"))
    if level == "minimal" or "context" not in columns:
        return rows
    near = results.select("folder", "rank", F.posexplode("context").alias("j", "near_id"))
    near = near.select(F.concat(F.lit("near"), F.col("rank"), F.lit("."), F.col("j") + 1).alias("key"), F.to_json(F.struct(F.col("folder").alias("keyframe"), name(F.col("near_id")).alias("name"), F.col("near_id").alias("frameid"))).alias("payload"))
    return rows.unionByName(near)


def metadata_detail(row: DataFrame, level: str = "standard") -> DataFrame:
    """Projection of keyframe rows by level; lists of related frames become counts at level rich."""
    size = lambda c: F.size(F.coalesce(F.col(c), F.array().cast("array<string>")))
    if level == "minimal":
        return row.select("folder_name", "image_name", "frame_id")
    standard = ["folder_name", "image_name", "frame_id", "file_path", "sequence_position", "total_frames", "confidence_score"]
    if level == "standard":
        return row.select(*standard)
    if level == "rich":
        return row.select(*standard, "neighboring_frames", "scene_boundaries", "scene_tags", "detected_objects", "llm_description", size("similar_frames").alias("similar_frames_count"), size("transition_frames").alias("transition_frames_count"))
    return row
