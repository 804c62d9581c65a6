"""A neighbour graph as a vector index: shards of bounded size, each with a graph of its own, walked best-first.

Rows go to the nearest of some centres; a centre's rows are one shard, or are
dealt into several of about ``SHARD`` rows.  Within a shard a row lists its
nearest others and a few rows drawn at random, ``degree`` in all: the near ones lead to
neighbours, the far ones from any part of the shard to any other.  A shard is a task, so
what a task holds is bounded and one shuffle builds the graph.

The graph is stored by shard (``cell``), a row with its vector and the ids
that it lists.  A search broadcasts a block of queries; each shard that a
query probes is walked from rows spread over it: the best rows met so far
(``width`` of them) are opened until all have been, and the k best of every
shard are ranked.  It is one job, whatever the number of steps.

How many shards are probed (``probes``) and ``width`` are measured on the index: ``width`` is doubled until a bounded set of
stored rows finds ``recall`` of its true neighbours.  Where that takes a width of all rows,
``exact`` is set and searches are answered by ``search.topk_batch``.

``descend`` (NN-descent) makes the lists of a whole table, which no shard bounds: neighbours of
neighbours meet, every row brings together its own list and the rows that list it, ``degree`` of each at
most, and of every meeting a row keeps the best.  It ends when a round changes
few lists.  Only bounded lists are ever gathered: hot rows, which many others
list, are cut to their best in salted parts first.

Defined cases: rows without a vector take no part; ids must not repeat; an
empty table gives an empty index; of rows of equal vectors those of the least ids are listed; a
shard of no more rows than ``degree`` is a complete graph.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenframe import storage
from lumenframe.functions import vectors as V
from lumenframe.operators import health, search
from lumenframe.operators.tiles import least_hashed, lloyd, nearest

#: Rows of a first group at most; salted parts of a hot row's list.
GROUP, SALTS = 512, 32
#: Rows of a shard, about; random rows in a list; rows from which a walk begins; queries that are walked together.
SHARD, FAR, STARTS, TOGETHER = 16_384, 4, 256, 512


def best_of(rows: DataFrame, key: str, n: int, *order) -> DataFrame:
    """The first ``n`` rows of every key, of salted parts first: no task sorts all rows of a hot key."""
    salt = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(SALTS))
    some = rows.withColumn("__salt", salt).withColumn("__place", F.row_number().over(Window.partitionBy(key, "__salt").orderBy(*order))).where(F.col("__place") <= n)
    return some.withColumn("__place", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("__place") <= n).drop("__salt", "__place")


def meetings(members: DataFrame, n: int) -> DataFrame:
    """``id, near, score``: the ``n`` best others of every row in each of its groups ``g``; ``members`` is ``g, id, v``."""

    def groups(batches: Iterator[pa.RecordBatch]):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            g = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(g[1:] != g[:-1]) + 1).tolist(), len(g)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                part = batch.slice(a, b - a)
                if held and held[-1].column(0)[0] != part.column(0)[0]:
                    yield held
                    held = []
                held.append(part)
        if held:
            yield held

    def run(batches):
        out: tuple[list, list, list] = ([], [], [])
        for parts in groups(batches):
            ids = np.concatenate([p.column(1).to_numpy() for p in parts])
            x = np.concatenate([search._matrix(p.column(2)) for p in parts])
            if len(ids) < 2:
                continue
            s = x @ x.T
            np.fill_diagonal(s, -np.inf)
            k = min(n, len(ids) - 1)
            at = np.argpartition(-s, k - 1, axis=1)[:, :k]
            for held, values in zip(out, (np.repeat(ids, k), ids[at].ravel(), np.take_along_axis(s, at, axis=1).ravel()), strict=True):
                held.append(values)
            if len(out[0]) >= 256:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], names=["id", "near", "score"])
                out = ([], [], [])
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], names=["id", "near", "score"])

    return members.select("g", "id", "v").repartition("g").sortWithinPartitions("g").mapInArrow(run, "id long, near long, score double")


def _lists(pairs: DataFrame, degree: int) -> DataFrame:
    one = pairs.groupBy("id", "near").agg(F.max("score").alias("score"))
    return best_of(one, "id", degree, F.desc("score"), "near")


def descend(rows: DataFrame, homes: DataFrame, degree: int, rounds: int = 6, settled: float = 0.01) -> DataFrame:
    """``id, near, score``: lists of ``degree`` neighbours for ``rows`` of ``id, v``; ``homes`` are the first groups ``g, id, v``."""
    sizes = homes.groupBy(F.col("g").alias("of")).agg(F.ceil(F.count("*") / F.lit(GROUP)).cast("long").alias("parts"))
    first = homes.join(sizes, F.col("g") == F.col("of")).withColumn("g", F.xxhash64("g", F.pmod(F.xxhash64("id", F.lit(3)), "parts")))
    lists = storage.stored(_lists(meetings(first, degree), degree))
    size = lists.count()
    for _ in range(rounds):
        listed = lists.select(F.col("near").alias("g"), F.col("id").alias("m"), "score")
        back = best_of(listed, "g", degree, F.desc("score"), "m").select("g", "m")
        members = lists.select(F.col("id").alias("g"), F.col("near").alias("m")).union(back).union(rows.select(F.col("id").alias("g"), F.col("id").alias("m"))).distinct()
        met = members.join(rows.withColumnRenamed("id", "rid"), F.col("m") == F.col("rid")).select("g", F.col("m").alias("id"), "v")
        new = storage.stored(_lists(lists.union(meetings(met, degree)), degree))
        gone = lists.join(new.select(F.col("id").alias("i"), F.col("near").alias("n")), (F.col("id") == F.col("i")) & (F.col("near") == F.col("n")), "left_anti").count()
        lists = new
        if gone <= settled * size:
            break
    return lists


def _keys(scores: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Scores to six digits, less a bit for the place: rows of equal vectors come in the order of their ids."""
    return np.rint(scores.astype(float) * 1e6) - 1e-5 * places


def shard_lists(x: np.ndarray, degree: int, rng: np.random.Generator) -> np.ndarray:
    """Places that each row of a shard lists: its nearest others and ``FAR`` random ones; -1 where there are no more."""
    n = len(x)
    if n <= degree:
        return np.array([[j for j in range(n) if j != i] + [-1] * (degree - n + 1) for i in range(n)], np.int32).reshape(n, degree)
    k = max(1, degree - FAR)
    out = rng.integers(n, size=(n, degree)).astype(np.int32)
    for a in range(0, n, 256):
        s = _keys(x[a : a + 256] @ x.T, np.arange(n))
        s[np.arange(len(s)), np.arange(a, a + len(s))] = -np.inf
        out[a : a + 256, :k] = np.argpartition(s, n - k, axis=1)[:, n - k :]
    return out


def walk(q: np.ndarray, x: np.ndarray, lists: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and keys of the ``width`` best rows met for each query, ``len(x)`` and -inf where fewer were met.

    Every round opens the best rows of a query that weren't yet, a sixteenth
    of ``width`` at a time, and scores what they list and the query hasn't met.
    """
    n, at = len(x), np.unique(np.linspace(0, len(x) - 1, min(len(x), STARTS)).astype(int))
    met = np.zeros((len(q), n + 1), bool)
    met[:, at] = met[:, n] = True
    keys, rows = _keys(q @ x[at].T, at), np.broadcast_to(at, (len(q), len(at)))
    opened, left = np.zeros(rows.shape, bool), np.arange(len(q))
    best, score = np.full((len(q), width), n), np.full((len(q), width), -np.inf)
    while len(left):
        if keys.shape[1] > width:
            keep = np.argpartition(keys, -width, axis=1)[:, -width:]
            keys, rows, opened = (np.take_along_axis(c, keep, axis=1) for c in (keys, rows, opened))
        over = opened.all(axis=1)
        best[left[over], : rows.shape[1]], score[left[over], : rows.shape[1]] = rows[over], keys[over]
        left, keys, rows, opened = left[~over], keys[~over], rows[~over], opened[~over]
        if not len(left):
            break
        step = min(max(4, width // 16), rows.shape[1])
        pick = np.argpartition(np.where(opened, -np.inf, keys), -step, axis=1)[:, -step:]
        told = np.where(np.take_along_axis(opened, pick, axis=1)[:, :, None], n, lists[np.take_along_axis(rows, pick, axis=1)]).reshape(len(left), -1)
        np.put_along_axis(opened, pick, True, axis=1)
        new = ~met[left[:, None], told]
        i, j = np.divmod(np.unique(np.nonzero(new)[0] * (n + 1) + told[new]), n + 1)
        met[left[i], j] = True
        place = np.arange(len(i)) - np.searchsorted(i, np.arange(len(left)))[i]  # among the new rows of its query
        more = int(place.max()) + 1 if len(place) else 0
        key, row = np.full((len(left), more), -np.inf), np.zeros((len(left), more), int)
        key[i, place], row[i, place] = _keys(np.einsum("ij,ij->i", q[left[i]], x[j]), j), j
        keys, rows, opened = np.concatenate([keys, key], axis=1), np.concatenate([rows, row], axis=1), np.concatenate([opened, np.isneginf(key)], axis=1)
    return best, score


@dataclass
class NeighbourGraph:
    """A graph index under ``path``."""

    spark: SparkSession
    path: str
    centres: np.ndarray  # shards x d
    probes: int
    width: int
    exact: bool
    types: dict[str, str]

    @classmethod
    def build(cls, frames: DataFrame, path: str, *, degree: int = 16, cells: int | None = None, sample: int = 20_000, recall: float = 0.95, k: int = 10, seed: int = 7) -> NeighbourGraph:
        """Writes the index of ``folder, frame_id, v``; ``cells`` defaults to what gives shards of ``SHARD`` rows, 1024 at most."""
        spark = frames.sparkSession
        rows = frames.where("v is not null").select("folder", F.col("frame_id").cast("long").alias("frame_id"), V.l2_normalise("v").alias("v"))
        health.assert_unique(rows, "frame_id")
        types = {c: t for c, t in frames.dtypes if c in ("folder", "frame_id")}
        n = rows.count()
        if not n:
            index = cls(spark, path, np.zeros((0, 0)), 1, 1, True, types)
            rows.withColumn("near", F.expr("cast(array() as array<bigint>)")).withColumn("cell", F.lit(0)).write.mode("overwrite").parquet(f"{path}/rows")
            index._write()
            return index
        some = np.array([r["v"] for r in least_hashed(rows, "frame_id", sample, n).select("v").collect()])
        centres = lloyd(some, max(1, min(cells or -(-n // SHARD), 1024)), 10, np.random.default_rng(seed))
        placed = storage.stored(_placed(rows, spark.sparkContext.broadcast(centres)))
        sizes = {r["cell"]: -(-r["n"] // SHARD) for r in placed.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # one for each centre
        parts = np.array([sizes.get(c, 0) for c in range(len(centres))])
        first = np.cumsum(parts) - parts
        of = lambda values: F.get(F.array(*[F.lit(int(x)) for x in values]), F.col("cell"))
        shard = (of(first) + F.pmod(F.xxhash64("frame_id"), of(np.maximum(parts, 1)))).cast("int")

        def link(key, table):
            table = table.sort_by("frame_id")
            ids = table.column("frame_id").to_numpy()
            lists = shard_lists(search._matrix(table.column("v").combine_chunks()).astype(np.float32), degree, np.random.default_rng([seed, key[0].as_py()]))
            listed = lists >= 0
            ends = np.concatenate([[0], np.cumsum(listed.sum(axis=1))]).astype(np.int32)
            return table.select(["folder", "frame_id", "v"]).append_column("near", pa.ListArray.from_arrays(ends, ids[lists[listed]])).append_column("cell", table.column("cell"))

        linked = placed.withColumn("cell", shard).groupBy("cell").applyInArrow(link, f"folder {types['folder']}, frame_id long, v array<double>, near array<long>, cell int")
        linked.write.mode("overwrite").partitionBy("cell").parquet(f"{path}/rows")
        index = cls(spark, path, np.repeat(centres, parts, axis=0), int(parts.sum()), 4 * k, False, types)
        index._fit(rows, n, k, recall)
        index._write()
        return index

    def _write(self) -> None:
        meta = {"probes": self.probes, "width": self.width, "exact": self.exact, "types": self.types, "shape": list(self.centres.shape)}
        self.spark.createDataFrame([(json.dumps(meta), bytearray(np.ascontiguousarray(self.centres, float).tobytes()))], "meta string, centres binary").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/model")

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> NeighbourGraph:
        r = spark.read.parquet(f"{path}/model").first()
        meta = json.loads(r["meta"])
        centres = np.frombuffer(bytes(r["centres"])).reshape(meta["shape"])
        return cls(spark, path, centres, meta["probes"], meta["width"], meta["exact"], meta["types"])

    def _order(self, q: np.ndarray) -> np.ndarray:
        """Shards of every query, the nearest first."""
        return np.argsort((self.centres * self.centres).sum(axis=1) / 2 - q @ self.centres.T, axis=1, kind="stable")

    def _fit(self, rows: DataFrame, n: int, k: int, recall: float, sample: int = 100) -> None:
        asked = [(r["frame_id"], r["v"]) for r in least_hashed(rows, "frame_id", sample, n).select("frame_id", "v").collect()]
        queries = self.spark.createDataFrame(asked, "query_id long, v array<double>")
        pairs = lambda found: {(r["query_id"], r["frame_id"]) for r in found.select("query_id", "frame_id").collect()}
        true = pairs(search.topk_batch(rows, queries, k))
        # half of what may be missed is left to the shards, half to the walks
        place = {i: np.argsort(line) for (i, _), line in zip(asked, self._order(np.array([v for _, v in asked])), strict=True)}
        where = {r["frame_id"]: r["cell"] for r in self.rows().where(F.col("frame_id").isin([f for _, f in true])).select("frame_id", "cell").collect()}
        places = np.sort([place[q][where[f]] for q, f in true])
        self.probes = int(places[max(0, int(np.ceil((1 + recall) / 2 * len(places))) - 1)]) + 1
        if recall >= 1:  # what a sample finds in few shards is no reason to leave out others
            self.probes = len(self.centres)
        while self.width < n:
            if len(pairs(self.search(queries, k)) & true) >= recall * len(true):
                return
            self.width *= 2
        self.exact = True  # no smaller part of the table holds the neighbours: the exact search answers

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows")

    def search(self, queries: DataFrame, k: int, *, width: int | None = None, probes: int | None = None, query_block: int = 4096) -> DataFrame:
        """``query_id, folder, frame_id, score, rank`` for ``query_id, v``."""
        if self.exact:
            found = search.topk_batch(self.rows(), queries, k)
        else:
            found = None
            for ids, q in search._blocks(queries, query_block):
                one = self._walked(ids, q, k, max(k, width or self.width), probes or self.probes) if len(ids) else None
                found = one if found is None else found if one is None else found.unionByName(one)
            if found is None:
                found = self.rows().limit(0).select(F.lit(0).cast("long").alias("query_id"), "folder", "frame_id", F.lit(0.0).alias("score"))
            found = search._ranked(found, k)
        return found.select("query_id", F.col("folder").cast(self.types["folder"]).alias("folder"), F.col("frame_id").cast(self.types["frame_id"]).alias("frame_id"), "score", "rank")

    def _walked(self, ids: np.ndarray, q: np.ndarray, k: int, width: int, probes: int) -> DataFrame:
        """The k best of every probed shard for a block of queries; a shard is one task."""
        probed = np.zeros((len(q), len(self.centres)), bool)
        np.put_along_axis(probed, self._order(q)[:, :probes], True, axis=1)
        shared = self.spark.sparkContext.broadcast((ids, q, probed))

        def best(key, table):
            ids, q, probed = shared.value
            table = table.sort_by("frame_id")
            frame, v = table.column("frame_id").to_numpy(), search._matrix(table.column("v").combine_chunks())
            near = table.column("near").combine_chunks()
            n, x = len(frame), v.astype(np.float32)
            length = np.diff(near.offsets.to_numpy())
            lists = np.full((n, max(1, int(length.max()))), n)
            lists[np.arange(lists.shape[1])[None] < length[:, None]] = np.searchsorted(frame, near.flatten().to_numpy(zero_copy_only=False))
            out: tuple[list, list, list] = ([], [], [])
            who = np.flatnonzero(probed[:, key[0].as_py()])
            for at in range(0, len(who), TOGETHER):
                some = who[at : at + TOGETHER]
                place, keys = walk(q[some].astype(np.float32), x, lists, width)
                # the margin covers rounding: scores of the first few are exact, and decide
                first = np.argsort(-keys, axis=1, kind="stable")[:, : 2 * k + 16]
                i, c = np.nonzero(np.take_along_axis(keys, first, axis=1) > -np.inf)
                row = place[i, first[i, c]]
                score = np.einsum("ij,ij->i", q[some[i]], v[row])
                order = np.lexsort((row, -score, i))
                i, row, score = i[order], row[order], score[order]
                keep = np.arange(len(i)) - np.searchsorted(i, np.arange(len(some)))[i] < k
                for held, values in zip(out, (ids[some[i[keep]]], row[keep], score[keep]), strict=True):
                    held.append(values)
            i, row, score = (np.concatenate(c) if c else np.zeros(0, int) for c in out)
            take = pa.array(row.astype(np.int64))
            return pa.table({"query_id": pa.array(i.astype(np.int64)), "folder": table.column("folder").take(take), "frame_id": table.column("frame_id").take(take), "score": pa.array(score.astype(float))})

        used = np.flatnonzero(probed.any(axis=0)).tolist()
        rows = self.rows().where(F.col("cell").isin(used))
        return rows.groupBy("cell").applyInArrow(best, f"query_id long, folder {dict(rows.dtypes)['folder']}, frame_id long, score double")


def _placed(rows: DataFrame, shared) -> DataFrame:
    """Rows with their nearest centre."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nearest(search._matrix(batch.column(2)), shared.value).astype(np.int32))], names=["folder", "frame_id", "v", "cell"])

    return rows.mapInArrow(run, f"folder {dict(rows.dtypes)['folder']}, frame_id long, v array<double>, cell int")
