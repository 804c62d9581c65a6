"""Vector indexes on disk: an inverted file with product-quantised residuals, and hyperplane codes by prefix.

Both store two tables by cell, as Parquet partitions: ``codes`` (id and a few
bytes of each vector) and ``vectors`` (the same with the vectors themselves).  A search names the
cells of a query, so that only their partitions are listed and read; their
codes give approximate scores, and the vectors of the best of a cell lie beside their codes and are
scored exactly in the same task: only k rows of each query leave it.

* ``ivf``: cells are the nearest of some centres, a code is the residual to
  the centre, quantised part by part (``code_bytes`` parts of 256 codewords).
* ``lsh``: a code holds the sides of ``8 * code_bytes`` hyperplanes, a cell is
  its first bits.  Cells are probed in the order of what the query would have to be
  moved to get there; the Hamming distance stands for the angle.

Centres and codewords are fitted on a bounded sample (``sample`` rows), every
row is indexed.  How many cells are probed (``probes``) and how many rows of a cell are
scored exactly (``rerank``) is measured on the index itself: doubled until a
bounded set of stored rows finds ``recall`` of its true neighbours; at the
end of that road stand all cells and all rows, the exact search.

Defined cases: rows without a vector take no part; a zero vector has cosine 0
with any other; an empty table gives an empty index, which finds nothing; ids
must not repeat; with fewer than k rows in the probed cells fewer come back.
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

KINDS = ("ivf", "lsh")
#: Queries of a cell that are scored together.
TOGETHER = 512


class Residuals:
    """Coder of an inverted file: ``centres`` and, for each part of a vector, ``words`` of 256 codewords."""

    def __init__(self, centres: np.ndarray, words: np.ndarray):
        self.centres, self.words = centres, words  # cells x d, parts x 256 x width

    @classmethod
    def fit(cls, x: np.ndarray, cells: int, code_bytes: int, rng: np.random.Generator) -> Residuals:
        centres = lloyd(x, cells, 12, rng)
        rest = cls._parts(x - centres[nearest(x, centres)], code_bytes)
        words = [lloyd(part, 256, 8, rng) for part in rest.transpose(1, 0, 2)]
        return cls(centres, np.stack([np.concatenate([w, np.repeat(w[:1], 256 - len(w), axis=0)]) for w in words]))

    @staticmethod
    def _parts(x: np.ndarray, parts: int) -> np.ndarray:
        width = -(-x.shape[1] // parts)
        return np.pad(x, ((0, 0), (0, width * parts - x.shape[1]))).reshape(len(x), parts, width)

    @property
    def cells(self) -> int:
        return len(self.centres)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cell = nearest(x, self.centres)
        rest = self._parts(x - self.centres[cell], len(self.words))
        return cell, np.stack([nearest(rest[:, j], w) for j, w in enumerate(self.words)], axis=1).astype(np.uint8)

    def order(self, q: np.ndarray) -> np.ndarray:
        """Cells of every query, the best first."""
        return np.argsort(-(q @ self.centres.T), axis=1, kind="stable")

    def scores(self, q: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """Products of the queries with the centre, and with the codewords of the residuals."""
        table = np.einsum("qjw,jcw->qjc", self._parts(q, len(self.words)), self.words)
        out = np.repeat((q @ self.centres[cell])[:, None], len(codes), axis=1)
        for j in range(codes.shape[1]):
            out += table[:, j, codes[:, j]]
        return out

    def arrays(self) -> dict[str, np.ndarray]:
        return {"centres": self.centres, "words": self.words}


class Planes:
    """Coder by hyperplanes; the first ``prefix`` bits of a code are the cell."""

    def __init__(self, planes: np.ndarray, prefix: np.ndarray):
        self.planes, self.prefix = planes, int(prefix[0])

    @classmethod
    def fit(cls, x: np.ndarray, cells: int, code_bytes: int, rng: np.random.Generator) -> Planes:
        planes = np.linalg.qr(rng.standard_normal((x.shape[1], x.shape[1])))[0]
        more = rng.standard_normal((max(0, 8 * code_bytes - x.shape[1]), x.shape[1]))
        return cls(np.concatenate([planes, more])[: 8 * code_bytes], np.array([max(1, min(12, round(np.log2(cells)), 8 * code_bytes))]))

    @property
    def cells(self) -> int:
        return 1 << self.prefix

    def _cell(self, sides: np.ndarray) -> np.ndarray:
        return sides[:, : self.prefix] @ (1 << np.arange(self.prefix))

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sides = x @ self.planes.T > 0
        return self._cell(sides), np.packbits(sides, axis=1)

    def order(self, q: np.ndarray) -> np.ndarray:
        """Cells by the squared distances to the planes that lie between."""
        at = q @ self.planes[: self.prefix].T
        bits = (np.arange(self.cells)[:, None] >> np.arange(self.prefix)) & 1 == 1
        return np.argsort(np.stack([((bits != (line > 0)) * line * line).sum(axis=1) for line in at]), axis=1, kind="stable") if len(at) else np.zeros((0, self.cells), int)

    def scores(self, q: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        own = np.packbits(q @ self.planes.T > 0, axis=1)
        apart = np.zeros((len(q), len(codes)), np.int64)
        for j in range(codes.shape[1]):
            apart += np.bitwise_count(own[:, j, None] ^ codes[None, :, j])
        return np.cos(np.pi * apart / len(self.planes))

    def arrays(self) -> dict[str, np.ndarray]:
        return {"planes": self.planes, "prefix": np.array([self.prefix])}


CODERS = {"ivf": Residuals, "lsh": Planes}


@dataclass
class StoredIndex:
    """An index under ``path``, in any store that Spark reads."""

    spark: SparkSession
    path: str
    kind: str
    coder: Residuals | Planes | None
    probes: int
    rerank: int
    cells: list[int]  # those with rows

    @classmethod
    def build(
        cls, frames: DataFrame, path: str, kind: str = "ivf", *, cells: int | None = None, code_bytes: int = 16, sample: int = 20_000, recall: float = 0.95, k: int = 10, seed: int = 7
    ) -> StoredIndex:
        """Writes the index of ``folder, frame_id, v``; ``cells`` defaults to the square root of the rows, 4096 at most."""
        if kind not in KINDS:
            raise ValueError(f"kind must be one of {KINDS}")
        spark, rows = frames.sparkSession, frames.where("v is not null").select("folder", "frame_id", V.l2_normalise("v").alias("v"))
        health.assert_unique(rows, "frame_id")
        n = rows.count()
        if not n:
            index = cls(spark, path, kind, None, 1, 1, [])
            index._write_model(rows)
            return index
        some = np.array([r["v"] for r in least_hashed(rows, "frame_id", sample, n).select("v").collect()])  # the bounded sample
        rng = np.random.default_rng(seed)
        cells = max(1, min(cells or int(n**0.5), 4096, len(some)))
        coder = CODERS[kind].fit(some, cells, code_bytes, rng)
        shared = spark.sparkContext.broadcast(coder)

        def code(batches: Iterator[pa.RecordBatch]):
            for batch in batches:
                if batch.num_rows:
                    cell, codes = shared.value.encode(search._matrix(batch.column(2)))
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary())], names=["folder", "frame_id", "v", "cell", "code"])

        kinds = dict(rows.dtypes)
        coded = storage.stored(rows.mapInArrow(code, f"folder {kinds['folder']}, frame_id {kinds['frame_id']}, v array<double>, cell int, code binary"))
        # a cell is a few files: rebalancing splits cells that hold very many rows
        for table, columns in (("codes", ["folder", "frame_id", "code"]), ("vectors", ["folder", "frame_id", "v", "code"])):
            coded.select(*columns, "cell").hint("rebalance", "cell").sortWithinPartitions("cell", "frame_id").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/{table}")
        used = sorted(r["cell"] for r in coded.select("cell").distinct().collect())  # 4096 at most
        index = cls(spark, path, kind, coder, 1, 4 * k, used)
        index._fit(rows, n, k, recall)
        index._write_model(rows)
        return index

    def _write_model(self, rows: DataFrame) -> None:
        meta = {"kind": self.kind, "probes": self.probes, "rerank": self.rerank, "cells": self.cells, "types": {c: t for c, t in rows.dtypes if c != "v"}}
        arrays = [] if self.coder is None else [(name, list(a.shape), str(a.dtype), bytearray(np.ascontiguousarray(a).tobytes())) for name, a in self.coder.arrays().items()]
        self.spark.createDataFrame([*arrays, ("meta", [], json.dumps(meta), bytearray())], "name string, shape array<int>, kind string, data binary").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/model")

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> StoredIndex:
        rows = {r["name"]: r for r in spark.read.parquet(f"{path}/model").collect()}
        meta = json.loads(rows.pop("meta")["kind"])
        arrays = {name: np.frombuffer(bytes(r["data"]), r["kind"]).reshape(r["shape"]) for name, r in rows.items()}
        coder = CODERS[meta["kind"]](**arrays) if arrays else None
        return cls(spark, path, meta["kind"], coder, meta["probes"], meta["rerank"], meta["cells"])

    def _fit(self, rows: DataFrame, n: int, k: int, recall: float, sample: int = 200) -> None:
        """Doubles cells, then rows, until the sample's searches find ``recall`` of what the exact search does."""
        asked = least_hashed(rows, "frame_id", sample, n).select(F.col("frame_id").alias("query_id"), "v").collect()
        queries = self.spark.createDataFrame([(r["query_id"], r["v"]) for r in asked], "query_id long, v array<double>")
        true = {(r["query_id"], r["frame_id"]) for r in search.topk_batch(rows, queries, k).select("query_id", "frame_id").collect()}
        if not true:
            return
        x = np.array([r["v"] for r in asked])
        at = {r["query_id"]: i for i, r in enumerate(asked)}
        # cells: the place of each neighbour's cell in its query's order, which codes don't enter
        where = {r["frame_id"]: r["cell"] for r in self._table("codes", self.cells).where(F.col("frame_id").isin([f for _, f in true])).select("frame_id", "cell").collect()}
        used = np.zeros(self.coder.cells, bool)
        used[self.cells] = True
        places = []
        order = [[int(c) for c in line if used[c]] for line in self.coder.order(x)]
        for q, f in true:
            places.append(order[at[q]].index(where[f]))
        # half of what may be missed is left to the cells, half to the codes
        allowed = (1 + recall) / 2
        self.probes = int(np.sort(places)[max(0, int(np.ceil(allowed * len(places))) - 1)]) + 1
        self.rerank = 2 * k
        while self.rerank < n:
            found = {(r["query_id"], r["frame_id"]) for r in self.search(queries, k).select("query_id", "frame_id").collect()}
            if len(found & true) >= recall * len(true):
                return
            self.rerank *= 2
        self.rerank = n

    def _table(self, name: str, cells: list[int]) -> DataFrame:
        """One of the tables, cut to partitions; only their files are listed as inputs."""
        return self.spark.read.parquet(f"{self.path}/{name}").where(F.col("cell").isin([int(c) for c in cells]))

    def search(self, queries: DataFrame, k: int, *, probes: int | None = None, rerank: int | None = None, query_block: int = 4096) -> DataFrame:
        """``query_id, folder, frame_id, score, rank`` for ``query_id, v``: exact cosines of the rows whose codes are best in their cell."""
        probes, rerank = probes or self.probes, max(k, rerank or self.rerank)
        found = None
        for ids, q in search._blocks(queries, query_block) if self.cells else ():
            if not len(ids):
                continue
            one = self._search_block(ids, q, k, probes, rerank)
            found = one if found is None else found.unionByName(one)
        if found is None:
            types = {c: "long" for c in ("folder", "frame_id")} | self._types()
            return self.spark.createDataFrame([], f"query_id long, folder {types['folder']}, frame_id {types['frame_id']}, score double, rank int")
        return search._ranked(found, k)

    def _types(self) -> dict[str, str]:
        rows = self.spark.read.parquet(f"{self.path}/model").where("name = 'meta'").collect()
        return json.loads(rows[0]["kind"])["types"]

    def _search_block(self, ids: np.ndarray, q: np.ndarray, k: int, probes: int, rerank: int) -> DataFrame:
        used = np.zeros(self.coder.cells, bool)
        used[self.cells] = True
        asks: dict[int, list[int]] = {}
        for i, line in enumerate(self.coder.order(q)):
            for c in line[used[line]][:probes]:
                asks.setdefault(int(c), []).append(i)
        shared = self.spark.sparkContext.broadcast((self.coder, q, ids, {c: np.array(v) for c, v in asks.items()}))
        rows = self._table("vectors", list(asks)).select("folder", "frame_id", "v", "code", "cell")

        def best(batches: Iterator[pa.RecordBatch]):
            coder, q, ids, asks = shared.value
            for batch in batches:
                cell, frame = batch.column(4).to_numpy(), batch.column(1).to_numpy()
                packed = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(batch.num_rows, -1) if batch.num_rows else None
                v = search._matrix(batch.column(2))
                for c in np.unique(cell):
                    rows = np.flatnonzero(cell == c)
                    for at in range(0, len(asks[int(c)]), TOGETHER):
                        who = asks[int(c)][at : at + TOGETHER]
                        some, score = _scored(coder, q[who], int(c), packed[rows], v[rows], frame[rows], rerank, k)
                        take = pa.array(rows[some].ravel())
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.repeat(ids[who], some.shape[1])), batch.column(0).take(take), batch.column(1).take(take), pa.array(score.ravel())], names=["query_id", "folder", "frame_id", "score"]
                        )

        kinds = dict(rows.dtypes)
        return rows.mapInArrow(best, f"query_id long, folder {kinds['folder']}, frame_id {kinds['frame_id']}, score double")


def _scored(coder: Residuals | Planes, q: np.ndarray, cell: int, codes: np.ndarray, v: np.ndarray, frame: np.ndarray, rerank: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and cosines of the k best of a cell's rows for each query: of those whose ``rerank`` codes are best, by exact products."""
    if len(codes) > rerank:
        s = coder.scores(q, cell, codes)
        keep = np.sort(np.argpartition(s, len(codes) - rerank, axis=1)[:, len(codes) - rerank :], axis=1)
    else:  # all are scored exactly
        keep = np.broadcast_to(np.arange(len(codes)), (len(q), len(codes)))
    exact = np.empty(keep.shape)
    step = max(1, 1_000_000 // (keep.shape[1] * v.shape[1]))  # queries whose kept vectors are gathered at once
    for a in range(0, len(q), step):
        exact[a : a + step] = np.einsum("qd,qrd->qr", q[a : a + step], v[keep[a : a + step]])
    first = np.lexsort((frame[keep], -exact), axis=1)[:, :k]
    return np.take_along_axis(keep, first, axis=1), np.take_along_axis(exact, first, axis=1)
