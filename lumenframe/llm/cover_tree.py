"""Exact top-k by inner product: dual-tree search over cover trees.

A cover tree's node covers its points within a radius around its centre, its
children cover them with radii that shrink by ``BASE``.  A pair of nodes
bounds the inner product of any query and candidate below it by
``q.c + |q| r_c + |c| r_q + r_q r_c``; pairs whose bound is below the worst
kth score of the query node are pruned.

The upper part of both trees is one coarse tree over a bounded sample of
``sample`` rows.  Every row goes to the leaf with the nearest centre, and the
leaves' true radii are taken over all rows.  The kth score of a query among
the sample's rows is a floor of its kth score, and so is the least product
that its leaf and a leaf of more than k rows allow.  Leaves of queries and leaves of
candidates are pruned pair by pair, what is left is dealt into blocks in the
order of the tree (small leaves share a block, large ones are split), and a
row is sent only to the blocks that its leaf reaches: on clustered data a few,
whatever the table's size.  A pair of blocks is one task's cell of bounded
size.  There both sides are indexed by cover trees of their own, the best
bounded pairs go first, and leaves are scored directly.  The best k of every
cell meet in one window per query.

Components are ``floor(scale * x)``, so scores are integers; a bound is
loosened by a rounding margin, and ties at the kth score are kept until the
smaller id wins.

Defined cases: null vectors and those with null or non-finite components or no
component take no part, nor do rows of null id, which can't be told from a
query's own; a row never matches a row of its own id; vectors of different
length are not compared; with fewer than k candidates all are returned;
repeated candidate rows count each; repeated query rows of equal id and vector
are answered once; an empty table gives no rows; scores beyond 2^53 are
computed in Python integers; those beyond a long are an error.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import _util

BASE, LEAF, SMALL = 1.5, 64, 16
#: Of the coarse tree: points in a leaf, and leaves it may have.
COARSE, LEAVES = 8, 1024


class Node:
    __slots__ = ("centre", "children", "norm", "points", "radius", "worst")

    def __init__(self, centre, radius, points, children):
        self.centre, self.radius, self.points, self.children = centre, radius, points, children
        self.norm = float(np.sqrt(centre @ centre))
        self.worst = -np.inf


def build(x: np.ndarray, points: np.ndarray | None = None, depth: int = 0, leaf: int = LEAF, few: int = SMALL) -> Node:
    """Cover tree of the rows ``points`` of ``x``; equal points share a leaf.

    Nodes of up to ``leaf`` points are leaves; of children with fewer than
    ``few`` points one leaf is made.
    """
    if points is None:
        points = np.arange(len(x))
    centre = x[points[0]]
    own = x[points]
    away = np.sqrt(np.maximum(((own - centre) ** 2).sum(axis=1), 0))
    cover = float(away.max())
    if len(points) <= leaf or cover == 0.0 or depth > 60:
        return Node(centre, cover, points, [])
    limit = cover / BASE
    left, children, small = np.arange(len(points)), [], []
    square = (own * own).sum(axis=1)
    while len(left):
        # the next centre is the first point that no child covers; it takes all points within the limit.
        # distances of the next 256 possible centres come from one matrix product
        head = left[:256]
        apart = square[head][:, None] + square[left][None, :] - 2.0 * (own[head] @ own[left].T)
        free = np.ones(len(left), bool)
        for r in range(len(head)):
            if free[r]:
                near = free & (apart[r] <= limit * limit)
                near[r] = True
                free[near] = False
                group = points[left[near]]
                (small if len(group) < few else children).append(group)
        left = left[free]
    nodes = [build(x, g, depth + 1, leaf, few) for g in children]
    if small:  # points that cover few others make one leaf around this centre
        lone = np.concatenate(small)
        nodes.append(Node(centre, float(np.sqrt(((x[lone] - centre) ** 2).sum(axis=1)).max()), lone, []))
    return Node(centre, cover, points, nodes)


#: Whole float64 values as Python integers, which products and sums of objects keep exact.
_whole = np.frompyfunc(int, 1, 1)


def pair_bound(dot, q_norm, q_radius, c_norm, c_radius):
    """No inner product of a point below one node and a point below the other is larger."""
    top = dot + q_norm * c_radius + c_norm * q_radius + q_radius * c_radius
    # the second margin covers large products that cancel
    return top + 1e-9 * (1.0 + abs(top)) + 1e-12 * (q_norm + q_radius) * (c_norm + c_radius)


def search(queries: np.ndarray, query_ids: np.ndarray, cands: np.ndarray, cand_ids: np.ndarray, k: int, floor: np.ndarray | None = None):
    """``(query row, candidate row, score)`` of the k best of every query, ties to the smaller id.

    ``floor``: scores below it need not be found.
    """
    if not len(queries) or not len(cands):
        return []
    exact = queries.shape[1] * max(1.0, np.abs(queries).max()) * max(1.0, np.abs(cands).max()) < 2**53
    best: list[list[tuple]] = [[] for _ in queries]  # heaps of (score, -id, row)
    worst = np.full(len(queries), -np.inf) if floor is None else floor.astype(float)
    tick = 0

    def bound(q: Node, c: Node) -> float:
        return pair_bound(float(q.centre @ c.centre), q.norm, q.radius, c.norm, c.radius)

    def score(q: Node, c: Node) -> None:
        for at in range(0, len(c.points), 4096):
            block = c.points[at : at + 4096]
            if exact:
                s = queries[q.points] @ cands[block].T
            else:
                s = _whole(queries[q.points]) @ _whole(cands[block]).T
            hit = np.asarray(s >= worst[q.points][:, None], bool)
            for i in np.flatnonzero(hit.any(axis=1)):
                row, line = q.points[i], s[i]
                ok = np.flatnonzero(hit[i] & (cand_ids[block] != query_ids[row]))
                if len(ok) > 4 * k:  # only those at or above the kth can matter
                    kth = sorted(line[ok])[-k] if not exact else np.partition(line[ok], len(ok) - k)[len(ok) - k]
                    ok = ok[line[ok] >= kth]
                    if len(ok) > k:
                        ids = cand_ids[block]
                        ok = ok[np.lexsort((ids[ok], -line[ok]))[:k]] if exact else np.array(sorted(ok.tolist(), key=lambda j: (-line[j], ids[j]))[:k])
                heap = best[row]
                for j in ok.tolist():
                    item = (int(line[j]), -int(cand_ids[block[j]]), int(block[j]))
                    if len(heap) < k:
                        heapq.heappush(heap, item)
                    elif item[:2] > heap[0][:2]:
                        heapq.heapreplace(heap, item)
                if len(heap) == k:
                    # a rounded score may lie above the exact one
                    worst[row] = max(worst[row], heap[0][0] if exact else np.nextafter(float(heap[0][0]), -np.inf))
        q.worst = float(worst[q.points].min())

    qt, ct = build(queries), build(cands)
    queue = [(-bound(qt, ct), 0, qt, ct)]
    while queue:
        top, _, q, c = heapq.heappop(queue)
        if -top < (q.worst if q.worst > -np.inf else float(worst[q.points].min())):
            continue
        if not q.children and not c.children:
            score(q, c)
            continue
        pairs = [(x, c) for x in q.children] if q.children and (not c.children or q.radius >= c.radius) else [(q, y) for y in c.children]
        for x, y in pairs:
            b = bound(x, y)
            if b >= float(worst[x.points].min()):
                tick += 1
                heapq.heappush(queue, (-b, tick, x, y))
    return [(row, item[2], item[0]) for row, heap in enumerate(best) for item in sorted(heap, reverse=True)]


def integers(embedding: Column, scale: int) -> Column:
    """``floor(scale * x)`` of each component as double; null where one is null or not finite."""
    x = F.transform(embedding, lambda v: F.floor(F.lit(float(scale)) * v.cast("double")).cast("double"))
    bad = F.exists(embedding, lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("double")) == F.lit(float("inf"))))
    return F.when(~bad, x)


def leaves(node: Node) -> Iterator[Node]:
    """In tree order."""
    if not node.children:
        yield node
    for child in node.children:
        yield from leaves(child)


class Coarse:
    """The shared upper part of the trees: leaves of a cover tree over the sample, for each vector length."""

    def __init__(self, ids: list[int], vectors: list[list[float]], k: int):
        self.k, self.first, self.centres, self.sample = k, {}, {}, {}
        by_length = defaultdict(list)
        for i, x in zip(ids, vectors, strict=True):
            by_length[len(x)].append((i, x))
        self.other = 0  # the leaf of all lengths that the sample lacks; it is never pruned
        for d, rows in sorted(by_length.items()):
            x = np.array([r[1] for r in rows])
            few = max(2, -(-len(rows) // (LEAVES // 2)))
            centres = np.array([n.centre for n in leaves(build(x, leaf=max(COARSE, few), few=few))][:LEAVES])
            self.first[d], self.centres[d] = self.other, centres
            self.sample[d] = np.array([r[0] for r in rows]), x
            self.other += len(centres)

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leaf and distance to its centre of every row."""
        d = x.shape[1]
        if d not in self.first:
            return np.full(len(x), self.other), np.zeros(len(x))
        c = self.centres[d]
        node = np.argmin((c * c).sum(axis=1)[None, :] - 2.0 * (x @ c.T), axis=1)
        return self.first[d] + node, np.sqrt(((x - c[node]) ** 2).sum(axis=1)) * (1 + 1e-9)

    def floors(self, x: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """A score that the kth of a query does not fall below."""
        if x.shape[1] not in self.sample:
            return np.full(len(x), -np.inf)
        own, y = self.sample[x.shape[1]]
        s = np.where(own[None, :] == ids[:, None], -np.inf, x @ y.T)
        if s.shape[1] < self.k:
            return np.full(len(x), -np.inf)
        s = np.partition(s, s.shape[1] - self.k, axis=1)[:, s.shape[1] - self.k]
        # whole scores below 2^53 are exact, a rounded one may lie above the true one
        most = np.sqrt((x * x).sum(axis=1) * (y * y).sum(axis=1).max())
        return np.where(most < 2**52, s, s - 1e-9 * most)

    def reach(self, queries: dict[int, tuple], cands: dict[int, tuple]) -> tuple[list[tuple[int, int]], dict[int, float]]:
        """Pairs of a query leaf and a candidate leaf that may hold a result, and floors of the query leaves' kth scores.

        ``queries``: leaf -> (radius, worst floor); ``cands``: leaf -> (radius,
        whether it has rows of more than k ids).  Where it has, no query's kth
        score falls below the least product that the two leaves allow.
        """
        out = [(self.other, self.other)] if self.other in queries and self.other in cands else []
        floors = {n: -np.inf for n in queries}
        for d, first in self.first.items():
            c = self.centres[d]
            qs, cs = ([n for n in side if first <= n < first + len(c)] for side in (queries, cands))
            if not qs or not cs:
                continue
            x, y = c[np.array(qs) - first], c[np.array(cs) - first]
            q_norm, c_norm = np.sqrt((x * x).sum(axis=1))[:, None], np.sqrt((y * y).sum(axis=1))[None, :]
            r_q, r_c = np.array([queries[n][0] for n in qs])[:, None], np.array([cands[n][0] for n in cs])[None, :]
            least = -pair_bound(-(x @ y.T), q_norm, r_q, c_norm, r_c)
            floor = np.where([cands[n][1] for n in cs], least, -np.inf).max(axis=1)
            floors |= dict(zip(qs, floor.tolist(), strict=True))
            worst = np.maximum(floor, [queries[n][1] for n in qs])
            i, j = np.nonzero(pair_bound(x @ y.T, q_norm, r_q, c_norm, r_c) >= worst[:, None])
            out += [(qs[a], cs[e]) for a, e in zip(i.tolist(), j.tolist(), strict=True)]
        return out, floors


def deal(counts: dict[int, int], size: int) -> dict[int, tuple[int, int]]:
    """Leaf -> (first block, number of blocks): small neighbours share a block, large leaves are split."""
    out, block, held = {}, 0, 0
    for node, n in sorted(counts.items()):
        if n >= size or held + n > size:
            block, held = block + (1 if held else 0), 0
        parts = max(1, -(-n // size))
        out[node] = (block, parts)
        block, held = (block + parts, 0) if n >= size else (block, held + n)
    return out


def _ranges(pairs, own: dict, other: dict) -> list[tuple[int, int, int]]:
    """``(leaf, first, last)``: the blocks of the other side that a leaf's rows go to, neighbours merged."""
    blocks = defaultdict(set)
    for a, b in pairs:
        blocks[a].add(other[b])
    out = []
    for node, some in blocks.items():
        last = None
        for first, n in sorted(some):
            if last is not None and first <= last + 1:
                last = max(last, first + n - 1)
                out[-1] = (node, out[-1][1], last)
            else:
                last = first + n - 1
                out.append((node, first, last))
    return out


def _placed(rows: DataFrame, coarse: Coarse) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(coarse)  # at most the sample's rows

    def run(batch):
        import pyarrow.compute as pc

        c = shared.value
        ids, x, q = batch.column(0).to_numpy(), batch.column(1), batch.column(2).to_numpy(zero_copy_only=False)
        size = pc.list_value_length(x).to_numpy()
        flat, at = x.flatten().to_numpy(), np.concatenate([[0], np.cumsum(size)[:-1]])
        node, away, floor = np.zeros(len(ids), np.int64), np.zeros(len(ids)), np.full(len(ids), -np.inf)
        for d in np.unique(size):
            own = np.flatnonzero(size == d)
            m = flat[at[own][:, None] + np.arange(d)]
            node[own], away[own] = c.place(m)
            asks = q[own]
            if asks.any():
                floor[own[asks]] = c.floors(m[asks], ids[own[asks]])
        return ids, x, q, node, away, floor

    return _util.arrow_map(rows, run, "id long, x array<double>, q boolean, node long, away double, floor double")


def sent(rows: DataFrame, k: int, query_block: int, cand_block: int, sample: int) -> tuple[DataFrame, DataFrame]:
    """Queries and candidates ``(id, x, qb, cb)``, once for each cell they go to."""
    spark = rows.sparkSession
    some = _util.least_hashed(rows.select("id", "x"), "id", sample).collect()
    coarse = Coarse([r["id"] for r in some], [r["x"] for r in some], k)
    placed = _util.materialise(_placed(rows, coarse))
    own = F.when(F.col("q"), F.col("away"))
    # 64 marks tell whether a leaf has rows of more than k ids, whichever of them is a query's own
    mark = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64("id"), F.lit(64)).cast("int"))
    stats = placed.groupBy("node").agg(
        F.count("*").alias("n"), F.max("away").alias("r"), (F.bit_count(F.bit_or(mark)) > k).alias("more"),
        F.count_if("q").alias("nq"), F.max(own).alias("rq"), F.min(F.when(F.col("q"), F.col("floor"))).alias("worst"),
    ).collect()  # one row for each leaf of the coarse tree
    asks = [s for s in stats if s["nq"]]
    pairs, floors = coarse.reach({s["node"]: (s["rq"], s["worst"]) for s in asks}, {s["node"]: (s["r"], s["more"]) for s in stats})
    q_blocks, c_blocks = deal({s["node"]: s["nq"] for s in asks}, query_block), deal({s["node"]: s["n"] for s in stats}, cand_block)

    def routes(pairs, own, other) -> DataFrame:
        # at most leaves x leaves rows, whatever the table
        found = [(node, first, last, *own[node], floors.get(node)) for node, first, last in _ranges(pairs, own, other)]
        table = spark.createDataFrame(found, "at long, first long, last long, own long, parts long, least double")
        return F.broadcast(table.groupBy("at", "own", "parts", "least").agg(F.collect_list(F.struct("first", "last")).alias("to")))

    every = lambda c: F.explode(F.flatten(F.transform(c, lambda r: F.sequence(r["first"], r["last"]))))
    queries = placed.where("q").dropDuplicates(["id", "x"]).join(routes(pairs, q_blocks, c_blocks), F.col("node") == F.col("at"))
    queries = queries.select("id", "x", F.greatest("floor", "least").alias("floor"), (F.col("own") + F.pmod(F.xxhash64("id", "x", F.lit(7)), "parts")).alias("qb"), every(F.col("to")).alias("cb"))
    # rows of a leaf are dealt by position, not by value, so that copies don't meet in one block
    place = F.xxhash64(F.monotonically_increasing_id())
    cands = placed.select("id", "x", "node", place.alias("place")).join(routes([(b, a) for a, b in pairs], c_blocks, q_blocks), F.col("node") == F.col("at"))
    # aliased, so that the two sides of one table can meet
    cands = cands.select(F.col("id").alias("id"), F.col("x").alias("x"), (F.col("own") + F.pmod("place", "parts")).alias("cb"), every(F.col("to")).alias("qb"))
    return queries, cands


def exact_topk(
    table: DataFrame,
    is_query: Column,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = 5,
    scale: int = 256,
    query_block: int = 2048,
    cand_block: int = 4096,
    sample: int = 4096,
) -> DataFrame:
    """``query_id, rank, <id_col>, score`` for the queries against all rows.

    ``sample`` bounds the rows that shape the coarse tree and give the floors;
    it moves work, never results.
    """
    rows = table.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), integers(F.col(vector_col), scale).alias("x"), F.coalesce(is_query, F.lit(False)).alias("q")
    ).where(F.size("x") > 0)
    queries, cands = sent(rows, k, query_block, cand_block, sample)

    def cell(q, c):
        import pandas as pd

        out = []
        q_len, c_len = q["x"].map(len).to_numpy(), c["x"].map(len).to_numpy()
        for d in np.unique(q_len):
            qs, cs = q[q_len == d], c[c_len == d]
            if len(cs):
                qi, ci = qs["id"].to_numpy(), cs["id"].to_numpy()
                got = search(np.stack(qs["x"].to_list()), qi, np.stack(cs["x"].to_list()), ci, k, qs["floor"].to_numpy())
                out += [(int(qi[a]), int(ci[b]), s) for a, b, s in got]
        return pd.DataFrame(out, columns=["query_id", "cand_id", "score"]).astype("int64")

    cells = queries.groupBy("qb", "cb").cogroup(cands.groupBy("qb", "cb")).applyInPandas(cell, "query_id long, cand_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "cand_id")
    ranked = cells.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("cand_id").alias(id_col), "score")


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.x, c.x) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
