"""Hard negatives by a pivot table: triangle inequality over stored distances, exact checks of what survives.

With ``M`` the greatest norm of any row, a row is augmented to ``(x, sqrt(M^2
- |x|^2))`` and an anchor to ``(x, 0)``; then the squared distance of an
anchor and a row is ``|anchor|^2 + M^2 - 2 score``.  Every row is stored with
its distances to ``pivots`` rows that lie far apart in a bounded sample, every
anchor with its own.  By the triangle inequality the distance of an anchor and
a row lies between the greatest difference and the least sum of their
distances to a pivot, which brackets their score.  Only rows whose bracket
meets what an anchor looks for are scored exactly.

Brackets hold for sets, too, from the least and the greatest distance to each
pivot: of the rows nearest to one pivot, to decide which blocks of rows a block of
anchors meets at all, and of runs of rows within a block.

Positives come first: anchors meet the rows of their label, hot labels dealt
into blocks on both sides.  Their scores give the bands that negatives must lie in; then blocks of
anchors meet the blocks of rows, of whatever label, that the brackets allow.
The sample, which is broadcast, gives floors below which no result can lie.
Every cell returns the best few of each anchor and positive, which meet in one window.

Components are ``floor(scale * x)``, so scores are integers; brackets are
widened by a rounding margin, and bands are compared as integers.

Defined cases: rows with a null id, a null label, a null or empty vector or one
with a null or non-finite component take no part; a row is no partner of a row
of its own id; vectors of different length are not compared; equal anchor rows
are answered once, repeated other rows count each; an anchor without positives
or a positive without negatives has no rows; of a positive of score 0 the
negatives of score 0 satisfy the band, and of one below 0 none; an empty table
gives no rows; scores beyond 2^53 are computed in Python integers, those
beyond a long are an error; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import _util
from .cover_tree import _ranges, _whole, deal, integers

#: Rows of a block that share a bracket.
RUN = 128


class Pivots:
    """Of one vector length: the pivots, augmented, and the sample's rows."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, most: float, n: int):
        self.most, self.ids, self.labels, self.x = most, ids, labels, x
        rows = self.row(x)
        chosen, away = [0], np.full(len(rows), np.inf)
        while len(chosen) < min(n, len(rows)):  # the row that is farthest from all pivots so far
            away = np.minimum(away, ((rows - rows[chosen[-1]]) ** 2).sum(axis=1))
            if away.max() <= 0:
                break
            chosen.append(int(away.argmax()))
        self.at = rows[chosen]

    def row(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([x, np.sqrt(np.maximum(self.most - (x * x).sum(axis=1), 0))[:, None]])

    def distances(self, points: np.ndarray) -> np.ndarray:
        return np.stack([np.sqrt(((points - p) ** 2).sum(axis=1)) for p in self.at], axis=1)

    def of_rows(self, x: np.ndarray) -> np.ndarray:
        return self.distances(self.row(x))

    def of_anchors(self, x: np.ndarray) -> np.ndarray:
        return self.distances(np.hstack([x, np.zeros((len(x), 1))]))


def bracket(ask_low, ask_high, to_low, to_high, square_low, square_high, most: float):
    """Bounds of the scores of a set of anchors and a set of rows; pivots are on the last axis.

    The sets are given by their least and greatest distance to each pivot,
    ``square_*`` bound the anchors' squared norms.
    """
    near = np.maximum(np.maximum(ask_low - to_high, to_low - ask_high), 0).max(axis=-1)
    far = (ask_high + to_high).min(axis=-1)
    margin = 1e-9 * (square_high + most + 1.0)
    return (square_low + most - far * far) / 2 - margin, (square_high + most - near * near) / 2 + margin


def survivors(ask: np.ndarray, to: np.ndarray, square: np.ndarray, most: float, least: np.ndarray, highest: np.ndarray) -> np.ndarray:
    """Anchors x rows: whether a score from ``least`` to ``highest`` is possible; runs of rows first, then rows."""
    out = np.zeros((len(ask), len(to)), bool)
    for start in range(0, len(to), RUN):
        run = to[start : start + RUN]
        low, high = bracket(ask, ask, run.min(axis=0), run.max(axis=0), square, square, most)
        some = np.flatnonzero((high >= least) & (low <= highest))
        if len(some):
            low, high = bracket(ask[some][:, None], ask[some][:, None], run[None], run[None], square[some][:, None], square[some][:, None], most)
            out[some, start : start + RUN] = (high >= least[some][:, None]) & (low <= highest[some][:, None])
    return out


def scores(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact products: doubles where those are exact, Python integers beyond."""
    if x.shape[1] * max(1.0, np.abs(x).max()) * max(1.0, np.abs(y).max()) < 2**53:
        return x @ y.T
    return _whole(x) @ _whole(y).T


def best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest, ties to the smaller id."""
    if score.dtype == object:
        return np.array(sorted(range(len(ids)), key=lambda j: (-score[j], ids[j]))[:k], np.int64)
    keep = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k]) if len(score) > k else np.arange(len(score))
    return keep[np.lexsort((ids[keep], -score[keep]))[:k]]


def band(score: int, low: int, high: int) -> tuple[int, int]:
    """Least and greatest whole ``s`` with ``low * score <= 100 * s <= high * score``."""
    return -(-low * score // 100), high * score // 100


def _floors(score: np.ndarray, allowed: np.ndarray, k: int) -> np.ndarray:
    """The kth highest allowed score of each line, or -inf."""
    if score.dtype == object or score.shape[1] < k:
        return np.full(len(score), -np.inf)
    s = np.where(allowed, score, -np.inf)
    return np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]


def _by_length(vectors) -> dict[int, np.ndarray]:
    """Vector length -> places; the vectors are a pandas column of lists."""
    size = vectors.map(len).to_numpy()
    return {int(d): np.flatnonzero(size == d) for d in np.unique(size)}


def placed(rows: DataFrame, shared, positives: int) -> DataFrame:
    """``rows`` with distances to the pivots, the nearest of them, and for anchors their own distances and a floor of their last positive's score."""

    def run(batches):
        import pandas as pd

        for df in batches:
            if not len(df):
                continue
            home, ask_home = np.full(len(df), -1, np.int64), np.full(len(df), -1, np.int64)
            to, ask, floor = [None] * len(df), [None] * len(df), np.full(len(df), -np.inf)
            for d, at in _by_length(df["x"]).items():
                if (p := shared.value.get(d)) is None:
                    for i in at:
                        to[i], ask[i] = [], []
                    continue
                x = np.stack(df["x"].to_numpy()[at])
                far = p.of_rows(x)
                home[at] = far.argmin(axis=1)
                for i, f in zip(at, far, strict=True):
                    to[i] = f
                own = np.flatnonzero(df["anchor"].to_numpy()[at])
                if len(own):
                    far = p.of_anchors(x[own])
                    ask_home[at[own]] = far.argmin(axis=1)
                    for i, f in zip(at[own], far, strict=True):
                        ask[i] = f
                    same = (df["label"].to_numpy()[at[own]][:, None] == p.labels[None]) & (df["id"].to_numpy()[at[own]][:, None] != p.ids[None])
                    floor[at[own]] = _floors(scores(x[own], p.x), same, positives)
            yield df.assign(home=home, to=to, ask_home=ask_home, ask=pd.Series(ask, index=df.index), floor=floor)

    return rows.mapInPandas(run, "a long, id long, label string, x array<double>, anchor boolean, d int, home long, to array<double>, ask_home long, ask array<double>, floor double")


def _cell(k: int, most: dict, same_label: bool):
    """Function of a cell: anchors with bands (``least``, ``highest``: one of each slot) against rows."""

    def run(anchors, rows):
        import pandas as pd

        out = []
        lengths = _by_length(rows["x"]) if len(rows) else {}
        for d, own in (_by_length(anchors["x"]) if len(anchors) else {}).items():
            if d not in lengths:
                continue
            q, c = anchors.iloc[own], rows.iloc[lengths[d]]
            x, ids = np.stack(q["x"].to_numpy()), c["id"].to_numpy()
            lows, highs = q["least"].to_list(), q["highest"].to_list()
            y = np.stack(c["x"].to_numpy())
            s = scores(x, y)
            mask = (q["label"].to_numpy()[:, None] == c["label"].to_numpy()[None]) == same_label
            mask &= q["id"].to_numpy()[:, None] != ids[None]
            if d in most:
                ask, to = np.stack(q["ask"].to_numpy()), np.stack(c["to"].to_numpy())
                least = np.array([min(map(float, v)) for v in lows])
                highest = np.array([max(map(float, v)) for v in highs])
                mask &= survivors(ask, to, (x * x).sum(axis=1), most[d], least, highest)
            for i, row in enumerate(q["a"].to_list()):
                some = np.flatnonzero(mask[i])
                line = s[i][some]
                for slot, (low, high) in enumerate(zip(lows[i], highs[i], strict=True)):
                    fits = np.flatnonzero((line >= low) & (line <= high))
                    for j in fits[best(line[fits], ids[some[fits]], k)] if len(fits) else ():
                        out.append((row, slot, int(ids[some[j]]), int(line[j])))
        return pd.DataFrame(out, columns=["a", "slot", "partner", "score"]).astype("int64")

    return run


_CELL = "a long, slot long, partner long, score long"


def _best_of(cells: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("a", "slot").orderBy(F.desc("score"), "partner")
    return cells.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _positives(table: DataFrame, most: dict, k: int, anchor_block: int, row_block: int) -> DataFrame:
    """``a, slot, partner, score, rank``: the best rows of an anchor's own label."""
    counts = table.groupBy(F.col("label").alias("of")).agg(F.count_if("anchor").alias("asks"), F.count("*").alias("rows")).where("asks > 0")
    parts = lambda n, size: F.ceil(F.col(n) / size).cast("int")
    counts = _util.materialise(counts.select("of", parts("asks", anchor_block).alias("qs"), parts("rows", row_block).alias("cs")))
    both = table.join(counts, F.col("label") == F.col("of"))
    deal_by = lambda n, seed: F.pmod(F.xxhash64("a", F.lit(seed)), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n).cast("long") - 1))
    # the least a band can begin with is the floor; there is no highest
    asks = both.where("anchor").select("a", "id", "label", "x", "ask", F.array("floor").alias("least"), F.array(F.lit(float("inf"))).alias("highest"), "of", deal_by("qs", 3).alias("qb"), every("cs").alias("cb"))
    rows = both.select(F.col("id").alias("id"), F.col("label").alias("label"), F.col("x").alias("x"), F.col("to").alias("to"), F.col("home").alias("home"), F.col("of").alias("of"), deal_by("cs", 5).alias("cb"), every("qs").alias("qb"))
    cell = _cell(k, most, True)
    run = lambda q, c: cell(q, c.sort_values("home"))
    return _best_of(asks.groupBy("of", "qb", "cb").cogroup(rows.groupBy("of", "qb", "cb")).applyInPandas(run, _CELL), k)


def _banded(anchors: DataFrame, shared, k: int, low: int, high: int) -> DataFrame:
    """Anchors with the bands of their positives, raised to the floors that the sample gives; those without a band go."""

    def run(batches):
        for df in batches:
            least, highest = [], []
            for positives in df["positives"]:
                bands = [band(int(p["score"]), low, high) for p in positives]
                least.append([b[0] for b in bands])
                highest.append([b[1] for b in bands])
            for d, at in _by_length(df["x"]).items() if len(df) else ():
                if (p := shared.value.get(d)) is None:
                    continue
                s = scores(np.stack(df["x"].to_numpy()[at]), p.x)
                other = (df["label"].to_numpy()[at][:, None] != p.labels[None]) & (df["id"].to_numpy()[at][:, None] != p.ids[None])
                for line, ok, i in zip(s, other, at, strict=True):
                    for slot, (a, b) in enumerate(zip(least[i], highest[i], strict=True)):
                        floor = _floors(line[None], (ok & (line >= a) & (line <= b))[None], k)[0]
                        if floor > a:
                            least[i][slot] = int(floor)
            squares = [float(np.dot(x, x)) for x in df["x"]]
            first = [float(min(v)) for v in least]
            last = [float(max(v)) for v in highest]
            yield df.drop(columns="positives").assign(least=least, highest=highest, first=first, last=last, square=squares)

    schema = "a long, id long, label string, x array<double>, d int, ask_home long, ask array<double>, least array<long>, highest array<long>, first double, last double, square double"
    return anchors.where(F.exists("positives", lambda p: p["score"] >= 0)).mapInPandas(run, schema)


def _intervals(table: DataFrame, distances: str, keys: list[str], pivots: int, *more: Column) -> list:
    """One row for each length and nearest pivot: count, and least and greatest distance to each pivot."""
    each = [f(F.get(distances, F.lit(j))) for f in (F.min, F.max) for j in range(pivots)]
    return table.groupBy(*keys).agg(F.count("*").alias("n"), F.array(*each[:pivots]).alias("low"), F.array(*each[pivots:]).alias("high"), *more).collect()


def reach(asks: list, rows: list, most: dict) -> list[tuple[tuple, tuple]]:
    """Pairs of an anchors' and a rows' cell ``(length, pivot)`` whose bracket meets what the anchors look for."""
    out = []
    for q in asks:
        for c in rows:
            if q["d"] != c["d"]:
                continue
            ok = True
            if q["d"] in most:
                n = sum(v is not None for v in q["low"])
                low, high = bracket(*[np.array(r[side][:n]) for r in (q, c) for side in ("low", "high")], q["square_low"], q["square_high"], most[q["d"]])
                ok = high >= q["first"] and low <= q["last"]
            if ok:
                out.append(((q["d"], q["home"]), (c["d"], c["home"])))
    return out


def mine(
    table: DataFrame,
    is_anchor: Column,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label: Column | str = "label",
    positives: int = 5,
    negatives: int = 10,
    low: int = 30,
    high: int = 90,
    scale: int = 256,
    pivots: int = 16,
    sample: int = 4096,
    anchor_block: int = 1024,
    row_block: int = 4096,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``low`` and ``high`` are percent of the positive's score.  ``sample``
    bounds the rows that pivots are chosen from and floors are taken of; it
    moves work, never results.
    """
    own = F.col(label) if isinstance(label, str) else label
    rows = table.select(F.col(id_col).cast("long").alias("id"), own.cast("string").alias("label"), integers(F.col(vector_col), scale).alias("x"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
    rows = rows.where((F.size("x") > 0) & F.col("id").isNotNull() & F.col("label").isNotNull()).withColumn("d", F.size("x"))
    spark = table.sparkSession
    square = F.aggregate("x", F.lit(0.0), lambda t, v: t + v * v)
    norms = {r["d"]: r["most"] for r in rows.groupBy("d").agg(F.max(square).alias("most")).collect()}  # one row for each vector length
    some = _util.least_hashed(rows.select("id", "label", "x", "d"), "id", sample).collect()
    chosen = {}
    for d in sorted({r["d"] for r in some}):
        of = [r for r in some if r["d"] == d]
        chosen[d] = Pivots(np.array([r["id"] for r in of]), np.array([r["label"] for r in of], object), np.array([r["x"] for r in of]), norms[d] * (1 + 1e-12), pivots)
    shared, most = spark.sparkContext.broadcast(chosen), {d: p.most for d, p in chosen.items()}  # at most the sample's rows
    numbered = _util.materialise(rows.select(F.monotonically_increasing_id().alias("a"), "id", "label", "x", "anchor", "d"))
    # one of equal anchor rows asks
    asking = numbered.where("anchor").groupBy("id", "label", "x").agg(F.min("a").alias("asks")).select("asks")
    numbered = numbered.join(asking, F.col("a") == F.col("asks"), "left").select("a", "id", "label", "x", F.col("asks").isNotNull().alias("anchor"), "d")
    known = _util.materialise(placed(numbered, shared, positives))
    found = _util.materialise(_positives(known, most, positives, anchor_block, row_block))
    lists = found.groupBy("a").agg(F.array_sort(F.collect_list(F.struct("rank", "partner", "score"))).alias("positives")).withColumnRenamed("a", "of")  # at most ``positives``
    asks = known.where("anchor").join(lists, F.col("a") == F.col("of")).select("a", "id", "label", "x", "d", "ask_home", "ask", "positives")
    asks = _util.materialise(_banded(asks, shared, negatives, low, high).withColumnRenamed("ask_home", "home"))
    bounds = [F.min("first").alias("first"), F.max("last").alias("last"), F.min("square").alias("square_low"), F.max("square").alias("square_high")]
    ask_cells, row_cells = _intervals(asks, "ask", ["d", "home"], pivots, *bounds), _intervals(known, "to", ["d", "home"], pivots)
    pairs = reach(ask_cells, row_cells, most)
    q_blocks, c_blocks = deal({(s["d"], s["home"]): s["n"] for s in ask_cells}, anchor_block), deal({(s["d"], s["home"]): s["n"] for s in row_cells}, row_block)

    def routes(pairs, own, other) -> DataFrame:  # at most the square of the number of cells
        listed = [(*cell, first, last, *own[cell]) for cell, first, last in _ranges(pairs, own, other)]
        to = spark.createDataFrame(listed, "to_d int, to_home long, first long, last long, own long, parts long")
        return F.broadcast(to.groupBy("to_d", "to_home", "own", "parts").agg(F.collect_list(F.struct("first", "last")).alias("ranges")))

    def dealt(side: DataFrame, to: DataFrame, block: str, other: str, *columns: str) -> DataFrame:
        # by place, not by value, so that copies don't meet in one block
        mine_ = (F.col("own") + F.pmod(F.xxhash64("a"), F.col("parts"))).alias(block)
        every = F.explode(F.flatten(F.transform("ranges", lambda r: F.sequence(r["first"], r["last"])))).alias(other)
        return side.join(to, (F.col("d") == F.col("to_d")) & (F.col("home") == F.col("to_home"))).select(*[F.col(c).alias(c) for c in columns], mine_, every)

    q = dealt(asks, routes(pairs, q_blocks, c_blocks), "qb", "cb", "a", "id", "label", "x", "ask", "least", "highest")
    c = dealt(known, routes([(b, a) for a, b in pairs], c_blocks, q_blocks), "cb", "qb", "id", "label", "x", "to", "home")
    cell = _cell(negatives, most, False)
    run = lambda q, c: cell(q, c.sort_values("home"))
    hard = _best_of(q.groupBy("qb", "cb").cogroup(c.groupBy("qb", "cb")).applyInPandas(run, _CELL), negatives)
    hard = hard.select("a", "slot", "rank", F.col("partner").alias("negative_id"), F.col("score").alias("negative_score"))
    told = found.select(F.col("a").alias("p_a"), (F.col("rank") - 1).alias("p_slot"), F.col("partner").alias("positive_id"), F.col("score").alias("positive_score"))
    names = known.where("anchor").select(F.col("a").alias("n_a"), F.col("id").alias("anchor_id"))
    out = hard.join(told, (F.col("a") == F.col("p_a")) & (F.col("slot") == F.col("p_slot"))).join(names, F.col("a") == F.col("n_a"))
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def brute(rows: list[tuple], is_anchor, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> list[tuple]:
    """Plain model for tests, of ``(id, whole vector, label)`` rows of distinct anchors."""
    out = []
    for i, x, own in rows:
        if not is_anchor(i):
            continue
        s = sorted((-sum(int(a) * int(b) for a, b in zip(x, y, strict=True)), j, lab) for j, y, lab in rows if j != i and len(y) == len(x))
        for p, pid, _ in [r for r in s if r[2] == own][:positives]:
            fit = [r for r in s if r[2] != own and low * -p <= 100 * -r[0] <= high * -p][:negatives]
            out += [(i, pid, n + 1, j, -p, -v) for n, (v, j, _) in enumerate(fit)]
    return sorted(out)


ORACLE = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x FROM embeddings
  WHERE label IS NOT NULL AND vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id AS vec_id, a.label = c.label AS same, CAST(list_inner_product(a.x, c.x) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id <> c.vec_id AND len(a.x) = len(c.x) WHERE a.vec_id % 100 = 0
), p AS (
  SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
), n AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 100 * s.score BETWEEN 30 * p.score AND 90 * p.score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""
