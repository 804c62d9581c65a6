"""Pairs within a folder, tile by tile: bounded tasks, matrix products, and few rows out.

``near_pairs`` is the exact join above a similarity: rows only meet where the
triangle inequality leaves room for a partner.  ``tile_pairs`` compares all rows of a folder.
Rows are dealt into tiles of about ``tile`` rows by a hash of the id; each
pair of tiles is a task of its own, so a folder of any size is spread
over many tasks and none holds more than two tiles.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.storage import stored

TILE = 2048


def unit_rows(column) -> np.ndarray:
    """Unit vectors of a column of arrays; zero vectors stay zero."""
    m = np.stack([np.asarray(v, float) for v in column]) if len(column) else np.zeros((0, 0))
    length = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return m / np.where(length == 0, 1.0, length)


def tile_pairs(frames: DataFrame, compare: Callable, schema: str, tile: int = TILE) -> DataFrame:
    """Rows of ``compare(ids, vectors, ids, vectors, same)`` for all pairs of tiles of a folder, ``folder`` in front.

    ``compare`` gets two tiles (twice the same one where ``same``) and returns
    the columns of ``schema``.  Rows without a vector take no part.
    """
    rows = frames.where("v is not null").select("folder", "frame_id", "v")
    size = rows.groupBy(F.col("folder").alias("__folder")).agg(F.ceil(F.count("*") / F.lit(tile)).cast("int").alias("__tiles"))
    rows = rows.join(size, F.col("folder").eqNullSafe(F.col("__folder")))
    rows = rows.withColumn("__g", F.pmod(F.xxhash64("frame_id"), "__tiles").cast("int"))
    cells = F.transform(F.sequence(F.lit(0), F.col("__tiles") - 1), lambda x: F.struct(F.least("__g", x).alias("x"), F.greatest("__g", x).alias("y")))
    rows = rows.select("folder", "frame_id", "v", "__g", F.explode(cells).alias("c")).select("folder", "frame_id", "v", "__g", F.col("c.x").alias("__x"), F.col("c.y").alias("__y"))
    names = [c.split()[0] for c in schema.split(",")]

    def cell(key, rows: pd.DataFrame) -> pd.DataFrame:
        left = rows[rows["__g"] == key[1]].sort_values("frame_id")
        right = left if key[1] == key[2] else rows[rows["__g"] == key[2]].sort_values("frame_id")
        ids = [s["frame_id"].to_numpy() for s in (left, right)]
        out = pd.DataFrame(dict(zip(names, compare(ids[0], unit_rows(left["v"]), ids[1], unit_rows(right["v"]), key[1] == key[2]), strict=True)), columns=names)
        out.insert(0, "folder", key[0])
        return out

    kind = dict(frames.dtypes)["folder"]
    return rows.groupBy("folder", "__x", "__y").applyInPandas(cell, f"folder {kind}, {schema}")


#: Rows of a cell that the centres aim at, centres at most, and rows that they are fitted on for each.
CELL, CENTRES, EACH = 512, 1024, 32
#: Rows that are placed at once, and rows of a batch that is sent on.
PLACED, SENT = 1024, 8192


def near_pairs(frames: DataFrame, compare: Callable, schema: str, least: float, tile: int = TILE, cell: int = CELL) -> DataFrame:
    """``tile_pairs`` for a ``compare`` that only wants pairs of cosine ``least`` or more: rows meet near ones alone.

    Unit vectors of cosine ``least`` lie within ``t = sqrt(2 - 2 least)``.  A
    row's home is the nearest of some centres.  By the triangle inequality a
    row ``x`` can only be within ``t`` of rows of the home ``c`` if ``d(x, c)``
    is at most ``t`` plus the radius of ``c``, and at most ``2 t`` plus the
    distance to its own home.  So it is sent to its home and to those homes
    of smaller number that both bounds allow, which meets every such
    pair once.  A home's own rows and its guests are dealt into tiles, and each pair
    of tiles is a task, so a home that holds very many rows is split.

    The centres come from a bounded sample and move work, never results.
    Where ``least`` is 0 or less nothing can be pruned, and all tiles meet; so
    do they where the bounds, by that sample, would send a row to more homes
    than its folder has tiles.
    """
    if least <= 0:
        return tile_pairs(frames, compare, schema, tile)
    reach = float(np.sqrt(max(0.0, 2 - 2 * least))) + 1e-6
    frames = stored(frames.where("v is not null").select("folder", "frame_id", "v"))
    tiled = frames.groupBy("folder").agg(F.count("*").alias("n")).agg(F.sum(F.col("n") * F.ceil(F.col("n") / F.lit(tile))) / F.sum("n")).first()[0] or 0.0  # of the folder of a row, on average
    met = _met(frames, cell, reach, most=float(tiled)) if tiled > 1 else None
    if met is None:
        return tile_pairs(frames, compare, schema, tile)
    rows = stored(met)
    # tiles of a home: its own rows, then its guests
    parts = lambda role: F.ceil(F.count_if(F.col("guest") == role) / F.lit(tile)).cast("int")
    size = rows.groupBy(F.col("folder").alias("__folder"), F.col("home").alias("__home")).agg(parts(0).alias("__own"), parts(1).alias("__guests")).where("__own > 0")
    rows = rows.join(size, F.col("folder").eqNullSafe(F.col("__folder")) & (F.col("home") == F.col("__home")))
    at = F.when(F.col("guest") == 0, F.pmod(F.xxhash64("frame_id"), "__own")).otherwise(F.col("__own") + F.pmod(F.xxhash64("frame_id"), "__guests")).cast("int")
    rows = rows.withColumn("__g", at)
    # an own tile meets the own tiles and all guests, a guest tile the own tiles alone
    last = F.when(F.col("guest") == 0, F.col("__own") + F.col("__guests")).otherwise(F.col("__own")) - 1
    cells = F.transform(F.sequence(F.lit(0), last), lambda x: F.struct(F.least("__g", x).alias("x"), F.greatest("__g", x).alias("y")))
    dealt = rows.select("folder", "frame_id", "v", "home", "__g", F.explode(cells).alias("c")).select("folder", "frame_id", "v", "home", "__g", F.col("c.x").alias("__x"), F.col("c.y").alias("__y"))
    names = [c.split()[0] for c in schema.split(",")]

    def meet(key, rows: pd.DataFrame) -> pd.DataFrame:
        left = rows[rows["__g"] == key[2]].sort_values("frame_id")
        right = left if key[2] == key[3] else rows[rows["__g"] == key[3]].sort_values("frame_id")
        ids = [s["frame_id"].to_numpy() for s in (left, right)]
        out = pd.DataFrame(dict(zip(names, compare(ids[0], unit_rows(left["v"]), ids[1], unit_rows(right["v"]), key[2] == key[3]), strict=True)), columns=names)
        out.insert(0, "folder", key[0])
        return out

    return dealt.groupBy("folder", "home", "__x", "__y").applyInPandas(meet, f"folder {dict(frames.dtypes)['folder']}, {schema}")


def near_matches(left: DataFrame, right: DataFrame, least: float, tile: int = TILE, cell: int = CELL) -> DataFrame:
    """``left_id, folder, right_id``: pairs of a row of ``left`` (``frame_id, v``) and one of ``right`` (``folder, frame_id, v``) of cosine ``least`` or more.

    ``near_pairs`` for two sides: the right rows are at home, the left ones
    are guests wherever they may have a partner.  ``least`` is above 0.
    """
    reach = float(np.sqrt(max(0.0, 2 - 2 * least))) + 1e-6
    kinds = dict(right.dtypes)
    both = right.select("folder", "frame_id", "v", F.lit(False).alias("visits")).unionByName(left.select(F.lit(None).cast(kinds["folder"]).alias("folder"), F.col("frame_id").cast(kinds["frame_id"]).alias("frame_id"), "v", F.lit(True).alias("visits")))
    rows = stored(_met(both, cell, reach, "visits"))
    parts = lambda role: F.ceil(F.count_if(F.col("guest") == role) / F.lit(tile)).cast("int")
    size = rows.groupBy(F.col("home").alias("__home")).agg(parts(0).alias("__own"), parts(1).alias("__guests")).where("__own > 0 and __guests > 0")
    rows = rows.join(size, F.col("home") == F.col("__home"))
    deal = lambda n: F.pmod(F.xxhash64("folder", "frame_id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = rows.where("guest = 0").select("folder", "frame_id", "v", "home", deal("__own").alias("__x"), every("__guests").alias("__y"))
    guests = rows.where("guest = 1").select(F.col("frame_id").alias("frame_id"), F.col("v").alias("v"), F.col("home").alias("home"), every("__own").alias("__x"), deal("__guests").alias("__y"))

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        i, j = np.nonzero(unit_rows(b["v"]) @ unit_rows(a["v"]).T >= least) if len(a) and len(b) else (np.zeros(0, int), np.zeros(0, int))
        return pd.DataFrame({"left_id": b["frame_id"].to_numpy()[i], "folder": a["folder"].to_numpy()[j], "right_id": a["frame_id"].to_numpy()[j]})

    return own.groupBy("home", "__x", "__y").cogroup(guests.groupBy("home", "__x", "__y")).applyInPandas(meet, f"left_id {kinds['frame_id']}, folder {kinds['folder']}, right_id {kinds['frame_id']}")


def _met(frames: DataFrame, cell: int, reach: float, visits: str | None = None, most: float | None = None) -> DataFrame | None:
    """``folder, frame_id, v, home, guest``: every row at home, and as a guest where it may have a partner.

    Rows that ``visits`` marks have no home and are guests of any number; no
    other row is one then.  None where a row would go to more than ``most`` homes, as rows of the sample do on average.
    """
    spark = frames.sparkSession
    rows = frames.where(F.exists("v", lambda x: x != 0)).select("folder", "frame_id", "v", (F.col(visits) if visits else F.lit(False)).alias("visits"))
    every, rows = rows, rows.where("not visits")
    n = rows.count()
    centres = max(1, min(CENTRES, -(-n // cell)))
    some = unit_rows([r["v"] for r in least_hashed(rows, "frame_id", EACH * centres, n).select("v").collect()]) if centres > 1 else None
    if some is None or len(some) < 2:
        return every.select("folder", "frame_id", "v", F.lit(0).alias("home"), F.col("visits").cast("int").alias("guest"))
    fitted = lloyd(some, centres, 8, np.random.default_rng(7))
    shared = spark.sparkContext.broadcast(fitted)

    def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(1 + (c * c).sum(axis=1)[None] - 2 * (x @ c.T), 0))

    def apart(batch: pa.RecordBatch) -> np.ndarray:
        return distances(unit_rows(batch.column(2).to_pylist()), shared.value)

    def slices(batches):
        for batch in batches:
            yield from (batch.slice(a, PLACED) for a in range(0, batch.num_rows, PLACED))

    def radii(batches):
        far = np.zeros(len(shared.value))
        for batch in slices(batches):
            d = apart(batch)
            np.maximum.at(far, d.argmin(axis=1), d.min(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(far), dtype=np.int32)), pa.array(far)], names=["home", "r"])

    found = rows.mapInArrow(radii, "home int, r double").groupBy("home").agg(F.max("r").alias("r")).collect()  # one row for each centre
    radius = np.zeros(len(fitted))
    for r in found:
        radius[r["home"]] = r["r"]
    def allowed(d: np.ndarray, radius: np.ndarray) -> np.ndarray:
        return (d <= radius[None] + reach) & (d <= d.min(axis=1)[:, None] + 2 * reach)

    if most is not None:
        d = distances(some[:PLACED], fitted)
        if 1 + (allowed(d, radius) & (np.arange(d.shape[1])[None] < d.argmin(axis=1)[:, None])).sum(axis=1).mean() > most:
            return None
    bound = spark.sparkContext.broadcast(radius)

    def place(batches):
        for batch in slices(batches):
            d = apart(batch)
            home, free = d.argmin(axis=1), batch.column(3).to_numpy(zero_copy_only=False)
            near = allowed(d, bound.value)
            if visits:
                near &= free[:, None]
            else:
                near &= np.arange(d.shape[1])[None] < home[:, None]
            (i, j), own = np.nonzero(near), np.flatnonzero(~free)
            rows, to, guest = np.concatenate([own, i]), np.concatenate([home[own], j]).astype(np.int32), np.repeat([0, 1], [len(own), len(i)]).astype(np.int32)
            for a in range(0, len(rows), SENT):
                take = pa.array(rows[a : a + SENT])
                yield pa.RecordBatch.from_arrays([*[batch.column(c).take(take) for c in range(3)], pa.array(to[a : a + SENT]), pa.array(guest[a : a + SENT])], names=["folder", "frame_id", "v", "home", "guest"])

    kinds = dict(rows.dtypes)
    return every.mapInArrow(place, f"folder {kinds['folder']}, frame_id {kinds['frame_id']}, v {kinds['v']}, home int, guest int")


def lloyd(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """Centres of ``k`` groups of rows, first picked by their squared distance from those before; a centre that loses all rows starts again from one of them."""
    picked = [int(rng.integers(len(x)))]
    away = ((x - x[picked[0]]) ** 2).sum(axis=1)
    while len(picked) < min(k, len(x)) and (total := away.sum()) > 0:
        picked.append(min(int(np.searchsorted(np.cumsum(away), rng.random() * total)), len(x) - 1))
        away = np.minimum(away, ((x - x[picked[-1]]) ** 2).sum(axis=1))
    centres = x[picked]
    for _ in range(rounds):
        near = nearest(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=len(centres))
        sums[n == 0] = x[rng.integers(len(x), size=int((n == 0).sum()))]
        centres = sums / np.maximum(n, 1)[:, None]
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = (centres * centres).sum(axis=1) / 2
    return np.concatenate([np.argmax(x[a : a + 8192] @ centres.T - half, axis=1) for a in range(0, len(x), 8192)]) if len(x) else np.zeros(0, int)


def least_hashed(df: DataFrame, key: str, n: int, rows: int) -> DataFrame:
    """The ``n`` of ``rows`` rows whose key has the least hash, or a few less on very uneven keys.

    A threshold on the hash leaves about four times ``n`` rows before any are
    sorted, so what the tasks send on doesn't grow with their number.
    """
    mark = F.xxhash64(key)
    top = -(1 << 63) + int((1 << 64) * min(1.0, 4 * n / max(1, rows))) - 1
    return df.where(mark <= top).orderBy(mark, key).limit(n)


def best_of_rows(ids: np.ndarray, others: np.ndarray, scores: np.ndarray, k: int, above: float, same: bool):
    """``(id, other, score)`` of the k best of every row above the threshold; a row is no partner of its own."""
    rows, cols = [], []
    for i, line in enumerate(scores):
        ok = np.flatnonzero(line > above)
        if same:
            ok = ok[others[ok] != ids[i]]
        if len(ok) > k:
            kth = np.partition(line[ok], len(ok) - k)[len(ok) - k]
            ok = ok[line[ok] >= kth]
        ok = ok[np.lexsort((others[ok], -line[ok]))][:k]
        rows.append(np.full(len(ok), i))
        cols.append(ok)
    rows, cols = (np.concatenate(x).astype(int) if x else np.zeros(0, int) for x in (rows, cols))
    return ids[rows], others[cols], scores[rows, cols]


def forest(ids: np.ndarray, others: np.ndarray, linked: np.ndarray) -> tuple[list, list]:
    """Links of a spanning forest: the same components as all links, and fewer than there are rows."""
    parent: dict = {}

    def root(x):
        while (p := parent.get(x, x)) != x:
            parent[x] = parent.get(p, p)
            x = p
        return x

    a, b = [], []
    for i, j in zip(*np.nonzero(linked), strict=True):
        x, y = root(ids[i]), root(others[j])
        if x != y:
            parent[max(x, y)] = min(x, y)
            a.append(ids[i])
            b.append(others[j])
    return a, b
