"""SimHash near-duplicates, compared on bit planes.

A fingerprint has bit b set where over half of the XXH64 hashes (seed 42) of
the 3-word shingles have it.  Equal fingerprints collapse to one row.  The 64
bits are dealt into five blocks; fingerprints at ``radius`` 3 or less agree
on at least two whole blocks, so the ten block pairs make ten exact keys of
25 or 26 bits that lose no pair.  Rows with a common key are compared bit
sliced: bit planes are stored vertically (one integer per bit, one position
per row), the distances of all rows to a probe are updated together with
carry-save counters, and a comparison is abandoned once every row is beyond
the radius.

A key with more rows than ``tile`` is dealt into row groups; each pair of
groups is a tile of its own.  A tile reports a spanning forest of its links,
not all pairs, and the forests' components are those of all links.

Defined cases: null or wordless text has fingerprint zero and is linked like
any other; fewer than three words form one shingle; repeats count; repeated
rows and equal ids are kept row by row by ``near_duplicates`` and told apart by
their place by ``keep_one``; where no id of a component is known its
``component_id`` is null; an empty table gives none; extra columns are ignored
by ``near_duplicates`` and kept by ``keep_one``.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from lumenframe.storage import bucketed

from . import _util
from .components import connected_components

SEED = 42
#: (first bit, width) of the five blocks.
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
RADIUS = 3


def fingerprint(text: str | None) -> int:
    """Unsigned 64-bit SimHash of a whole text."""
    w = text.encode().lower().split() if text else []  # bytes: A-Z only, and exactly the six ASCII blanks
    if not w:
        return 0
    grams = map(b" ".join, zip(w, w[1:], w[2:])) if len(w) > 2 else [b" ".join(w)]
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(g, SEED) for g in grams), np.uint64)
    total = np.zeros(64, np.int64)
    for i in range(0, len(h), 8192):
        part = np.ascontiguousarray(h[i : i + 8192]).astype("<u8").view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, fp`` (the 64 bits as a signed long); one map, no shuffle."""

    def run(batch):
        fp = np.array([fingerprint(t.as_py()) for t in batch.column(1)], np.uint64)
        return batch.column(0), fp.view(np.int64)

    return _util.arrow_map(docs.select(id_col, text_col), run, f"`{id_col}` {dict(docs.dtypes)[id_col]}, fp long")


class BitPlanes:
    """Fingerprints stored vertically: plane b has bit r set if row r has bit b."""

    def __init__(self, fps: np.ndarray):
        self.n = len(fps)
        self.full = (1 << self.n) - 1
        bits = np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        packed = np.packbits(bits.T, axis=1, bitorder="little")
        self.planes = [int.from_bytes(p.tobytes(), "little") for p in packed]

    def near(self, fp: int, alive: int | None = None) -> int:
        """Rows (as a bit set) within three differing bits of ``fp``."""
        full = self.full
        alive = full if alive is None else alive
        ones = twos = 0
        for b, plane in enumerate(self.planes):
            differ = plane ^ full if fp >> b & 1 else plane
            carry = ones & differ
            ones ^= differ
            alive &= ~(twos & carry)  # a carry out of twos: four or more
            twos ^= carry
            if not alive:
                return 0
        return alive


def _forest(left: np.ndarray, right: np.ndarray | None) -> list[tuple[int, int]]:
    """Spanning forest of the links within ``left``, or between ``left`` and ``right``.

    ``near`` counts differences modulo 4 beyond an overflow only for rows that
    are still alive, so every reported row is within the radius.
    """
    base = right if right is not None else left
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.get(x, x)) != x:
            parent[x] = parent.get(p, p)
            x = p
        return x

    edges = []
    for at in range(0, len(base), 4096):
        block = base[at : at + 4096]
        planes = BitPlanes(block)
        for i, fp in enumerate(left.tolist()):
            alive = planes.full
            if right is None:  # only later rows
                if i + 1 >= at + len(block):
                    break
                skip = i + 1 - at
                alive = planes.full >> skip << skip if skip > 0 else planes.full
            found = planes.near(fp, alive)
            while found:
                low = found & -found
                other = int(block[low.bit_length() - 1])
                found ^= low
                a, b = root(fp), root(other)
                if a != b:
                    parent[max(a, b)] = min(a, b)
                    edges.append((fp, other))
    return edges


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(distinct: DataFrame, tile: int = 2048) -> DataFrame:
    """Edges ``(a, b)`` between distinct fingerprints whose components are those of all links within the radius.

    ``distinct`` has one row per fingerprint, column ``fp``.
    """
    import pyarrow as pa

    keys = [
        F.struct(
            F.lit(k).alias("pair"),
            (
                F.shiftrightunsigned("fp", BLOCKS[i][0]).bitwiseAND(F.lit((1 << BLOCKS[i][1]) - 1)) * F.lit(1 << BLOCKS[j][1])
                + F.shiftrightunsigned("fp", BLOCKS[j][0]).bitwiseAND(F.lit((1 << BLOCKS[j][1]) - 1))
            ).alias("bits"),
        )
        for k, (i, j) in enumerate(combinations(range(5), 2))
    ]
    rows = distinct.select("fp", F.explode(F.array(*keys)).alias("k")).select("fp", (F.col("k.pair") * F.lit(1 << 26) + F.col("k.bits")).alias("key"))
    size = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").withColumnRenamed("key", "size_key")
    rows = rows.join(size, F.col("key") == F.col("size_key"))
    groups = F.ceil(F.col("n") / F.lit(tile)).cast("int")
    # a row of group g belongs to the tiles (x, g) with x <= g, on the right, and (g, y) with y >= g, on the left
    rows = rows.withColumn("g", F.pmod(F.xxhash64("fp"), groups).cast("int")).withColumn("groups", groups)
    tiles = F.transform(
        F.sequence(F.lit(0), F.col("groups") - 1), lambda x: F.struct(F.least("g", x).alias("x"), F.greatest("g", x).alias("y"))
    )
    rows = rows.select("fp", "key", "g", F.explode(tiles).alias("t")).select("fp", "key", F.col("t.x").alias("x"), F.col("t.y").alias("y"), "g")
    dealt = rows.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y", "g", "fp")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        for key, part in _runs(batches):
            fp = part[0].view(np.uint64)
            first = part[1] == key[1]
            edges = _forest(fp, None) if key[1] == key[2] else _forest(fp[first], fp[~first])
            if edges:
                yield pa.RecordBatch.from_arrays([pa.array([_signed(e[c]) for e in edges], pa.int64()) for c in (0, 1)], schema=schema)

    return dealt.mapInArrow(run, "a long, b long")


def _runs(batches):
    """Consecutive rows of the same (key, x, y), across batches: (key, (fp, g)). Runs are bounded by the tile size."""
    held, held_key = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        fp, key, x, y, g = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        cut = np.flatnonzero((key[1:] != key[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])) + 1
        for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(fp)], strict=True):
            k = (int(key[a]), int(x[a]), int(y[a]))
            if k != held_key and held_key is not None:
                yield held_key, tuple(np.concatenate(c) for c in zip(*held, strict=True))
                held = []
            held_key = k
            held.append((fp[a:b], g[a:b]))
    if held_key is not None:
        yield held_key, tuple(np.concatenate(c) for c in zip(*held, strict=True))


def _chosen(fps: DataFrame, best, tile: int) -> DataFrame:
    """``fp, chosen`` for every distinct fingerprint: the least ``best`` of its component.

    Rows are first reduced to one for each fingerprint, so copies in any
    number meet no join.
    """
    distinct = _util.materialise(fps.groupBy("fp").agg(F.min(best).alias("least")))
    parts = connected_components(links(distinct.select("fp"), tile))
    joined = distinct.join(parts, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    joined = _util.materialise(joined)
    least = joined.groupBy("root").agg(F.min("least").alias("chosen")).withColumnRenamed("root", "r")
    return joined.join(least, F.col("root") == F.col("r")).select(F.col("fp").alias("f"), "chosen")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tile: int = 2048) -> DataFrame:
    """``id_col, fp, component_id`` for every row; the component id is the least ``id_col`` reachable."""
    fps = _util.materialise(fingerprints(docs, id_col, text_col))
    named = _chosen(fps, F.col(id_col), tile).withColumnRenamed("chosen", "component_id")
    return fps.join(named, F.col("fp") == F.col("f"), "left").select(id_col, "fp", "component_id")


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return found.select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Rows of a part: the positions that one bitmap holds.
PART = 1 << 15


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tile: int = 2048) -> DataFrame:
    """One row of each component, that with the least id; columns kept.

    Rows are told apart by their place, not by their id: of several rows with
    the least id of a component, one that reads first stays, and equal ids in
    different components stay each.  Rows without an id come last.

    The rows are written once with their fingerprints, in parts of at most
    ``PART`` rows, bucketed by part.  All decisions are made on fingerprints
    and places; they come back as one bitmap for each part, which meets the
    rows where they lie: texts are never shuffled.
    """
    work, (own_id, own_text), names = _util.plain(docs, id_col, text_col)
    at = work.columns.index(own_text)
    place = F.monotonically_increasing_id()
    placed = work.withColumns({"__part": F.shiftright(place, 15), "__at": F.pmod(place, F.lit(PART))})

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            fp = np.array([fingerprint(t.as_py()) for t in batch.column(at)], np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fp.view(np.int64))], names=[*batch.schema.names, "fp"])

    spark = docs.sparkSession
    buckets = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    held = bucketed(placed.mapInArrow(run, StructType([*placed.schema.fields, StructField("fp", LongType())])), "__part", buckets)
    best = F.struct(F.col(own_id).isNull().alias("last"), F.col(own_id).alias("id"), F.col("__part").alias("part"), F.col("__at").alias("at"))
    chosen = _chosen(held, best, tile).select(F.col("chosen.part").alias("p"), F.col("chosen.at").alias("a")).distinct()
    bits = chosen.groupBy("p").agg(F.bitmap_construct_agg("a").alias("bits")).hint("shuffle_hash")
    octet = F.conv(F.hex(F.substring(F.col("bits"), (F.col("__at") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    kept = held.join(bits, F.col("__part") == F.col("p")).where(F.getbit(octet, (F.col("__at") % 8).cast("int")) == 1)
    return _util.restored(kept, names)
