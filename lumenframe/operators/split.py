"""Windows over folders of any length: blocks of a folder's order, with a halo of rows from the blocks beside them.

A table of at most ``block`` rows is left whole, its windows run over folders.
In a longer one rows are sorted in ranges of ``(folder, frame_id)``, which may cut a folder
anywhere; a row's position is its place in the range and the number of
the folder's rows in the ranges before, from one small row for each folder and range.  A folder
is then dealt into blocks of ``block`` positions; the last ``before`` and the
first ``after`` rows beside a block are copied to it, so a window that reaches
no farther sees all it needs within the block.  Running sums add up a block's own rows and
the sums of the blocks before.  No task ever holds more of a folder than a block.

Defined cases: rows of negative id are unknown frames and are dropped; a null
folder is a folder; rows of equal folder and id lie side by side, in any order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from lumenframe.storage import stored

BLOCK = 1 << 16


def is_long(frames: DataFrame, block: int = BLOCK) -> bool:
    """Whether the table has more rows than a block."""
    return frames.limit(block + 1).count() > block


def numbered(frames: DataFrame, long: bool, block: int = BLOCK) -> DataFrame:
    """``frames`` with the 0-based ``pos`` in the folder."""
    known = frames.where("frame_id >= 0")
    if not long:
        return known.withColumn("pos", (F.row_number().over(Window.partitionBy("folder").orderBy("frame_id")) - 1).cast("long"))
    ranges = max(1, -(-known.count() // block))
    sorted_ = known.repartitionByRange(ranges, "folder", "frame_id").sortWithinPartitions("folder", "frame_id")
    placed = stored(sorted_.withColumn("__id", F.monotonically_increasing_id()))
    part, at = F.shiftright("__id", 33), F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    parts = placed.groupBy(F.col("folder").alias("__folder"), part.alias("__part")).agg(F.min(at).alias("__first"), F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy("__folder").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shift = stored(parts.select("__folder", "__part", (before - F.col("__first")).alias("__shift")))
    found = placed.join(shift, F.col("folder").eqNullSafe(F.col("__folder")) & (part == F.col("__part")))
    return found.select(*frames.columns, (at + F.col("__shift")).alias("pos"))


def over(frames: DataFrame, long: bool, before: int, after: int, columns: Callable[[WindowSpec], dict[str, Column]], block: int = BLOCK) -> DataFrame:
    """``frames`` with ``pos`` and the columns made for a window that reaches ``before`` and ``after`` rows at most."""
    f = numbered(frames, long, block)
    if not long:
        return f.withColumns(columns(Window.partitionBy("folder").orderBy("frame_id")))
    if max(before, after) > block:
        raise ValueError(f"a window reaches at most {block} rows")
    home, place = F.floor(F.col("pos") / block), F.col("pos") % block
    # a row near an edge goes to the block beside it, too
    homes = F.concat(F.array(home), F.when(place < after, F.array(home - 1)).otherwise(F.array().cast("array<bigint>")), F.when(place >= block - before, F.array(home + 1)).otherwise(F.array().cast("array<bigint>")))
    rows = f.withColumn("__block", F.explode(homes))
    made = rows.withColumns(columns(Window.partitionBy("folder", "__block").orderBy("pos")))
    return made.where(F.col("__block") == home).drop("__block")


def running(rows: DataFrame, long: bool, value: Column, name: str, block: int = BLOCK) -> DataFrame:
    """``rows`` (with ``pos``) and the sum of a value over the folder's rows up to each."""
    if not long:
        return rows.withColumn(name, F.sum(value).over(Window.partitionBy("folder").orderBy("pos")).cast("long"))
    rows = stored(rows.withColumn("__value", value).withColumn("__block", F.floor(F.col("pos") / block)))
    sums = rows.groupBy(F.col("folder").alias("__folder"), F.col("__block").alias("__of")).agg(F.sum("__value").alias("__sum"))
    before = F.coalesce(F.sum("__sum").over(Window.partitionBy("__folder").orderBy("__of").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = stored(sums.select("__folder", "__of", before.alias("__before")))  # one row for each block
    own = rows.withColumn("__own", F.sum("__value").over(Window.partitionBy("folder", "__block").orderBy("pos")))
    both = own.join(sums, F.col("folder").eqNullSafe(F.col("__folder")) & (F.col("__block") == F.col("__of")))
    return both.withColumn(name, (F.col("__own") + F.col("__before")).cast("long")).drop("__value", "__block", "__folder", "__of", "__before", "__own")
