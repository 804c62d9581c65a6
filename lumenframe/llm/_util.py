"""Shared plumbing: Arrow map helpers, neutral column names, bounded samples."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lumenframe.storage import bucketed, delete_at_exit, shared_path
from lumenframe.storage import stored as materialise

__all__ = ["arrow_map", "delete_at_exit", "held", "least_hashed", "load", "materialise", "places", "plain", "restored", "returned", "shared_path"]


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[dict]], schema: str) -> DataFrame:
    """``mapInArrow`` for functions that turn a batch into dicts of columns."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    out = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(col, type=f.type) for col, f in zip(fn(batch), out, strict=True)], schema=out
                )

    return df.mapInArrow(run, schema)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{table}.parquet"))


def plain(docs: DataFrame, *wanted: str) -> tuple[DataFrame, tuple[str, ...], dict[str, str]]:
    """``docs`` with neutral column names, those of ``wanted``, and all names, so that extra columns can't clash."""
    names = {c: f"_c{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), tuple(names[w] for w in wanted), names


def restored(df: DataFrame, names: dict[str, str]) -> DataFrame:
    from pyspark.sql import functions as F

    return df.select(*[F.col(v).alias(k) for k, v in names.items()])


def least_hashed(df: DataFrame, key: str, n: int) -> DataFrame:
    """The ``n`` rows whose key has the least hash, or a few less on very uneven keys.

    A threshold on the hash leaves about four times ``n`` rows of the counted
    table before any are sorted, so what the tasks send on doesn't grow with
    their number; a table of fewer rows is left whole by the same rule.
    """
    from pyspark.sql import functions as F

    rows = df.count()
    mark = F.xxhash64(key)
    top = -(1 << 63) + int((1 << 64) * min(1.0, 4 * n / max(1, rows))) - 1
    return df.where(mark <= top).orderBy(mark, key).limit(n)


#: Rows of a part in ``held``: what comes back for a part is one map with so many entries at most.
PART = 1 << 12


def places(df: DataFrame) -> DataFrame:
    """``df`` with the place of every row: its part ``__part`` and where it is there, ``__at``."""
    from pyspark.sql import functions as F

    place = F.monotonically_increasing_id()
    return df.withColumns({"__part": F.shiftright(place, PART.bit_length() - 1), "__at": F.pmod(place, F.lit(PART))})


def held(placed: DataFrame) -> DataFrame:
    """Rows with places, written once, bucketed by part, so that decisions come back to where they lie."""
    spark = placed.sparkSession
    return bucketed(placed, "__part", max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def returned(rows: DataFrame, decisions: DataFrame, value: str) -> DataFrame:
    """``rows`` of ``held`` with the column ``value`` of ``decisions(__part, __at, value)``, null where there is none.

    A place has one decision at most.  Those of a part become one map, and the
    maps are joined on the part alone: only decisions are shuffled, never rows.
    """
    from pyspark.sql import functions as F

    maps = decisions.groupBy(F.col("__part").alias("__of")).agg(F.map_from_entries(F.collect_list(F.struct("__at", value))).alias("__map")).hint("shuffle_hash")
    joined = rows.join(maps, F.col("__part") == F.col("__of"), "left")
    return joined.select(*rows.columns, F.try_element_at("__map", F.col("__at")).alias(value))
