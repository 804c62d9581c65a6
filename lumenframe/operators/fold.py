"""Order-dependent folds: rows of a group stream through a small state."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string


def fold_sorted(df: DataFrame, keys: list[str], order: list[str], state: Callable, schema: str) -> DataFrame:
    """Runs ``state(key)`` over each group in order and emits ``key + result`` rows.

    ``state(key).row(r)`` returns result tuples for a row (a dict).  Groups are
    hash partitioned and sorted by Spark (which spills); a task walks its
    sorted rows and holds one state, never a whole group, so a group may be
    larger than memory.  The order within a group is sequential by nature.
    """
    out = to_arrow_schema(_parse_datatype_string(schema))
    n_keys = len(keys)

    def run(batches):
        current, key = None, None
        for batch in batches:
            found = []
            names = batch.schema.names
            for values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                row = dict(zip(names, values, strict=True))
                k = tuple(row[c] for c in keys)
                if current is None or k != key:
                    current, key = state(k), k
                found += [(*k, *r) for r in current.row(row)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], type=f.type) for i, f in enumerate(out)], schema=out)

    assert len(out) >= n_keys
    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
