"""All queries by name, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import events, keyframes, retrieval, texts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
for _module in (retrieval, keyframes, texts, events):
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty frames nearest to frame 0, each with its temporal neighbours."""
    return retrieval.flagship(spark, sf_dir)
