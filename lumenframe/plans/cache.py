"""Result cache of searches: a time to live, a budget in bytes, and a key of all that decides a result."""

from __future__ import annotations

import time
from collections import OrderedDict
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from lumenframe.config import DEFAULTS
from lumenframe.storage import delete, file_system, stored


@dataclass
class Entry:
    table: DataFrame
    path: str
    size: int
    at: float


class ResultCache:
    """Results as tables in the shared folder, least recently used first out.

    An entry is a hit while it is younger than ``ttl`` seconds.  Results
    outlive any executor, and nothing is held in memory but their names.
    """

    def __init__(self, spark: SparkSession, ttl: float = DEFAULTS["cache"]["query_ttl"], budget: int = DEFAULTS["cache"]["memory_mb"] << 20, clock: Callable[[], float] = time.time):
        self.spark, self.ttl, self.budget, self.clock = spark, ttl, budget, clock
        self.entries: OrderedDict[tuple, Entry] = OrderedDict()
        self.requests = self.hits = 0

    def get(self, key: tuple) -> DataFrame | None:
        self.requests += 1
        found = self.entries.get(key)
        if found is None:
            return None
        if self.clock() - found.at >= self.ttl:
            self._drop(key)
            return None
        self.entries.move_to_end(key)
        self.hits += 1
        return found.table

    def put(self, key: tuple, result: DataFrame) -> DataFrame:
        """Stores a result and returns it; what no longer fits goes, the oldest use first."""
        if key in self.entries:
            self._drop(key)
        table = stored(result)
        path = table.inputFiles()[0].rsplit("/", 1)[0] if table.inputFiles() else ""
        files, where = file_system(self.spark, path) if path else (None, None)
        size = files.getContentSummary(where).getLength() if path else 0
        self.entries[key] = Entry(table, path, size, self.clock())
        while self.used() > self.budget and len(self.entries) > 1:
            self._drop(next(iter(self.entries)))
        return table

    def cached(self, key: tuple, compute: Callable[[], DataFrame]) -> DataFrame:
        found = self.get(key)
        return self.put(key, compute()) if found is None else found

    def expire(self, older_than: float | None = None) -> int:
        """Drops entries of at least that age (the time to live by default); returns how many."""
        age = self.ttl if older_than is None else older_than
        gone = [k for k, e in self.entries.items() if self.clock() - e.at >= age]
        for k in gone:
            self._drop(k)
        return len(gone)

    def used(self) -> int:
        return sum(e.size for e in self.entries.values())

    def stats(self) -> DataFrame:
        """One row: requests, hits, rate, share of the budget in use, and the alarm of a low rate."""
        rate = round(self.hits / self.requests, 3) if self.requests else 0.0
        row = (self.requests, self.hits, rate, round(100 * self.used() / self.budget, 2), self.requests > 100 and rate < 0.1)
        return self.spark.createDataFrame([row], "requests long, hits long, hit_rate double, memory_percent double, low_hit_rate boolean")

    def _drop(self, key: tuple) -> None:
        if path := self.entries.pop(key).path:
            delete(self.spark, path)
