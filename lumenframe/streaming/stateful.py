"""Stateful operators: sliding-log rate limit, last-kept removal, cache simulation.

The batch forms stream sorted rows through one small state per key
(`fold_sorted`); the streaming forms keep the same state in
``applyInPandasWithState``.
"""

from __future__ import annotations

from collections import OrderedDict, deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lumenframe.operators.fold import fold_sorted


def admit(log: list[float], now: float, limit: int, seconds: float) -> tuple[bool, list[float]]:
    """Whether a request at ``now`` is accepted, and the log after it.

    Entries older than the window are evicted (one exactly as old still
    counts); only accepted requests are recorded.
    """
    kept = [t for t in log if t >= now - seconds]
    if len(kept) < limit:
        return True, [*kept, now]
    return False, kept


def rate_limit(events: DataFrame, limit: int = 100, seconds: float = 60.0, key: str = "client") -> DataFrame:
    """``key, event_id, accepted`` of events with epoch seconds ``t``, in order of time and id."""

    class Log:
        def __init__(self, _):
            self.log = []

        def row(self, r):
            ok, self.log = admit(self.log, r["t"], limit, seconds)
            return [(r["event_id"], ok)]

    kind = dict(events.dtypes)[key]
    return fold_sorted(events.select(key, "event_id", "t"), [key], ["t", "event_id"], Log, f"{key} {kind}, event_id long, accepted boolean")


def rate_limit_stream(events: DataFrame, limit: int = 100, seconds: float = 60.0, key: str = "client") -> DataFrame:
    """The limiter on a stream ``key, event_id, t``; the log is the state of a key."""

    def step(k, frames, state: GroupState):
        log = list(state.get[0]) if state.exists else []
        for pdf in frames:
            pdf = pdf.sort_values(["t", "event_id"])
            out = []
            for event_id, t in zip(pdf["event_id"], pdf["t"], strict=True):
                ok, log = admit(log, t, limit, seconds)
                out.append((k[0], event_id, ok))
            yield pd.DataFrame(out, columns=[key, "event_id", "accepted"])
        state.update((log,))

    kind = dict(events.dtypes)[key]
    return events.select(key, "event_id", "t").groupBy(key).applyInPandasWithState(
        step, f"{key} {kind}, event_id long, accepted boolean", "log array<double>", "append", GroupStateTimeout.NoTimeout
    )


def last_kept_stream(frames: DataFrame, similarity: float = 0.98, key: str = "folder") -> DataFrame:
    """Last-kept removal on a stream ``key, frame_id, v``; the state is the last kept vector."""

    def step(k, chunks, state: GroupState):
        last = np.asarray(state.get[0]) if state.exists else None
        for pdf in chunks:
            pdf = pdf.sort_values("frame_id")
            kept = []
            for frame_id, v in zip(pdf["frame_id"], pdf["v"], strict=True):
                v = np.asarray(v, dtype=float)
                scale = 0.0 if last is None else float(np.sqrt(v @ v) * np.sqrt(last @ last))
                if last is None or (float(v @ last) / scale if scale else 0.0) < similarity:
                    last = v
                    kept.append((k[0], frame_id))
            yield pd.DataFrame(kept, columns=[key, "frame_id"])
        if last is not None:
            state.update((last.tolist(),))

    kind = dict(frames.dtypes)[key]
    return frames.select(key, "frame_id", "v").groupBy(key).applyInPandasWithState(
        step, f"{key} {kind}, frame_id long", "last array<double>", "append", GroupStateTimeout.NoTimeout
    )


class TtlCache:
    """LRU cache with a strict time to live and a capacity: the model behind the simulation.

    ``capacity`` is in entries, or in whatever unit ``request`` gives sizes.
    """

    def __init__(self, ttl: float, capacity: float):
        self.ttl, self.capacity, self.entries, self.sizes, self.used = ttl, capacity, OrderedDict(), {}, 0.0

    def request(self, key, now: float, size: float = 1) -> bool:
        """True for a hit; a miss stores the key."""
        if self.fresh(key, now):
            self.entries.move_to_end(key)
            return True
        self.put(key, now, size)
        return False

    def fresh(self, key, now: float) -> bool:
        at = self.entries.get(key)
        return at is not None and now - at < self.ttl

    def put(self, key, now: float, size: float = 1) -> list:
        """Stores a key; returns what had to go for it, as ``(key, time, size)``."""
        self.drop(key)
        self.entries[key], self.sizes[key] = now, size
        self.used += size
        gone = []
        while self.used > self.capacity and self.entries:
            old = next(iter(self.entries))
            gone.append((old, self.entries[old], self.sizes[old]))
            self.drop(old)
        return gone

    def drop(self, key) -> None:
        if key in self.entries:
            del self.entries[key]
            self.used -= self.sizes.pop(key)


class TieredCache:
    """Memory before disk: what memory evicts goes to disk, a disk hit comes back to memory."""

    def __init__(self, ttl: float, memory: float, disk: float):
        self.memory, self.disk = TtlCache(ttl, memory), TtlCache(ttl, disk)

    def request(self, key, now: float, size: float = 1) -> str:
        """``memory``, ``disk`` or ``miss``."""
        if self.memory.fresh(key, now):
            self.memory.entries.move_to_end(key)
            return "memory"
        found = self.disk.fresh(key, now)
        at = self.disk.entries[key] if found else now
        self.disk.drop(key)
        for old, then, held in self.memory.put(key, at, size):
            self.disk.put(old, then, held)
        return "disk" if found else "miss"


def cache_simulation(requests: DataFrame, ttl: float, capacity: int, shard: str = "shard") -> DataFrame:
    """``shard, event_id, hit`` for requests ``shard, key, event_id, t``: one cache per shard."""

    class Cache:
        def __init__(self, _):
            self.cache = TtlCache(ttl, capacity)

        def row(self, r):
            return [(r["event_id"], self.cache.request(r["key"], r["t"]))]

    kind = dict(requests.dtypes)[shard]
    return fold_sorted(requests.select(shard, "key", "event_id", "t"), [shard], ["t", "event_id"], Cache, f"{shard} {kind}, event_id long, hit boolean")


def recent_durations(events: DataFrame, n: int = 1000) -> DataFrame:
    """Streaming last-n monitor: after each micro-batch, count, mean and maximum of the operation's last ``n`` durations."""

    def step(k, frames, state: GroupState):
        log = deque(state.get[0] if state.exists else [], maxlen=n)
        for pdf in frames:
            log.extend(pdf.sort_values("t")["duration"])
        state.update((list(log),))
        yield pd.DataFrame([(k[0], len(log), float(np.mean(log)), max(log))], columns=["operation", "n", "mean", "most"])

    return events.select("operation", "duration", "t").groupBy("operation").applyInPandasWithState(
        step, "operation string, n long, mean double, most double", "log array<double>", "update", GroupStateTimeout.NoTimeout
    )


def registry_stream(announcements: DataFrame, timeout: str = "300 seconds", late: str = "0 seconds", self_id=None) -> DataFrame:
    """Node or session registry on a stream ``node_id, last_seen, status``: ``node_id, last_seen, status, online``.

    Every micro-batch gives the newest announcement of the nodes in it; a node
    from which nothing came for ``timeout`` of event time is given once more,
    offline, and forgotten.  State is one row for each node that is online.
    """
    seconds = pd.Timedelta(timeout).total_seconds()

    def step(k, chunks, state: GroupState):
        if state.hasTimedOut:
            seen, status = state.get
            state.remove()
            yield pd.DataFrame([(k[0], pd.Timestamp(seen, unit="us"), status, False)], columns=["node_id", "last_seen", "status", "online"])
            return
        best = state.get if state.exists else None
        for pdf in chunks:
            at = pdf["last_seen"].astype("datetime64[us]").astype("int64").to_numpy()
            i = int(at.argmax())
            if best is None or at[i] >= best[0]:
                best = (int(at[i]), pdf["status"].iloc[i])
        state.update(best)
        state.setTimeoutTimestamp(max(best[0] // 1000 + int(seconds * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([(k[0], pd.Timestamp(best[0], unit="us"), best[1], True)], columns=["node_id", "last_seen", "status", "online"])

    rows = announcements if self_id is None else announcements.where(F.col("node_id") != F.lit(self_id))
    kind = dict(rows.dtypes)["node_id"]
    return rows.select("node_id", "last_seen", "status").withWatermark("last_seen", late).groupBy("node_id").applyInPandasWithState(
        step, f"node_id {kind}, last_seen timestamp, status string, online boolean", "seen long, status string", "append", GroupStateTimeout.EventTimeTimeout
    )
