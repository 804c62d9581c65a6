"""Configuration tree: dotted access, deep merge, validation (outside Spark)."""

from __future__ import annotations

import copy
import json
from pathlib import Path

# fixed values: defaults of the engine's settings
DEFAULTS = {
    "search": {"mode": "hybrid", "limit": 50, "similarity_threshold": 0.7, "temporal_window": 3},
    "performance": {"slow_seconds": 5.0, "rate_limit": 100, "rate_seconds": 60},
    "cache": {"query_ttl": 3600, "agent_ttl": 1800, "translation_ttl": 86400, "memory_mb": 512},
    "network": {"node_timeout": 300, "announce_seconds": 15, "sweep_seconds": 120},
}


def merge(base: dict, over: dict) -> dict:
    """``base`` with the values of ``over``; nested trees are merged."""
    out = copy.deepcopy(base)
    for k, v in over.items():
        out[k] = merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else copy.deepcopy(v)
    return out


class Config:
    def __init__(self, values: dict | None = None):
        self.values = merge(DEFAULTS, values or {})

    @classmethod
    def load(cls, path: str) -> Config:
        return cls(json.loads(Path(path).read_text()))

    def get(self, key: str, default=None):
        node = self.values
        for part in key.split("."):
            if not isinstance(node, dict) or part not in node:
                return default
            node = node[part]
        return node

    def set(self, key: str, value) -> None:
        *parents, last = key.split(".")
        node = self.values
        for part in parents:
            node = node.setdefault(part, {})
        node[last] = value

    def repaired(self) -> Config:
        """A copy in which every value with a problem has its default again."""
        out = Config(self.values)
        for problem in self.problems():
            key = problem.split(":")[0]
            out.set(key, copy.deepcopy(Config().get(key)))
        return out

    def problems(self) -> list[str]:
        """What is wrong with the values; empty if nothing."""
        found = []
        checks = {
            "search.limit": lambda v: isinstance(v, int) and 0 < v <= 1000,
            "search.similarity_threshold": lambda v: isinstance(v, (int, float)) and 0 <= v <= 1,
            "search.temporal_window": lambda v: isinstance(v, int) and v >= 0,
            "performance.rate_limit": lambda v: isinstance(v, int) and v > 0,
            "cache.memory_mb": lambda v: isinstance(v, (int, float)) and v > 0,
            "network.node_timeout": lambda v: isinstance(v, (int, float)) and v > 0,
            "search.mode": lambda v: v in ("hybrid", "vector", "semantic"),
            "performance.slow_seconds": lambda v: isinstance(v, (int, float)) and v > 0,
            "performance.rate_seconds": lambda v: isinstance(v, (int, float)) and v > 0,
            **{f"cache.{k}": lambda v: isinstance(v, (int, float)) and v > 0 for k in ("query_ttl", "agent_ttl", "translation_ttl")},
            "network.announce_seconds": lambda v: isinstance(v, (int, float)) and v > 0,
            "network.sweep_seconds": lambda v: isinstance(v, (int, float)) and v > 0,
        }
        for section in DEFAULTS:
            if not isinstance(self.get(section), dict):
                found.append(f"{section}: not a section")
        for key, ok in checks.items():
            if not ok(self.get(key)):
                found.append(f"{key}: {self.get(key)!r}")
        return found
