"""Encoders: text or images to vectors, pluggable and loaded once per worker."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Encoder(Protocol):
    """Encodes a batch; an item that fails gives None."""

    def encode(self, items: list) -> list[np.ndarray | None]: ...


class HashingEncoder:
    """Deterministic offline encoder: signed hashes of up to 77 lower-cased tokens, or of all runs of a file's bytes, of unit length."""

    def __init__(self, dimension: int = 64, max_tokens: int = 77):
        self.dimension, self.max_tokens = dimension, max_tokens

    def encode(self, items):
        return [None if x is None else self._one(x.lower().split()[: self.max_tokens] if isinstance(x, str) else self._words(x)) for x in items]

    @staticmethod
    def _words(data: bytes) -> list[str]:
        """Of bytes: text if they are text, else its runs of four bytes."""
        data = bytes(data)
        try:
            return data.decode().lower().split()
        except UnicodeDecodeError:
            return [data[i : i + 4].hex() for i in range(0, len(data), 4)]

    def _one(self, tokens: list[str]) -> np.ndarray:
        v = np.zeros(self.dimension)
        for token in tokens:
            h = int.from_bytes(hashlib.md5(token.encode()).digest()[:8], "little")
            v[h % self.dimension] += 1.0 if h >> 63 else -1.0
        length = np.sqrt(v @ v)
        return v / length if length else v


def encode_column(column: Column, make: Callable[[], Encoder], batch: int = 32, normalise: bool = True) -> Column:
    """Vectors of a column; ``make`` runs once per task, failures are null."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for s in series:
            items, out = s.tolist(), []
            for i in range(0, len(items), batch):
                for v in model.encode(items[i : i + batch]):
                    if v is not None and normalise:
                        length = float(np.sqrt(v @ v))
                        v = v / length if length else v
                    out.append(None if v is None else [float(x) for x in v])
            yield pd.Series(out, dtype=object)

    return run(column)


def encode_query(text: str, encoder: Encoder) -> list[float]:
    """One query on the driver."""
    return [float(x) for x in encoder.encode([text])[0]]


def with_embeddings(frames: DataFrame, column: str, make: Callable[[], Encoder]) -> DataFrame:
    """``frames`` with ``v``; rows that can't be encoded keep a null, so nothing shifts."""
    return frames.withColumn("v", encode_column(F.col(column), make))
