"""Image scores from decoded pixels, as Arrow pandas functions: blur, edge density, perceptual hash, thumbnails.

Pixels come from Spark's image source: rows of BGR bytes.  Any image that
can't be read scores 0 (hash: null).
"""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def to_grey(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    a = np.frombuffer(data, np.uint8).reshape(height, width, channels).astype(np.float64)
    # fixed values: luma weights of blue, green and red
    return a[:, :, 0] if channels == 1 else a[:, :, :3] @ np.array([0.114, 0.587, 0.299])


def _filter3(grey: np.ndarray, kernel) -> np.ndarray:
    p = np.pad(grey, 1, mode="reflect")
    h, w = grey.shape
    return sum(kernel[i][j] * p[i : i + h, j : j + w] for i in range(3) for j in range(3) if kernel[i][j])


def laplacian_variance(grey: np.ndarray) -> float:
    """Sharpness: the population variance of the Laplacian."""
    return float(_filter3(grey, ((0, 1, 0), (1, -4, 1), (0, 1, 0))).var())


def edge_percent(grey: np.ndarray, low: float = 20.0, high: float = 80.0) -> float:
    """Percent of edge pixels: thinned gradients over ``high``, and those over ``low`` that touch them (in any number of steps)."""
    gx = _filter3(grey, ((-1, 0, 1), (-2, 0, 2), (-1, 0, 1)))
    gy = _filter3(grey, ((-1, -2, -1), (0, 0, 0), (1, 2, 1)))
    size = np.abs(gx) + np.abs(gy)
    angle = (np.round(np.arctan2(gy, gx) / (np.pi / 4)).astype(int)) % 4
    p = np.pad(size, 1)
    h, w = size.shape
    thin = np.zeros_like(size, bool)
    for k, (dy, dx) in enumerate(((0, 1), (1, 1), (1, 0), (1, -1))):
        ahead, back = p[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w], p[1 - dy : 1 - dy + h, 1 - dx : 1 - dx + w]
        thin |= (angle == k) & (size > back) & (size >= ahead)
    weak, strong = thin & (size > low), thin & (size > high)
    while True:
        q = np.pad(strong, 1)
        grown = weak & sum(q[i : i + h, j : j + w] for i in range(3) for j in range(3)).astype(bool) | strong
        if (grown == strong).all():
            return float(100.0 * strong.mean())
        strong = grown


def _shrink(grey: np.ndarray, size: int) -> np.ndarray:
    """Mean over an even grid of ``size`` by ``size`` cells."""
    rows = np.linspace(0, grey.shape[0], size + 1)
    cols = np.linspace(0, grey.shape[1], size + 1)
    cum = np.pad(grey.cumsum(0).cumsum(1), ((1, 0), (1, 0)))

    def at(y, x):
        y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
        y1, x1 = np.minimum(y0 + 1, grey.shape[0]), np.minimum(x0 + 1, grey.shape[1])
        fy, fx = (y - y0)[:, None], (x - x0)[None, :]
        return (cum[np.ix_(y0, x0)] * (1 - fy) + cum[np.ix_(y1, x0)] * fy) * (1 - fx) + (cum[np.ix_(y0, x1)] * (1 - fy) + cum[np.ix_(y1, x1)] * fy) * fx

    c = at(rows, cols)
    area = np.diff(rows)[:, None] * np.diff(cols)[None, :]
    return (c[1:, 1:] - c[:-1, 1:] - c[1:, :-1] + c[:-1, :-1]) / area


def perceptual_hash(grey: np.ndarray) -> int:
    """64 bits: low cosine frequencies of a 32 by 32 image over their median, as a signed long."""
    small = _shrink(grey, 32)
    k, n = np.meshgrid(np.arange(32), np.arange(32), indexing="ij")
    dct = np.cos(np.pi * k * (2 * n + 1) / 64)
    low = (dct @ small @ dct.T)[:8, :8]
    bits = (low > np.median(low)).ravel()
    value = int(np.packbits(bits).view(">u8")[0])
    return value - (1 << 64) if value >> 63 else value


def _scored(score, kind, failed):
    @F.pandas_udf(kind)
    def run(data: pd.Series, height: pd.Series, width: pd.Series, channels: pd.Series) -> pd.Series:
        out = []
        for d, h, w, c in zip(data, height, width, channels, strict=True):
            try:
                out.append(score(to_grey(d, int(h), int(w), int(c))))
            except (TypeError, ValueError):  # missing or damaged pixels
                out.append(failed)
        return pd.Series(out, dtype=object if failed is None else None)

    return run


def blur_score(*columns):
    """Of ``data, height, width, channels``."""
    return _scored(laplacian_variance, T.DoubleType(), 0.0)(*columns)


def edge_density(*columns):
    return _scored(edge_percent, T.DoubleType(), 0.0)(*columns)


def image_hash(*columns):
    return _scored(perceptual_hash, T.LongType(), None)(*columns)


def grid_vector(grey: np.ndarray, side: int = 8) -> list[float]:
    """Offline image embedding: mean brightness on an even grid, without its mean, of unit length."""
    v = _shrink(grey, side).ravel()
    v = v - v.mean()
    length = float(np.sqrt(v @ v))
    return (v / length if length else v).tolist()


def image_vector(*columns):
    """Embedding of ``data, height, width, channels``; null for an image that can't be read, so nothing shifts."""
    return _scored(grid_vector, T.ArrayType(T.DoubleType()), None)(*columns)


def encode_jpeg(content, quality: int = 90):
    """Whole images as JPEG of that quality; needs Pillow; null for one that can't be read."""

    def one(image):
        return image

    return _reencoded(content, one, quality)


def thumbnail(content, side: int = 224, quality: int = 95):
    """Centre-cropped JPEG of encoded images; needs Pillow; null for one that can't be read."""

    def fit(image):
        from PIL import Image, ImageOps

        return ImageOps.fit(image, (side, side), Image.Resampling.LANCZOS)

    return _reencoded(content, fit, quality)


def _reencoded(content, change, quality: int):
    @F.pandas_udf(T.BinaryType())
    def run(data: pd.Series) -> pd.Series:
        try:
            from PIL import Image
        except ImportError as e:
            raise RuntimeError("JPEG output needs Pillow") from e

        def one(d):
            try:
                image = Image.open(io.BytesIO(d)).convert("RGB")
            except (OSError, TypeError, ValueError):
                return None
            out = io.BytesIO()
            change(image).save(out, "JPEG", quality=quality)
            return out.getvalue()

        return data.map(one)

    return run(content)
