"""Vector expressions over ``array<double>`` columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(_col(a), _col(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(F.aggregate(_col(a), F.lit(0.0), lambda s, x: s + x * x))


def squared_distance(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(_col(a), _col(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column | str, b: Column | str, clip: bool = False) -> Column:
    """Cosine; 0 where a side is missing or has no length. ``clip`` limits it to [0, 1]."""
    scale = norm(a) * norm(b)
    value = F.coalesce(F.when(scale > 0, dot(a, b) / scale), F.lit(0.0))
    return F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0)) if clip else value


def l2_normalise(a: Column | str) -> Column:
    """Unit vector; a zero vector stays as it is."""
    length = norm(a)
    return F.transform(_col(a), lambda x: x / F.when(length == 0, F.lit(1.0)).otherwise(length))


def is_valid(a: Column | str, dimension: int | None = None) -> Column:
    """Not null or empty, all components finite, and of the given dimension."""
    v = _col(a)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    ok = v.isNotNull() & (F.size(v) > 0) & finite
    return F.coalesce(ok & (F.size(v) == dimension) if dimension else ok, F.lit(False))


def sign_code(a: Column | str, bits: int = 64) -> Column:
    """Signs of the first 64 components as a BIGINT: bit i is set where component i is positive."""
    v = _col(a)
    taken = [F.when(F.get(v, F.lit(i)) > 0, F.lit(1 << i if i < 63 else -(1 << 63))).otherwise(F.lit(0)).cast("long") for i in range(bits)]
    code = taken[0]
    for t in taken[1:]:
        code = code.bitwiseOR(t)
    return code


def hyperplane_code(a: Column | str, planes: list[list[float]]) -> Column:
    """One bit per hyperplane: the side on which the vector lies (up to 64 planes)."""
    bits = [F.when(dot(a, F.array(*map(F.lit, p))) > 0, F.lit(1 << i if i < 63 else -(1 << 63))).otherwise(F.lit(0)).cast("long") for i, p in enumerate(planes)]
    code = bits[0]
    for b in bits[1:]:
        code = code.bitwiseOR(b)
    return code


def hamming(a: Column | str, b: Column | str) -> Column:
    return F.bit_count(_col(a).bitwiseXOR(_col(b)))


def normalise_columns(df: DataFrame, method: str, vector_col: str = "v") -> DataFrame:
    """Rescales every dimension over all rows: ``minmax`` or ``standard`` (population deviation); a zero range divides by 1.

    Statistics are one row per dimension, collected into two arrays of the
    vectors' dimension, so the rows themselves are never shuffled or exploded back.
    """
    if method == "l2":
        return df.withColumn(vector_col, l2_normalise(vector_col))
    stats = df.select(F.posexplode(vector_col).alias("dim", "x")).groupBy("dim")
    if method == "minmax":
        stats = stats.agg(F.min("x").alias("shift"), (F.max("x") - F.min("x")).alias("scale"))
    elif method == "standard":
        stats = stats.agg(F.avg("x").alias("shift"), F.stddev_pop("x").alias("scale"))
    else:
        raise ValueError(f"unknown method {method!r}")
    packed = stats.agg(F.array_sort(F.collect_list(F.struct("dim", "shift", "scale"))).alias("__stats"))
    scaled = F.transform(
        F.arrays_zip(F.col(vector_col).alias("x"), F.col("__stats").alias("s")),
        lambda p: (p["x"] - p["s"]["shift"]) / F.when(p["s"]["scale"] == 0, F.lit(1.0)).otherwise(p["s"]["scale"]),
    )
    return df.crossJoin(F.broadcast(packed)).withColumn(vector_col, scaled).drop("__stats")  # one row
