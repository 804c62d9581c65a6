"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession) -> str:
    """A fresh path in the session's ``spark.checkpoint.dir``.

    Where that is unset, a session with executors of its own is an error:
    they share no temporary folder.  Only a plain local session gets one,
    which is recorded in the session.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"spark.checkpoint.dir must name a folder that the driver and all executors of {master} share")
        base = "file://" + tempfile.mkdtemp(prefix="lumenframe-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/lumenframe-{uuid.uuid4().hex}"


def delete_at_exit(spark: SparkSession, path: str) -> None:
    """Has the driver's JVM delete the path when the application ends."""
    context = spark.sparkContext
    where = context._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(where)


def stored(df: DataFrame) -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and reads it back.

    Cuts lineage with files that outlive any executor; they go with the
    application.
    """
    spark = df.sparkSession
    path = shared_path(spark)
    df.write.parquet(path)
    delete_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, column: str, n: int) -> DataFrame:
    """Like ``stored``, in ``n`` buckets of ``column``: joins on it don't shuffle these rows again.

    Where each task holds few values of the column it writes as few files.
    The catalog forgets the table when Python ends.
    """
    spark = df.sparkSession
    path, name = shared_path(spark), f"lumenframe_{uuid.uuid4().hex}"
    df.write.bucketBy(max(1, min(n, 100_000)), column).option("path", path).format("parquet").saveAsTable(name)
    delete_at_exit(spark, path)
    atexit.register(_forget, spark, name)
    return spark.table(name)


def dealt(df: DataFrame, column: str) -> Callable[[int], DataFrame | None]:
    """Writes ``df`` by the values of ``column``, once; the result reads the rows of one value from its own folder, None where there are none.

    Rows of a value are brought together first, so that a value is a few files.
    """
    spark = df.sparkSession
    path = shared_path(spark)
    df.hint("rebalance", column).write.partitionBy(column).parquet(path)
    delete_at_exit(spark, path)
    schema = df.drop(column).schema

    def of(value: int) -> DataFrame | None:
        return spark.read.schema(schema).parquet(f"{path}/{column}={value}") if exists(spark, f"{path}/{column}={value}") else None

    return of


def _forget(spark: SparkSession, name: str) -> None:
    if spark.sparkContext._jsc is not None:  # else the session has ended, and with it a catalog in memory
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path: any store that Spark reads."""
    context = spark.sparkContext
    where = context._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(context._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    files, where = file_system(spark, path)
    return bool(files.exists(where))


def delete(spark: SparkSession, path: str) -> bool:
    files, where = file_system(spark, path)
    return bool(files.delete(where, True))


def write_file(spark: SparkSession, path: str, data: str | bytes) -> None:
    """A small file, whole or not at all: written beside, checked to be non-empty, then renamed into place."""
    data = data.encode() if isinstance(data, str) else data
    if not data:
        raise ValueError(f"nothing to write to {path}")
    files, where = file_system(spark, path)
    _, beside = file_system(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    out = files.create(beside, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()
    if files.getFileStatus(beside).getLen() != len(data):
        files.delete(beside, False)
        raise OSError(f"{path} was not written whole")
    files.delete(where, False)
    if not files.rename(beside, where):
        raise OSError(f"{path} could not be put in place")


def backup(spark: SparkSession, path: str, stamp: str) -> str:
    """A copy of a file or folder beside it, ``<path>.<stamp>.bak``."""
    files, where = file_system(spark, path)
    copy = f"{path}.{stamp}.bak"
    context = spark.sparkContext
    if not context._jvm.org.apache.hadoop.fs.FileUtil.copy(files, where, files, file_system(spark, copy)[1], False, True, context._jsc.hadoopConfiguration()):
        raise OSError(f"{path} could not be copied")
    return copy
