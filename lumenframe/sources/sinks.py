"""Writers: frame maps, result exports, submissions, packages with a manifest."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenframe import storage
from lumenframe.functions import text as T
from lumenframe.operators import health, temporal


def frame_map_v1(kept: DataFrame) -> DataFrame:
    """Columns of the first map format; the time is cut to seconds."""
    return kept.select(F.col("n").cast("int").alias("n"), F.col("pts_time").cast("int").alias("pts_time"), F.col("fps").cast("int").alias("fps"), F.col("frame_idx").cast("int").alias("frame_idx"))


def frame_map_v2(kept: DataFrame) -> DataFrame:
    return kept.select(F.col("n").cast("int").alias("n"), F.round("pts_time", 3).alias("pts_time"), F.col("fps").cast("int").alias("fps"), F.col("frame_idx").cast("int").alias("original_frame_idx"), F.col("scene_id").cast("int").alias("scene_id"))


def renumbered(kept: DataFrame, key: str = "folder", order: str = "pos") -> DataFrame:
    """Input columns with ``n`` numbered again from 0 in kept order."""
    return kept.withColumn("n", (F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1).cast("int"))


def export_rows(results: DataFrame, tags: bool = False, explanation: bool = False) -> DataFrame:
    """Columns of the CSV export; scores with four places, lists joined by semicolons."""
    columns = [F.col("rank").alias("Rank"), F.col("folder").alias("Folder"), F.col("image").alias("Image"), F.col("frame_id").alias("FrameID"), F.format_string("%.4f", "score").alias("Similarity"), F.col("file_path").alias("File_Path")]
    if tags:
        columns += [F.array_join(c, "; ").alias(c.title()) for c in ("scene_tags", "detected_objects")]
    if explanation:
        columns.append(F.col("explanation").alias("Explanation"))
    return results.select(*columns)


def export_json(results: DataFrame, timestamp: str, limit: int = 1000) -> DataFrame:
    """One JSON document: timestamp, total and the results in rank order.

    A document is one row, so it holds at most ``limit`` results (the search's own
    limit); more are an error, none are left out.  ``json_lines`` has no limit.
    """
    results = results.orderBy("rank").limit(limit + 1)
    item = F.struct("rank", *[c for c in results.columns if c != "rank"])
    packed = results.agg(F.count("*").alias("total"), F.array_sort(F.collect_list(item)).alias("results"))
    value = F.to_json(F.struct(F.lit(timestamp).alias("timestamp"), "total", "results"), {"ignoreNullFields": "true"})
    return packed.select(F.when(F.col("total") > limit, F.raise_error(F.lit(f"more than {limit} results for one document; json_lines writes any number"))).otherwise(value).alias("value"))


def json_lines(results: DataFrame) -> DataFrame:
    """The flat form: one JSON object for each result, without its explanation."""
    return results.select(F.to_json(F.struct(*[c for c in results.columns if c != "explanation"])).alias("value"))


def export_files(results: DataFrame, path: str, kinds: tuple[str, ...] = ("csv", "json")) -> list[str]:
    """Writes the results in several formats without the explanation; returns the folders."""
    done = []
    for kind in kinds:
        target = f"{path}.{kind}"
        if kind == "csv":
            export_rows(results).write.mode("overwrite").csv(target, header=True)
        elif kind == "json":
            json_lines(results).write.mode("overwrite").text(target)
        else:
            raise ValueError(f"unknown format {kind!r}")
        done.append(target)
    return done


#: Rows that a sheet holds besides its header; fixed by the format.
SHEET_ROWS = 1_048_575


def export_xlsx(results: DataFrame, path: str, sheet_rows: int = SHEET_ROWS) -> None:
    """Spreadsheet of all results, on as many sheets as they need; needs openpyxl.  Rows stream through the driver."""
    try:
        import openpyxl
    except ImportError as e:
        raise RuntimeError("XLSX export needs openpyxl") from e
    book = openpyxl.Workbook(write_only=True)
    sheet, held = None, sheet_rows
    for row in results.orderBy("rank").toLocalIterator():
        if held == sheet_rows:
            sheet, held = book.create_sheet(), 0
            sheet.append(results.columns)
        sheet.append([x if x is None or isinstance(x, (int, float, str, bool)) else str(x) for x in row])
        held += 1
    book.save(path)


def submission_lines(results: DataFrame, answer: str | None = None, limit: int = 100) -> DataFrame:
    """``<folder>.csv,<stem>[,"<answer>"]`` for at most 100 results, in rank order."""
    parts = [F.concat(F.col("folder").cast("string"), F.lit(".csv")), F.col("image").cast("string")]
    if answer and answer.strip():
        parts.append(F.lit(f'"{answer.strip()}"'))
    return results.orderBy("rank").limit(limit).select("rank", F.concat_ws(",", *parts).alias("line"))


def write_submission(results: DataFrame, folder: str, name: str, answer: str | None = None, limit: int = 100) -> str:
    """Writes the lines as one file without a header or a last line break, under a name that isn't taken; returns its path."""
    spark = results.sparkSession
    lines = [r["line"] for r in submission_lines(results, answer, limit).orderBy("rank").collect()]  # at most `limit`
    path, n = f"{folder}/{name}.csv", 1
    while storage.exists(spark, path):
        path, n = f"{folder}/{name}_{n}.csv", n + 1
    storage.write_file(spark, path, "\n".join(lines))
    return path


#: The newest version of a package that can be read.
PACKAGE = 1


def write_package(tables: dict[str, DataFrame], path: str, **info) -> dict:
    """Parquet tables and, last, a manifest with counts, columns and a checksum of the layout."""
    spark = next(iter(tables.values())).sparkSession
    layout = {}
    for name, df in tables.items():
        if "file_path" in df.columns:
            df = df.withColumn("file_path", T.relative_path(F.col("file_path")))
        df.write.mode("overwrite").parquet(f"{path}/{name}")
        layout[name] = {"rows": spark.read.parquet(f"{path}/{name}").count(), "columns": df.columns}
    manifest = {"version": PACKAGE, "tables": layout, **info}
    line = spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string")
    manifest["checksum"] = line.select(F.md5("value")).first()[0]
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
    return manifest


def check_before_write(index: DataFrame, metadata: DataFrame, key: str = "frame_id") -> None:
    """Raises where an index and its metadata don't belong together; to be called before they are written."""
    r = health.consistency(index, metadata, key, F.lit(True)).first()
    if not r["consistent"]:
        raise ValueError(f"{r['missing_metadata']} rows without metadata, {r['orphan_metadata']} without a vector")


def load_package(spark: SparkSession, path: str, root: str | None = None) -> tuple[dict, dict[str, DataFrame]]:
    """Manifest and tables; relative paths are set under ``root``.

    A newer version, a changed manifest and a table that lost rows are errors.
    """
    manifest = json.loads(spark.read.text(f"{path}/manifest").first()[0])
    if manifest["version"] > PACKAGE:
        raise ValueError(f"package of version {manifest['version']}, known is {PACKAGE}")
    plain = json.dumps({k: v for k, v in manifest.items() if k != "checksum"}, sort_keys=True)
    if hashlib.md5(plain.encode()).hexdigest() != manifest["checksum"]:
        raise ValueError("the manifest was changed")
    tables = {}
    for name, info in manifest["tables"].items():
        df = spark.read.parquet(f"{path}/{name}")
        if df.count() != info["rows"]:
            raise ValueError(f"table {name} has not the {info['rows']} rows of the manifest")
        if root and "file_path" in df.columns:
            df = df.withColumn("file_path", F.concat(F.lit(root.rstrip("/") + "/"), "file_path"))
        tables[name] = df
    return manifest, tables


def package_info(spark: SparkSession, path: str) -> DataFrame:
    """``table, rows, columns`` of a package, from its manifest alone."""
    manifest = json.loads(spark.read.text(f"{path}/manifest").first()[0])
    rows = [(name, t["rows"], ",".join(t["columns"])) for name, t in sorted(manifest["tables"].items())]
    return spark.createDataFrame(rows, "table string, rows long, columns string")


def write_metadata(frames: DataFrame, path: str, *, similar: DataFrame | None = None, **info) -> dict:
    """A package of the relations around keyframes: rows, temporal order, neighbours and, if given, the similarity graph."""
    order = temporal.prev_next(frames)
    tables = {"frames": frames, "temporal": order}
    if similar is not None:
        tables["similar"] = similar
    return write_package(tables, path, **info)


def load_metadata(spark: SparkSession, path: str, root: str | None = None) -> tuple[dict, dict[str, DataFrame]]:
    """The relations again; the temporal index is rebuilt from the frames, so it always agrees with them."""
    manifest, tables = load_package(spark, path, root)
    tables["temporal"] = temporal.prev_next(tables["frames"])
    return manifest, tables


def tolerant_rows(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Rows of a JSON-lines file that fit the schema, and the lines that don't; no bad line stops the load."""
    raw = spark.read.text(path).where(F.trim("value") != "")
    read = raw.select("value", F.from_json("value", f"{schema}, __bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"}).alias("r"))
    bad = F.col("r").isNull() | F.col("r.__bad").isNotNull()
    return read.where(~bad).select("r.*").drop("__bad"), read.where(bad).select("value")
