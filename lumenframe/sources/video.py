"""Video source: one partition per file, decoded by a pluggable decoder."""

from __future__ import annotations

import importlib
import os
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# fixed values: extensions of the first and the second tool
EXTENSIONS_V1 = ("mp4",)
EXTENSIONS_V2 = ("mp4", "avi", "mov", "mkv", "webm")


class VideoSource(DataSource):
    """``spark.read.format("frames").option("decoder", "module:function").load(dir)``.

    The decoder takes a path and yields ``(position_ms, fps, bytes)`` per
    frame; frames stream through it one at a time.  Without the option,
    OpenCV is used where it is installed.
    """

    @classmethod
    def name(cls) -> str:
        return "frames"

    def schema(self) -> str:
        return "video string, frame_idx long, pts_time double, fps double, image binary"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.root = options["path"].removeprefix("file://")
        self.decoder = options.get("decoder")
        self.extensions = tuple(options.get("extensions", ",".join(EXTENSIONS_V2)).split(","))

    def partitions(self):
        names = sorted(n for n in os.listdir(self.root) if n.rsplit(".", 1)[-1].lower() in self.extensions)
        return [_File(os.path.join(self.root, n)) for n in names]

    def read(self, partition) -> Iterator[tuple]:
        if partition is None or not hasattr(partition, "path"):
            return
        if self.decoder:
            module, _, function = self.decoder.partition(":")
            decode = getattr(importlib.import_module(module), function)
        else:
            decode = _opencv
        name = os.path.splitext(os.path.basename(partition.path))[0]
        for i, (ms, fps, data) in enumerate(decode(partition.path)):
            yield name, i, ms / 1000.0, float(fps), data


def _opencv(path: str):
    try:
        import cv2
    except ImportError as e:
        raise RuntimeError("decoding video needs OpenCV, or the option 'decoder'") from e
    video = cv2.VideoCapture(path)
    fps = video.get(cv2.CAP_PROP_FPS)
    while True:
        ms = video.get(cv2.CAP_PROP_POS_MSEC)
        ok, frame = video.read()
        if not ok:
            return
        yield ms, fps, cv2.imencode(".png", frame)[1].tobytes()


def video_frames(spark, root: str, decoder: str, extensions=EXTENSIONS_V2, batch: int = 64):
    """The same rows from any store that Spark reads: the decoder gets a file's bytes instead of its path.

    Listing and reading are Spark's; frames leave in batches of ``batch``, so
    a video's frames are never held together.
    """
    import pandas as pd
    from pyspark.sql import functions as F

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    name = F.element_at(F.split("path", "/"), -1)
    files = files.where(F.lower(F.element_at(F.split(name, r"\."), -1)).isin(*extensions)).select(F.regexp_extract(name, r"^(.*)\.[^.]*$", 1).alias("video"), "content")
    columns = ["video", "frame_idx", "pts_time", "fps", "image"]

    def run(parts):
        module, _, function = decoder.partition(":")
        decode = getattr(importlib.import_module(module), function)
        for part in parts:
            for video, content in zip(part["video"], part["content"], strict=True):
                held = []
                for i, (ms, fps, data) in enumerate(decode(content)):
                    held.append((video, i, ms / 1000.0, float(fps), data))
                    if len(held) == batch:
                        yield pd.DataFrame(held, columns=columns)
                        held = []
                if held:
                    yield pd.DataFrame(held, columns=columns)

    return files.repartition("video").mapInPandas(run, "video string, frame_idx long, pts_time double, fps double, image binary")
