import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe import schemas
from lumenframe.config import Config
from lumenframe.functions import encoders, images
from lumenframe.plans import service
from lumenframe.sources import logs, scan, video


def test_image_scores_of_flat_noisy_and_half_images():
    flat, rng = np.full((40, 40), 7.0), np.random.default_rng(0)
    half = np.zeros((40, 40))
    half[:, 20:] = 255
    assert images.laplacian_variance(flat) == 0 and images.edge_percent(flat) == 0
    assert images.laplacian_variance(rng.uniform(0, 255, (40, 40))) > images.laplacian_variance(half)
    assert 2 <= images.edge_percent(half) <= 6
    assert images.perceptual_hash(half) == images.perceptual_hash(np.repeat(np.repeat(half, 2, 0), 2, 1))
    assert (images.perceptual_hash(half) ^ images.perceptual_hash(half.T)).bit_count() > 5


def _png(path, pixels):
    import struct
    import zlib

    h, w = pixels.shape
    chunk = lambda t, d: struct.pack(">I", len(d)) + t + d + struct.pack(">I", zlib.crc32(t + d))
    raw = b"".join(b"\0" + pixels[i].astype(np.uint8).tobytes() for i in range(h))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_image_source_sizes_and_scores(spark, tmp_path):
    (tmp_path / "v").mkdir()
    half = np.zeros((40, 48))
    half[:, 24:] = 255
    _png(tmp_path / "v" / "1.png", half)
    _png(tmp_path / "v" / "2.png", np.zeros((16, 48)))  # too small
    (tmp_path / "v" / "3.png").write_bytes(b"no image")
    i = scan.images(spark, str(tmp_path))
    c = ("data", "height", "width", "channels")
    r = i.select("width", images.blur_score(*c).alias("b"), images.edge_density(*c).alias("e"), images.image_hash(*c).alias("h")).collect()
    assert len(r) == 1 and r[0].width == 48 and r[0].b > 0 and r[0].e > 0 and r[0].h is not None


def test_encoder_keeps_rows_that_fail(spark):
    df = spark.createDataFrame([(1, "red car"), (2, None), (3, "car red"), (4, "")], "i int, t string")
    r = {x.i: x.v for x in encoders.with_embeddings(df, "t", encoders.HashingEncoder).collect()}
    assert r[2] is None and r[1] == pytest.approx(r[3]) and np.dot(r[1], r[1]) == pytest.approx(1) and not any(r[4])


def test_video_source(spark, tmp_path):
    (tmp_path / "fake_decoder.py").write_text("def decode(path):\n    for i in range(3):\n        yield i * 500, 25, bytes([i])\n")
    (tmp_path / "a.mp4").write_bytes(b"")
    (tmp_path / "b.txt").write_bytes(b"")
    spark.sparkContext.addPyFile(str(tmp_path / "fake_decoder.py"))
    sys.path.insert(0, str(tmp_path))
    spark.dataSource.register(video.VideoSource)
    r = spark.read.format("frames").option("decoder", "fake_decoder:decode").load(str(tmp_path)).orderBy("frame_idx").collect()
    assert [(x.video, x.frame_idx, x.pts_time) for x in r] == [("a", 0, 0.0), ("a", 1, 0.5), ("a", 2, 1.0)]


def test_logs_and_frame_lists(spark, tmp_path):
    (tmp_path / "p.log").write_text('2025-01-01 | {"operation": "search", "duration": 1.5, "timestamp": 1700000000.0}\nnoise\n')
    r = logs.performance_log(spark, str(tmp_path / "p.log")).collect()
    assert len(r) == 1 and r[0].operation == "search" and r[0].ts is not None
    (tmp_path / "l.csv").write_text("folder_name,frame_id\nv,7\n,8\n")
    assert {x.id for x in logs.frame_list(spark, str(tmp_path / "l.csv")).collect()} == {"v:7", "unknown:8"}


def test_config():
    c = Config({"search": {"limit": 5}})
    assert c.get("search.limit") == 5 and c.get("search.mode") == "hybrid" and c.get("a.b", 1) == 1 and not c.problems()
    c.set("search.similarity_threshold", 2)
    assert c.problems() == ["search.similarity_threshold: 2"]


def test_service(spark, sf):
    s = service.SearchService(schemas.frames(spark, sf))
    heard = []
    s.on("search", lambda *a: heard.append(a))
    r = s.search("a red car", limit=7).collect()
    assert sorted(x.rank for x in r) == list(range(1, 8)) and all(x.context is not None and x.explanation for x in r) and heard
    assert s.search_by_image(3, limit=2).orderBy("rank").first().frame_id == 3
    answer, none = s.chat_search(" Hello ")
    assert none is None and answer
    answer, found = s.chat_search("a dog")
    assert found.count() == 10 and answer.startswith("Found 10 frames")
    keys = {x.key for x in s.handle("search", {"query": "a dog", "limit": 3}).collect()}
    assert {"rank1", "rank2", "rank3", "near1.1"} <= keys
    with pytest.raises(ValueError):
        s.handle("search", {"query": ""})
    with pytest.raises(ValueError):
        s.search("  ")
    assert service.validate_request("chat", {"question": "x" * 5001}) and service.validate_request("nothing", {})
    assert service.error_code(KeyError()) == "not_found" and service.error_code(OSError()) == "internal"
    docs = spark.createDataFrame([("car_1", 1, ["Dog"], ["cat"], "a dog runs"), ("x", 2, [], [], "none")], "folder string, frame_id long, tags array<string>, objects array<string>, description string")
    assert [x.frame_id for x in s.semantic_search(docs, "dog car").collect()] == [1]


def test_udtf(spark):
    service.register_udtf(spark)
    r = spark.sql("SELECT * FROM parse_frame_refs('a:1, b:2, c')").collect()
    assert [(x.folder, x.frame) for x in r[:2]] == [("a", "1"), ("b", "2")] and r[2].problem


def test_plans_push_down_and_prune(spark, sf):
    plan = schemas.frames(spark, sf).where(F.col("frame_id") == 3).select("folder")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(vec_id), EqualTo(vec_id,3)]" in plan and "embedding" not in plan.split("ReadSchema")[1]
