"""Writers, listings, shares, tolerant readers, video from any store, configuration."""

import importlib.util
import json
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe import schemas
from lumenframe.config import Config
from lumenframe.functions import encoders, images
from lumenframe.functions import text as T
from lumenframe.operators import fusion, health, ingest
from lumenframe.sources import frame_map, logs, scan, sinks, video

from .test_extras import _png


def _results(spark, n):
    return spark.createDataFrame([(i + 1, f"v{i % 2}", f"{i:03d}", i, 0.9 - i / 100, f"k/{i}.jpg", f"because {i}") for i in range(n)], "rank int, folder string, image string, frame_id long, score double, file_path string, explanation string")


def test_frame_map_writers(spark):
    kept = spark.createDataFrame([("v", 5, 12.9, 25.0, 322, 1), ("v", 2, 1.23456, 25.0, 31, 0)], "folder string, pos int, pts_time double, fps double, frame_idx int, scene_id int")
    n = sinks.renumbered(kept)
    assert {r.frame_idx: r.n for r in n.collect()} == {31: 0, 322: 1}
    assert sorted(map(tuple, sinks.frame_map_v1(n).collect())) == [(0, 1, 25, 31), (1, 12, 25, 322)]
    assert sorted(map(tuple, sinks.frame_map_v2(n).collect())) == [(0, 1.235, 25, 31, 0), (1, 12.9, 25, 322, 1)]


def test_exports(spark, tmp_path):
    r = _results(spark, 12)
    one = json.loads(sinks.export_json(r, "t").first().value)
    assert one["total"] == 12 and [x["rank"] for x in one["results"]] == list(range(1, 13))
    done = sinks.export_files(r, f"file://{tmp_path}/out")
    assert spark.read.csv(done[0], header=True).count() == 12
    flat = [json.loads(x.value) for x in spark.read.text(done[1]).collect()]
    assert len(flat) == 12 and "explanation" not in flat[0]
    with pytest.raises(ValueError):
        sinks.export_files(r, f"file://{tmp_path}/out", ("xml",))


def test_spreadsheets_hold_all_rows(spark, tmp_path, monkeypatch):
    class Book:
        def __init__(self, write_only):
            self.sheets = []
            books.append(self)

        def create_sheet(self):
            self.sheets.append([])
            return self.sheets[-1]

        def save(self, path):
            self.path = path

    books = []
    monkeypatch.setitem(sys.modules, "openpyxl", type("openpyxl", (), {"Workbook": Book}))
    sinks.export_xlsx(_results(spark, 25), "x.xlsx", sheet_rows=10)
    assert [len(s) for s in books[0].sheets] == [11, 11, 6] and books[0].sheets[1][1][0] == 11


def test_submissions_get_a_free_name(spark, tmp_path):
    r = _results(spark, 120)
    paths = [sinks.write_submission(r, f"file://{tmp_path}", "query", a) for a in (None, " two ")]
    assert [p.rsplit("/", 1)[1] for p in paths] == ["query.csv", "query_1.csv"]
    text = (tmp_path / "query.csv").read_text()
    assert text.count("\n") == 99 and text.startswith("v0.csv,000\nv1.csv,001")
    assert (tmp_path / "query_1.csv").read_text().startswith('v0.csv,000,"two"')


def test_packages_check_what_they_read(spark, tmp_path):
    f = spark.createDataFrame([("v", i, [1.0], f"/x/keyframes/v/{i}.jpg") for i in (3, 1, 2)], "folder string, frame_id long, v array<double>, file_path string")
    sinks.check_before_write(f, f)
    with pytest.raises(ValueError, match="1 rows without metadata"):
        sinks.check_before_write(f, f.where("frame_id <> 2"))
    path = f"file://{tmp_path}/m"
    sinks.write_metadata(f, path, similar=f.select(F.col("frame_id").alias("src"), F.col("frame_id").alias("dst")))
    manifest, tables = sinks.load_metadata(spark, path, "/new")
    assert set(tables) == {"frames", "temporal", "similar"} and {(r.frame_id, r.prev_id) for r in tables["temporal"].collect()} == {(1, None), (2, 1), (3, 2)}
    assert {r.table: r["rows"] for r in sinks.package_info(spark, path).collect()} == {"frames": 3, "similar": 3, "temporal": 3}
    part = next((tmp_path / "m" / "manifest").glob("part-*"))
    said = part.read_text()
    next((tmp_path / "m" / "manifest").glob(".part-*.crc")).unlink()
    part.write_text(said.replace('"rows": 3', '"rows": 4', 1))
    with pytest.raises(ValueError, match="changed"):
        sinks.load_package(spark, path)
    part.write_text(said.replace('"version": 1', '"version": 7'))
    with pytest.raises(ValueError, match="version 7"):
        sinks.load_package(spark, path)


def test_bad_lines_do_not_stop_a_load(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"a": 1, "b": "x"}\nnot json\n\n{"a": "y"}\n{"b": "z"}\n')
    good, bad = sinks.tolerant_rows(spark, f"file://{tmp_path}/m.json", "a int, b string")
    assert sorted((r.a or 0, r.b) for r in good.collect()) == [(0, "z"), (1, "x")] and bad.count() == 2


def test_only_valid_images_are_scanned(spark, tmp_path):
    for folder in ("v", "empty"):
        (tmp_path / folder).mkdir()
    _png(tmp_path / "v" / "10.png", np.zeros((40, 40)))
    _png(tmp_path / "v" / "9.png", np.zeros((40, 40)))
    (tmp_path / "v" / "8.png").write_bytes(b"no image")
    (tmp_path / "empty" / "1.png").write_bytes(b"")
    assert [(r.folder, r.stem, r.pos) for r in scan.valid_files(spark, f"file://{tmp_path}").orderBy("pos").collect()] == [("v", "9", 0), ("v", "10", 1)]
    i = scan.images(spark, f"file://{tmp_path}")
    assert i.select(images.image_vector("data", "height", "width", "channels").alias("v")).first().v == [0.0] * 64
    half = np.zeros((32, 32))
    half[:, 16:] = 255
    assert np.dot(images.grid_vector(half), images.grid_vector(255 - half)) == pytest.approx(-1)


def test_missing_map_is_empty(spark, tmp_path):
    assert frame_map.read_map(spark, f"file://{tmp_path}/none.csv").collect() == []


def test_clean_up(spark, tmp_path):
    (tmp_path / "a.tmp").write_text("x")
    far = F.current_timestamp() + F.expr("interval 30 hours")
    assert scan.clean_up(spark, f"file://{tmp_path}", F.current_timestamp(), 24) == 0
    assert scan.clean_up(spark, f"file://{tmp_path}", far, 24) == 1 and (tmp_path / "a.tmp").exists()
    assert scan.clean_up(spark, f"file://{tmp_path}", far, 24, dry_run=False) == 1 and not (tmp_path / "a.tmp").exists()


def test_shares(spark):
    p = spark.createDataFrame([("/a",), ("/b.lumen",), ("/a",)], "path string")
    r = scan.shares(p, "n1")
    assert {(x.path, x.kind) for x in r.collect()} == {("/a", "folder"), ("/b.lumen", "index")} and all(len(x.share_id) == 12 for x in r.collect())
    both = scan.add_shares(r, scan.shares(p.unionByName(spark.createDataFrame([("/c",)], "path string")), "n2"))
    assert scan.shares_of(both, "n2").first().path == "/c" and scan.shares_of(both, "n1", "index").count() == 1
    assert scan.remove_shares(both, [r.where("path = '/a'").first().share_id]).count() == 2 and scan.remove_shares(both, []).count() == 3


def test_video_from_any_store(spark, tmp_path):
    (tmp_path / "byte_decoder.py").write_text("def decode(data):\n    for i in range(len(data)):\n        yield i * 500, 25, data[i : i + 1]\n")
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.MP4").write_bytes(b"xyz")
    (tmp_path / "in" / "b.txt").write_bytes(b"no")
    spark.sparkContext.addPyFile(str(tmp_path / "byte_decoder.py"))
    sys.path.insert(0, str(tmp_path))
    r = video.video_frames(spark, f"file://{tmp_path}/in", "byte_decoder:decode", batch=2).orderBy("frame_idx").collect()
    assert [(x.video, x.frame_idx, x.pts_time, bytes(x.image)) for x in r] == [("a", 0, 0.0, b"x"), ("a", 1, 0.5, b"y"), ("a", 2, 1.0, b"z")]


def test_configuration_is_checked_and_repaired():
    c = Config({"search": {"limit": -1, "mode": "x"}, "cache": {"query_ttl": 0}, "network": 7})
    bad = {p.split(":")[0] for p in c.problems()}
    assert {"search.limit", "search.mode", "cache.query_ttl", "network"} <= bad
    r = c.repaired()
    assert not r.problems() and r.get("search.limit") == 50 and r.get("network.node_timeout") == 300


def test_log_lines_round_trip(spark, tmp_path):
    e = spark.createDataFrame([("search", 1.5, "1700000000.0")], "operation string, duration double, timestamp string")
    line = e.select(logs.log_line(F.struct("operation", "duration", "timestamp"), F.timestamp_seconds(F.lit(0))).alias("value"))
    line.coalesce(1).write.text(f"file://{tmp_path}/log")
    assert [(r.operation, r.duration) for r in logs.performance_log(spark, f"file://{tmp_path}/log").collect()] == [("search", 1.5)]


def test_small_expressions(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(T.safe_text(F.lit("a\n\tb" + "c" * 200), 5)) == "a bcc..." and one(T.safe_text(F.lit(None).cast("string"))) == ""
    assert one(T.plural(F.lit(1), "frame")) == "1 frame" and one(T.plural(F.lit(0), "entry", "entries")) == "0 entries"
    assert one(T.query_key(F.lit("chào"))) == "vi_" + __import__("hashlib").md5("chào".encode()).hexdigest()
    assert one(T.log_message(F.lit("done"))) == "done" and one(T.parse_frame_key(F.lit("alone"))).asDict() == {"folder": "alone", "image": None}
    for text, want in {"['a:1','b:2']": ["a:1", "b:2"], '["a:1"]': ["a:1"], "a:1, b:2,": ["a:1", "b:2"], " a:1 ": ["a:1"], "NULL": [], "[]": [], "[broken": ["[broken"]}.items():
        assert one(T.frame_list(F.lit(text))) == want, text
    refs = one(T.frame_references(F.lit(",".join(f"v:{i}" for i in range(9)))))
    assert [r.frame for r in refs] == ["0", "1", "2", "3", "4"]


def test_ranks_without_a_limit_equal_those_with_one(spark):
    rows = spark.createDataFrame([("v", i, float((i * 7) % 50)) for i in range(400)], "folder string, frame_id long, score double").repartition(6)
    want = {r.frame_id: r["rank"] for r in fusion.rank_results(rows, 400).collect()}
    assert {r.frame_id: r["rank"] for r in fusion.rank_results(rows).collect()} == want
    assert fusion.rank_results(rows.limit(0)).collect() == []


def test_results_whose_file_is_gone(spark):
    r = _results(spark, 4)
    assert fusion.validate(r, spark.createDataFrame([("k/1.jpg",), ("k/3.jpg",)], "path string")).count() == 2


def test_lookups_batches_and_unique_ids(spark):
    f = spark.createDataFrame([("v", i) for i in range(70)] + [("w", 1)], "folder string, frame_id long")
    assert ingest.lookup(f, "v", 3).count() == 1
    assert {(r.folder, r.batch): r["count"] for r in ingest.batches(f).groupBy("folder", "batch").count().collect()} == {("v", 0): 32, ("v", 1): 32, ("v", 2): 6, ("w", 0): 1}
    with pytest.raises(ValueError):
        health.assert_unique(f, "frame_id")
    nodes = spark.createDataFrame([("a",), ("b",), ("c",)], "node_id string")
    assert {r.node_id for r in health.prune_offline(nodes, nodes.where("node_id <> 'c'"), "a").collect()} == {"a", "c"}


def test_second_model_keeps_lengths(spark):
    class Long(encoders.HashingEncoder):
        def encode(self, items):
            return [None if v is None else 2 * v for v in super().encode(items)]

    d = spark.createDataFrame([("red car",)], "t string")
    v = d.select(encoders.encode_column(F.col("t"), Long, normalise=False).alias("v")).first().v
    assert np.dot(v, v) == pytest.approx(4)
    assert schemas.KEYFRAME.fieldNames()[0] == "folder_name"


def test_pictures_say_what_they_need(spark):
    d = spark.createDataFrame([(b"x",)], "content binary")
    made = d.select(images.thumbnail("content").alias("t"), images.encode_jpeg("content").alias("j"))
    if importlib.util.find_spec("PIL") is None:
        with pytest.raises(Exception, match="Pillow"):
            made.collect()
    else:
        assert made.first().t is None and made.first().j is None
