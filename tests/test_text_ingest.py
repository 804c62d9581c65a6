from pyspark.sql import functions as F

from lumenframe.functions import text as T
from lumenframe.operators import health, ingest
from lumenframe.sources import frame_map, scan, sinks


def _one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first().x


def test_languages(spark):
    texts = {"你好": "zh", "こんにちは": "ja", "안녕": "ko", "สวัสดี": "th", "xin chào": "vi", "hello": "en", "  ": "en"}
    df = spark.createDataFrame([(t, w) for t, w in texts.items()], "t string, w string")
    assert df.where(T.detect_language(F.col("t")) != F.col("w")).count() == 0


def test_dictionary_order_preempts_longer_phrases(spark):
    assert _one(spark, T.translate_dictionary(F.col("t"), T.VIETNAMESE), t="người đàn ông") == "people đàn ông"


def test_query_confidence(spark):
    q = T.structured_query(F.col("t"), T.VIETNAMESE)
    assert _one(spark, T.effective_prompt(F.col("t"), q), t="màu đỏ") == "red"
    assert _one(spark, T.effective_prompt(F.col("t"), q, strict=True), t="màu đỏ") == "màu đỏ"


def test_semantic_score(spark):
    score = T.semantic_score(T.terms(F.col("q")), F.array(F.lit("Car"), F.lit("red car")), F.array(F.lit("dog")), F.lit("a car runs"), F.lit("car_01"))
    assert abs(_one(spark, score, q="CAR dog car") - (0.4 + 0.5 + 0.3 + 0.2)) < 1e-9


def test_label_blocks(spark):
    text = "intro [a]: first. Frame b: second. c: third"
    names = F.array(*[F.lit(x) for x in "abc"])
    get = lambda n: _one(spark, T.label_block(F.col("t"), F.lit(n), names, F.lit("none")), t=text)
    assert (get("a"), get("b"), get("c")) == ("first.", "second.", "third")
    assert _one(spark, T.label_block(F.col("t"), F.lit("z"), names, F.lit("none")), t=text) == "none"


def test_frame_ids(spark):
    rows = [("12", None, 12), ("a7b09", None, 9), ("abc", None, -1), ("12", 5, 5), ("12", -1, 12)]
    df = spark.createDataFrame(rows, "n string, m int, w long")
    assert df.where(T.frame_id(F.col("n"), F.col("m")) != F.col("w")).count() == 0
    assert _one(spark, T.fallback_frame_id(F.col("n")), n="x") == _one(spark, T.fallback_frame_id(F.col("n")), n="x")


def test_relative_paths(spark):
    rows = [("/a/keyframes/v/1.jpg", "keyframes/v/1.jpg"), ("C:\\x\\v\\1.jpg", "keyframes/v/1.jpg"), ("1.jpg", "1.jpg")]
    df = spark.createDataFrame(rows, "p string, w string")
    assert df.where(T.relative_path(F.col("p")) != F.col("w")).count() == 0


def test_changes_and_empty_ratio(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, hash string")
    new = spark.createDataFrame([("a", "1"), ("b", "9"), ("d", "3")], "path string, hash string")
    c = ingest.detect_changes(new, old)
    assert {r.path: r.change for r in c.collect()} == {"a": "unchanged", "b": "modified", "c": "deleted", "d": "new"}
    assert {r.path for r in ingest.pending(new, old).collect()} == {"b"}  # d is known content under a new path
    assert ingest.change_ratio(c.limit(0)).first().ratio == 0.0


def test_frame_map_readers(spark, tmp_path):
    def read(name, text):
        p = tmp_path / name
        p.write_text(text)
        return {r.image: r.frame_id for r in frame_map.read_map(spark, str(p)).collect()}

    assert read("v1.csv", "n,pts_time,fps,frame_idx\n1,0,25,10\n2,1,25,-3\n2,1,25,30\n,1,25,40\n") == {"001": 10, "002": 30}
    assert read("v2.csv", "image,frame\nabc,7\nnan,8\n1234,\n") == {"abc": 7, "1234": 3}
    assert read("h4.csv", "1,0,25,10\n2,0,25,20\n") == {"001": 10, "002": 20}
    assert read("h2.csv", "1,10\n2,20\n") == {"001": 10, "002": 20}
    assert read("empty.csv", "") == {}


def test_scan_orders_numbers_and_inventory(spark, tmp_path):
    for folder, names in {"a": ["10.jpg", "2.jpg", "x.txt"], "b": ["10.jpg", "2x.jpg"]}.items():
        (tmp_path / folder).mkdir()
        for n in names:
            (tmp_path / folder / n).write_bytes(b"data" + n.encode())
    f = scan.keyframe_files(spark, str(tmp_path)).orderBy("folder", "pos").collect()
    assert [(r.folder, r.name) for r in f] == [("a", "2.jpg"), ("a", "10.jpg"), ("b", "10.jpg"), ("b", "2x.jpg")]
    i = scan.inventory(spark, str(tmp_path)).collect()
    assert {r.path for r in i} == {"a/2.jpg", "a/10.jpg", "b/10.jpg", "b/2x.jpg"} and all(len(r.hash) == 16 for r in i)


def test_package_round_trip(spark, tmp_path):
    t = spark.createDataFrame([(1, "/x/keyframes/v/1.jpg")], "frame_id long, file_path string")
    m = sinks.write_package({"frames": t}, str(tmp_path / "p"), dimension=64)
    assert m["tables"]["frames"]["rows"] == 1
    info, tables = sinks.load_package(spark, str(tmp_path / "p"), "/new")
    assert info["dimension"] == 64 and tables["frames"].first().file_path == "/new/keyframes/v/1.jpg"


def test_submission_lines(spark):
    r = spark.createDataFrame([("L01_V001", "0123", 1)], "folder string, image string, rank int")
    assert sinks.submission_lines(r).first().line == "L01_V001.csv,0123"
    assert sinks.submission_lines(r, " two ").first().line == 'L01_V001.csv,0123,"two"'


def test_health(spark):
    k = spark.createDataFrame([("v", "i", "p", 1), ("", "i", "p", 1), ("v", None, "p", 1)], "folder_name string, image_name string, file_path string, frame_id long")
    assert [r.ok for r in k.select(health.valid_keyframe().alias("ok")).collect()] == [True, False, False]
    checks = spark.createDataFrame([("a", "c1", True, ""), ("b", "c2", False, "missing rows")], "component string, check string, ok boolean, issue string")
    r = health.rollup(checks).first()
    assert (r.healthy, r.issues, r.health_rate, r.recovery) == (False, "b: missing rows", 0.5, "rebuild")
