import pytest
from pyspark.sql import functions as F

from lumenframe import schemas
from lumenframe.operators import reduce, temporal
from lumenframe.streaming import stateful, windows


def _run(df, tmp_path, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return df.sparkSession.table(name)


@pytest.fixture
def stream(spark, tmp_path):
    def make(df, files=1, order=None):
        path = str(tmp_path / "in")
        (df.orderBy(order) if order else df).coalesce(files).write.parquet(path)
        return spark.readStream.schema(df.schema).parquet(path)

    return make


def test_rate_limit_boundaries():
    assert stateful.admit([0.0], 60.0, 1, 60.0) == (False, [0.0])  # exactly as old as the window: still counts
    assert stateful.admit([0.0], 60.001, 1, 60.0) == (True, [60.001])
    assert stateful.admit([0.0, 1.0], 2.0, 2, 60.0) == (False, [0.0, 1.0])  # rejected requests are not recorded


def test_rate_limit_stream_equals_batch(spark, sf, tmp_path, stream):
    e = schemas.performance(spark, sf).where("client < 20").select("client", "event_id", (F.unix_micros("ts") / 1e6).alias("t"))
    got = _run(stateful.rate_limit_stream(stream(e), 2, 43_200.0), tmp_path, "limited")
    want = stateful.rate_limit(e, 2, 43_200.0)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_last_kept_stream_equals_batch(spark, sf, tmp_path, stream):
    f = schemas.frames(spark, sf)
    got = _run(stateful.last_kept_stream(stream(f), 0.05), tmp_path, "kept")
    want = reduce.last_kept_dedup(temporal.ordered(f), 0.05)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_windows_stream_equals_batch(spark, sf, tmp_path, stream):
    e = schemas.performance(spark, sf)
    got = _run(windows.latency_windows(stream(e), "1 day"), tmp_path, "win", "complete")
    assert sorted(map(str, got.collect())) == sorted(map(str, windows.latency_windows(e, "1 day").collect()))


def test_registry_and_content(spark, tmp_path, stream):
    a = spark.createDataFrame([("n1", 1, "up"), ("n1", 3, "down"), ("n2", 2, "up")], "node_id string, last_seen int, status string")
    got = _run(windows.registry_updates(stream(a)), tmp_path, "reg", "complete")
    assert {(r.node_id, r.last_seen, r.status) for r in got.collect()} == {("n1", 3, "down"), ("n2", 2, "up")}


def test_session_gap_equality(spark):
    rows = [(1, "2024-01-01 00:00:00"), (1, "2024-01-01 06:00:00"), (1, "2024-01-01 12:00:01")]
    e = spark.createDataFrame(rows, "client int, s string").withColumn("ts", F.to_timestamp("s"))
    assert sorted(r.n for r in windows.sessions(e, "6 hours").collect()) == [1, 2]


def test_cache_model():
    c = stateful.TtlCache(10, 2)
    assert [c.request(k, t) for k, t in (("a", 0), ("a", 9), ("b", 9), ("a", 10), ("c", 11), ("b", 12), ("c", 12))] == [False, True, False, False, False, False, True]


def test_silent_nodes_go_offline(spark, tmp_path):
    stamp = "2024-01-01 00:{:02d}:00"
    days = [[("a", stamp.format(0), "up"), ("b", stamp.format(0), "up"), ("me", stamp.format(0), "up")], [("a", stamp.format(4), "busy")], [("a", stamp.format(9), "up")], [("a", stamp.format(12), "up")]]
    path = tmp_path / "said"
    schema = "node_id string, last_seen timestamp, status string"
    for i, rows in enumerate(days):
        part = spark.createDataFrame(rows, "node_id string, s string, status string").select("node_id", F.to_timestamp("s").alias("last_seen"), "status").coalesce(1)
        part.write.parquet(str(tmp_path / f"one{i}"))
        path.mkdir(exist_ok=True)
        source = next((tmp_path / f"one{i}").glob("*.parquet"))
        target = path / f"{i}.parquet"
        target.write_bytes(source.read_bytes())
        __import__("os").utime(target, (1_700_000_000 + i, 1_700_000_000 + i))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path))
    got = _run(stateful.registry_stream(stream, "300 seconds", self_id="me"), tmp_path, "nodes").collect()
    seen = [(r.node_id, r.status, r.online) for r in got]
    assert ("b", "up", False) in seen and ("a", "up", True) in seen and not any(n == "me" for n, _, _ in seen)
    assert not any(n == "a" and not online for n, _, online in seen)


def test_recent_durations_and_new_content(spark, tmp_path, stream):
    e = spark.createDataFrame([("s", float(i), float(i)) for i in range(10)], "operation string, duration double, t double")
    got = _run(stateful.recent_durations(stream(e), 4), tmp_path, "recent", "update").collect()
    assert [(r.n, r["mean"], r.most) for r in got] == [(4, 7.5, 9.0)]


def test_new_content_is_seen_once(spark, tmp_path, stream):
    f = spark.createDataFrame([("a", "h1"), ("b", "h1"), ("c", "h2")], "path string, hash string").withColumn("mtime", F.lit("2024-01-01").cast("timestamp"))
    assert _run(windows.new_content(stream(f), "1 hour"), tmp_path, "fresh").count() == 2
    assert windows.new_content(f).count() == 2
