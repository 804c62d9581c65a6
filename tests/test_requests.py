"""The service's requests, caches, backends and agent tools."""

import json

import pytest
from pyspark.sql import functions as F

from lumenframe import schemas
from lumenframe.operators import search
from lumenframe.plans import cache, service
from lumenframe.streaming import stateful


@pytest.fixture(scope="module")
def frames(spark, sf):
    return schemas.frames(spark, sf)


@pytest.fixture(scope="module")
def whole(spark, frames):
    docs = spark.createDataFrame([("car_1", 1, ["Dog"], ["cat"], "a dog runs"), ("x", 2, [], [], "none")], "folder string, frame_id long, tags array<string>, objects array<string>, description string")
    row = {f.name: None for f in schemas.KEYFRAME} | {"folder_name": "0", "image_name": "7", "file_path": "k/0/7.jpg", "frame_id": 7, "scene_tags": ["a"], "similar_frames": ["x", "y"]}
    metadata = spark.createDataFrame([tuple(row[f.name] for f in schemas.KEYFRAME)], schemas.KEYFRAME)
    return service.SearchService(frames, docs=docs, metadata=metadata)


def test_every_request_has_an_answer(whole):
    assert {r.key for r in whole.handle("semantic_search", {"semantic_query": "dog car"}).collect()} == {"rank1"}
    t = whole.handle("translate", {"text": "xin chào"}).first()
    assert (t.translated, t.confidence, t.language) == ("xin chào", 0.1, "vi")
    c = whole.handle("chat", {"question": "a dog"}).first()
    assert c.answer.startswith("Found 10 frames") and len(c.frames) == 10 and "-" in c.frames[0]
    assert whole.handle("chat", {"question": "hello"}).first().frames == []
    m = whole.handle("metadata", {"folder_name": "0", "image_name": "7", "detail_level": "rich", "include_relationships": True}).first()
    assert m.similar_frames_count == 2 and m.transition_frames_count == 0 and isinstance(m.similar, list)
    assert whole.handle("metadata", {"folder_name": "0", "image_name": "7", "detail_level": "minimal"}).columns == ["folder_name", "image_name", "frame_id"]
    with pytest.raises(KeyError):
        whole.handle("metadata", {"folder_name": "0", "image_name": "none"})
    stats = {r.folder: r.frames for r in whole.handle("stats", {}).collect()}
    assert stats[None] == sum(v for k, v in stats.items() if k is not None)
    assert whole.handle("image_search", {"folder_name": "0", "image_name": "7", "limit": 2, "detail_level": "minimal"}).count() == 2


def test_modes_differ(frames):
    s = service.SearchService(frames, expand=lambda text: [text, "blue sea"])
    ids = {m: {r.frame_id for r in s.search("dog car", mode=m, limit=6, include_temporal_context=False).collect()} for m in (*search.MODES, *search.MODE_NAMES)}
    assert ids["vector"] == ids["clip_only"] and ids["semantic"] == ids["llm_enhanced"] != ids["vector"]
    both = [{r.frame_id for r in s.search(q, mode="vector", limit=3).collect()} for q in ("dog car", "blue sea")]
    assert ids["semantic"] == both[0] | both[1]
    with pytest.raises(ValueError, match="docs"):
        s.handle("semantic_search", {"semantic_query": "dog"})


def test_results_are_cached_by_all_options(spark, frames):
    now = [0.0]
    c = cache.ResultCache(spark, ttl=10, clock=lambda: now[0])
    heard = []
    s = service.SearchService(frames, cache=c, translate=lambda t: heard.append(t) or (t, 0.1))
    a = sorted(map(str, s.search("red car", limit=4).collect()))
    assert sorted(map(str, s.search("red car", limit=4).collect())) == a and heard == ["red car"]
    s.search("red car", limit=5)
    assert len(heard) == 2
    now[0] = 10.0  # exactly the time to live: no longer fresh
    s.search("red car", limit=4)
    r = c.stats().first()
    assert len(heard) == 3 and (r.requests, r.hits) == (4, 1) and c.used() > 0 and not r.low_hit_rate
    assert c.expire(older_than=0) == 2 and not c.entries


def test_the_least_recently_used_result_goes_first(spark):
    c = cache.ResultCache(spark, budget=1)
    for i in range(3):
        c.put((i,), spark.range(i, i + 5))
    assert list(c.entries) == [(2,)] and c.get((2,)).count() == 5 and c.get((0,)) is None


def test_backends(spark, frames):
    assert service.choose_backend({"memory": frames}) == "memory" and service.choose_backend({"memory": frames, "remote": len}) == "remote"
    with pytest.raises(ValueError):
        service.choose_backend({})
    said = json.dumps([{"metadata": {"folder_name": "v", "image_name": "1.jpg", "frame_id": i, "file_path": "p"}, "similarity_score": 0.9 - i / 10} for i in range(4)])
    far = service.SearchService(None, remote=lambda vector, limit: said)
    assert [r.frame_id for r in far.search("a dog", similarity_threshold=0.75).orderBy("rank").collect()] == [0, 1]
    assert far.chat("a dog").first().answer == "Found 4 frames in folders: v"
    assert [r["rank"] for r in service.remote_rows(spark, said, 2).collect()] == [1, 2]
    near = service.SearchService(None, container=frames.where("folder = 0"))
    assert near.backend() == "container" and near.search("x", limit=3).where("folder <> 0").count() == 0


def test_translations_are_cached_and_failures_pass_through():
    now, asked = [0.0], []

    def up(text):
        asked.append(text)
        if text == "bad":
            raise RuntimeError("no service")
        return text.upper()

    t = service.Translator(up, ttl=5, clock=lambda: now[0])
    assert [t("a"), t("a"), t("bad"), t(" ")] == [("A", 0.9), ("A", 0.9), ("bad", 0.1), (" ", 0.0)]
    now[0] = 5.0
    assert t("a") == ("A", 0.9) and asked == ["a", "bad", "a"] and service.Translator()("x") == ("x", 0.1)


def test_agent_tools(whole):
    tools = service.AgentTools(whole)
    assert tools.search_frames("a dog", 3).count() == 3
    folder = whole.frames.where("frame_id = 7").first().folder
    got = {r.frame: r.problem for r in tools.analyse_frames(f"['{folder}:7', '{folder}:99999', 'x']").collect()}
    assert got["7"] is None and got["99999"].startswith("unknown frame") and got[None].startswith("not a folder")
    assert tools.status().first().backend == "memory"
    assert tools.chat("what is this", f"{folder}:7").first().answer == f"Found 1 frame in folders: {folder}"
    assert len(tools.chat("a dog", "none").first().frames) == 10


def test_quick_search_and_strategies(spark, frames):
    files = spark.createDataFrame([("v", 1, b"red car"), ("v", 2, b"blue sea"), ("w", 3, b"\xff\xfe\x00\x01")], "folder string, frame_id long, content binary")
    assert service.quick_search(files, "red car", 1).first().frame_id == 1
    vector = search.vector_of(frames, 7)
    exact = [r.frame_id for r in search.VectorIndex(frames).build().search(vector, 5).orderBy("rank").collect()]
    for strategy in ("exact_l2", "hnsw", "lsh", "kmeans_cells"):
        index = search.VectorIndex(frames, strategy, cells=4).build()
        assert len(set(exact) & {r.frame_id for r in index.search(vector, 5).collect()}) >= 4
        q = frames.where("frame_id = 7").select(F.col("frame_id").alias("query_id"), "v")
        assert len(set(exact) & {r.frame_id for r in index.search_batch(q, 5).collect()}) >= 4
    with pytest.raises(ValueError):
        search.VectorIndex(frames, "none")
    with pytest.raises(ValueError, match="duplicate"):
        search.VectorIndex(frames.union(frames)).build()


def test_tiered_cache_model():
    c = stateful.TieredCache(10, 2, 2)
    assert [c.request(k, t) for k, t in (("a", 0), ("b", 1), ("c", 2), ("a", 3), ("a", 4), ("b", 12), ("d", 12))] == ["miss", "miss", "miss", "disk", "memory", "miss", "miss"]
    sized = stateful.TtlCache(10, 5)
    assert [sized.request("a", 0, 3), sized.request("b", 0, 3), sized.request("a", 1, 3), sized.request("c", 1, 9)] == [False, False, False, False] and sized.used == 0
