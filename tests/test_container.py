"""Containers: chunks, resuming, both layouts, health, bytes."""

import pytest
from pyspark.sql import functions as F

from lumenframe import storage
from lumenframe.operators import search
from lumenframe.sources import container


def _files(spark, n, first=0):
    rows = [(f"/k/v{i % 2}/{i:03d}.jpg", f"h{i}", f"v{i % 2}", f"{i:03d}", f"red car {i % 5}".encode()) for i in range(first, n)]
    return spark.createDataFrame(rows, "path string, hash string, folder string, stem string, content binary")


def test_build_resume_and_load(spark, tmp_path):
    path, steps = f"file://{tmp_path}/c", []
    said, rows = container.build_system(_files(spark, 20), path, chunk_rows=6, commit_chunks=2, progress=lambda *a: steps.append(a))
    assert said["rows"] == 20 and said["chunks"] >= 2 and said["folders"] == 2 and said["dimension"] == 64
    assert steps[0] == (1, 6, "scan") and steps[-1] == (6, 6, "finalise")
    assert container.healthy(spark, path) and container.remaining(_files(spark, 25), path).count() == 5
    said, rows = container.build_system(_files(spark, 25), path, chunk_rows=6)
    assert said["rows"] == 25 == rows.select("hash").distinct().count()
    assert container.picture(rows, "v1", 3) == b"red car 3" and container.picture(rows, "v1", 99) is None
    found = search.topk(rows, rows.where("frame_id = 3").first().v, 4)
    assert container.results(found).columns == list(container.RESULT_KEYS)


def test_an_interrupted_build_goes_on(spark, tmp_path):
    path = f"file://{tmp_path}/c"
    few = container.ingest.attach_frame_ids(_files(spark, 7), spark.createDataFrame([], "folder string, stem string, frame_id long"))
    container.append_chunk(container.encoders.with_embeddings(few, "content", container.encoders.HashingEncoder), path, "c00000-00000")
    container.append_chunk(container.encoders.with_embeddings(few, "content", container.encoders.HashingEncoder), path, "c00000-00000")
    assert container.manifest(spark, path) is None and not container.healthy(spark, path)
    assert container.stored_chunks(spark, path).count() == 7  # a repeated append adds nothing
    said, rows = container.build_system(_files(spark, 12), path)
    assert said["rows"] == 12 and rows.where("chunk = 'c00000-00000'").count() == 7


def test_layouts_versions_and_lost_rows(spark, tmp_path):
    path = f"file://{tmp_path}/flat"
    with pytest.raises(FileNotFoundError):
        container.load(spark, path)
    with pytest.raises(ValueError, match="no files"):
        container.build(_files(spark, 0).withColumn("frame_id", F.lit(1)), path)
    _files(spark, 4).withColumn("v", F.array(F.lit(1.0))).write.parquet(f"{path}/frames")
    said, rows = container.load(spark, path)
    assert said["version"] == 1 and rows.count() == 4
    storage.write_file(spark, f"{path}/manifest.json", '{"version": 9, "rows": 4}')
    with pytest.raises(ValueError, match="version"):
        container.load(spark, path)
    storage.write_file(spark, f"{path}/manifest.json", '{"version": 2, "rows": 5}')
    with pytest.raises(ValueError, match="5 rows"):
        container.load(spark, path)
    assert not container.healthy(spark, path)


def test_progressive_parts_cover_all_rows(spark):
    f = spark.range(95).withColumnRenamed("id", "frame_id").repartition(3)
    parts = [sorted(r.frame_id for r in p.collect()) for p in container.progressive(f, 20)]
    assert sum(parts, []) == list(range(95)) and len(parts) >= 4
    assert [p.count() for p in container.progressive(f.limit(0), 20)] == [0]


def test_files_are_written_whole(spark, tmp_path):
    path = f"file://{tmp_path}/x.json"
    with pytest.raises(ValueError):
        storage.write_file(spark, path, "")
    storage.write_file(spark, path, "one")
    storage.write_file(spark, path, "two é")
    assert (tmp_path / "x.json").read_text() == "two é" and not list(tmp_path.glob("*.tmp"))
    copy = storage.backup(spark, path, "s1")
    assert storage.exists(spark, copy) and (tmp_path / "x.json.s1.bak").read_text() == "two é"
    assert storage.delete(spark, copy) and not storage.exists(spark, copy)


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, *_):
            return None

    class Fake:
        conf = Conf()

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        storage.shared_path(Fake())


def test_images_are_recovered_from_bytes_or_paths(spark, tmp_path):
    _, rows = container.build_system(_files(spark, 3), f"file://{tmp_path}/c")
    wanted = spark.createDataFrame([("v1", 1, "/gone/keyframes/v1/001.jpg"), ("v9", 9, "/gone/keyframes/v9/9.jpg"), ("v9", 10, "/none/10.jpg")], "folder string, frame_id long, path string")
    there = spark.createDataFrame([("/new/keyframes/v9/9.jpg",)], "path string")
    got = {r.frame_id: (r.content and bytes(r.content), r.resolved) for r in container.recover_images(wanted, rows, there, ["/new"]).collect()}
    assert got == {1: (b"red car 1", None), 9: (None, "/new/keyframes/v9/9.jpg"), 10: (None, None)}
    assert container.recover_images(wanted, None, there, ["/new"]).where("content is null").count() == 3


def test_files_are_read_once_for_all_commits(spark, tmp_path):
    """The listing with its bytes is evaluated as often for ten commits as for one."""
    files = container.ingest.attach_frame_ids(_files(spark, 40), spark.createDataFrame([], "folder string, stem string, frame_id long"))
    read = []
    for name, commit in (("one", 10), ("ten", 1)):
        seen = spark.sparkContext.accumulator(0)

        def count(batches, seen=seen):
            for b in batches:
                seen.add(b.num_rows)
                yield b

        said = container.build(files.mapInArrow(count, files.schema), f"file://{tmp_path}/{name}", chunk_rows=4, commit_chunks=commit)
        assert said["rows"] == 40 and said["chunks"] > 5
        read.append(seen.value)
    assert read[0] == read[1]
