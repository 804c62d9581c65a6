"""Size of the search tables, and that a worker builds them once."""

import tracemalloc

import numpy as np
import pytest

from lumenframe.llm import decontaminate


@pytest.mark.parametrize(("vocabulary", "items"), [(3_000, 100), (10**9, 100), (20_000, 1200), (10**9, 600)])
def test_tables_stay_within_the_bound(vocabulary, items):
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(f"w{x}" for x in rng.integers(vocabulary, size=500))) for i in range(items)]
    distinct = len({w for _, t in rows for w in t.split()})
    tracemalloc.start()
    s = decontaminate.Searcher(rows, 10)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < decontaminate.table_size(500 * items, distinct)
    spans, found = s.find(decontaminate.words("x y " + rows[7][1][:300].rsplit(" ", 1)[0] + " z"))
    assert found == {"7"} and len(spans) == 1


def test_blocks_follow_the_bound():
    big = 256 << 20
    assert decontaminate.blocks_needed(0, 0, big) == decontaminate.blocks_needed(60_000, 9_000, big) == 1
    for words, distinct in ((5_000_000, 100_000), (5_000_000, 5_000_000), (10**9, 10**7)):
        n = decontaminate.blocks_needed(words, distinct, big)
        assert decontaminate.table_size(words, distinct, n) <= big < decontaminate.table_size(words, distinct, n - 1)


def test_a_worker_builds_a_block_once(monkeypatch):
    class Rows:
        value = [(1, "a b c")]

    made = []
    monkeypatch.setattr(decontaminate, "Searcher", lambda *a: made.append(a) or len(made))
    assert [decontaminate._built(b, Rows, 10) for b in ("p", "p", "q", "q")] == [1, 1, 2, 2]


def test_blocks_of_one_benchmark_agree(spark, sf):
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    whole = decontaminate.digest(decontaminate.decontaminate(docs, bench))
    parts = decontaminate.digest(decontaminate.decontaminate(docs, bench, table_bytes=(20 << 20) + 600_000))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, parts.collect()))


def _workers() -> int:
    import psutil

    found = 0
    for x in psutil.Process().children(recursive=True):
        try:
            found += "pyspark.daemon" in " ".join(x.cmdline())
        except psutil.Error:
            pass
    return found


def test_twenty_blocks_are_searched_one_after_the_other(spark, sf, monkeypatch):
    """No worker holds two blocks, no stage more workers than task slots, the driver one block's items at a time."""
    import threading

    docs, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    monkeypatch.setattr(decontaminate, "blocks_needed", lambda *a: 20)
    sent, seen, over = [], [], threading.Event()
    plain = decontaminate._sent

    class Sent:
        alive = 0

        def __init__(self, block):
            self.inner = plain(block)
            Sent.alive += 1
            sent.append(Sent.alive)

        def __reduce__(self):
            return self.inner.__reduce__()

        def destroy(self):
            Sent.alive -= 1
            self.inner.destroy()

    monkeypatch.setattr(decontaminate, "_sent", Sent)

    def watch():
        while not over.wait(0.2):
            seen.append(_workers())

    before = _workers()
    t = threading.Thread(target=watch)
    t.start()
    parts = decontaminate.digest(decontaminate.decontaminate(docs, bench))
    rows = sorted(map(tuple, parts.collect()))
    over.set()
    t.join()
    assert len(sent) == 20 and max(sent) == 1 and Sent.alive == 0
    # the session has four task slots, and a daemon that starts the workers
    assert max(seen) <= max(before, 2 * 4 + 1)
    assert parts._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 0
    monkeypatch.undo()
    assert rows == sorted(map(tuple, decontaminate.digest(decontaminate.decontaminate(docs, bench)).collect()))


def test_blocks_on_awkward_rows(spark, monkeypatch):
    """Null and repeated ids, empty texts, touching and overlapping hits of several blocks, clashing names."""
    items = [(f"i{k}", t) for k, t in enumerate(["a b c d e f g h i j", "c d e f g h i j k l m", "x y", "y z", "x y z", "solo", "solo", "", None])] + [(None, "a b")]
    texts = ["q a b c d e f g h i j k l m q", "x y z x y", "solo SOLO, solo", "", None, "x y", "none of them", "z y x y z " * 400]
    rows = [(i % 6 if i % 4 else None, t, i) for i, t in enumerate(texts * 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, hits int").withColumnRenamed("hits", "n_words")
    bench = spark.createDataFrame(items, "item_id string, text string")
    want = decontaminate.brute([(k, t) for k, (_, t, _) in enumerate(rows)], [x for x in items if x[0] is not None and x[1] is not None])
    monkeypatch.setattr(decontaminate, "blocks_needed", lambda *a: 5)
    got = decontaminate.digest(decontaminate.decontaminate(docs, bench)).collect()
    assert sorted(tuple(map(str, r)) for r in got) == sorted(tuple(map(str, (rows[k][0], *want[k]))) for k in want)
    kept = decontaminate.drop_contaminated(docs, bench)
    assert sorted(map(str, kept.collect())) == sorted(str(r) for k, r in enumerate(docs.collect()) if not want[k][4])
    assert decontaminate.drop_contaminated(docs.limit(0), bench).count() == 0
