"""The row that stays of each component, whatever ids repeat."""

from itertools import permutations

from lumenframe.llm import simhash

A, B = "the quick brown fox jumps over the lazy dog again and again", "quite another text about rivers and mountains of the far north"


def test_equal_ids_of_different_texts_in_every_order(spark):
    """(3, A), (7, A), (7, B) in six orders at once: each with ids and texts of its own."""
    rows, want = [], []
    for k, order in enumerate(permutations(range(3))):
        a, b = (f"{t} in the {'first second third fourth fifth sixth'.split()[k]} of the orders " + f"word{k} " * 9 + t[:: -1 if k % 2 else 1] for t in (A, B))
        own = [(100 * k + 3, a), (100 * k + 7, a), (100 * k + 7, b)]
        rows += [own[i] for i in order]
        want += [(100 * k + 3, a), (100 * k + 7, b)]
    fps = [simhash.fingerprint(t) for _, t in want]
    assert all((x ^ y).bit_count() > 3 for i, x in enumerate(fps) for y in fps[:i])
    d = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert sorted(tuple(r) for r in simhash.keep_one(d).collect()) == sorted(want)


def test_rows_equal_a_plain_choice(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    extra = [(rows[0][0], rows[5][1]), (None, rows[1][1]), (None, "only here without an id, and twice so"), (None, "only here without an id, and twice so"), (None, None), (5000, ""), rows[2], rows[2], (rows[3][0], B)]
    rows += extra
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    fps = [simhash.fingerprint(t) for _, t in rows]
    label = list(range(len(rows)))
    while True:
        new = [min(label[j] for j in range(len(rows)) if (fps[i] ^ fps[j]).bit_count() <= 3) for i in range(len(rows))]
        if new == label:
            break
        label = new
    want = sorted(min((i is None, i or 0) for (i, _), own in zip(rows, label, strict=True) if own == c) for c in set(label))
    got = simhash.keep_one(d)
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got.collect()) == want
    again = simhash.keep_one(got)
    assert again.count() == got.count() == len(want)


def test_texts_are_not_shuffled(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    got = simhash.keep_one(d)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert got.columns == d.columns and "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan
    big = max(len(line) for line in plan.splitlines() if "Exchange" in line)
    assert all("_c1" not in line for line in plan.splitlines() if "Exchange" in line), big
    assert simhash.keep_one(d.limit(0)).count() == 0
