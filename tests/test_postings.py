"""Tag search by postings against the scalar form, over every row and query."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.functions import text as T
from lumenframe.operators import postings


def _rows(spark, seed, n=400):
    rng = np.random.default_rng(seed)
    common, rare = [f"c{i}" for i in range(4)], [f"r{i}" for i in range(60)]
    pick = lambda of, k: [str(x) for x in rng.choice(of, min(k, len(of)), replace=False)]
    rows = [(i, pick(common, 2) + pick(rare, 2), pick(rare, int(rng.integers(3))), " ".join(pick(common, 4) + pick(rare, int(rng.integers(6)))), "_".join(pick(rare, 2))) for i in range(n)]
    rows += [(n, None, None, None, None), (n + 1, [], ["C0", "C0"], "  ", ""), (n + 2, [None, "c1"], [], "C1 c1\tr2", "r2_R2")]
    d = spark.createDataFrame(rows, "doc_id long, tags array<string>, objects array<string>, description string, folder string")
    return d.select("doc_id", T.semantic_parts(F.col("tags"), F.col("objects"), F.col("description"), F.col("folder")).alias("parts"))


QUERIES = [(1, ["c0", "c1", "r1", "r2"]), (2, ["c0"]), (3, ["r5", "r6", "r7", "c3", "c2", "c1", "c0"]), (4, []), (5, ["nowhere"]), (6, ["r9", "r9", None]), (7, None)]


def _plain(rows, queries, threshold, k):
    scored = rows.crossJoin(queries.withColumn("t", F.filter(F.array_distinct("t"), lambda x: x.isNotNull()))).withColumn("score", T.parts_score(F.col("t"), F.col("parts"))).where(F.col("score") >= threshold).collect()
    out = []
    for q in {r.item for r in scored}:
        some = sorted(((-round(r.score, 6), r.doc_id) for r in scored if r.item == q))[:k]
        out += [(q, d, i + 1, -s) for i, (s, d) in enumerate(some)]
    return sorted(out)


@pytest.mark.parametrize(("seed", "threshold", "k", "sample"), [(0, 0.5, 10, 2_000), (1, 0.3, 5, 40), (2, 0.9, 3, 20), (3, 0.1, 1_000, 10)])
def test_equals_the_scalar_form(spark, seed, threshold, k, sample):
    rows, queries = _rows(spark, seed), spark.createDataFrame(QUERIES, "item long, t array<string>")
    got = postings.best(rows, queries, "item", "doc_id", threshold, k, sample=sample).collect()
    assert sorted((r.item, r.doc_id, r.rank, round(r.score, 6)) for r in got) == _plain(rows, queries, threshold, k)


def test_no_nested_loop_and_hot_terms_find_no_candidates(spark):
    """A term that every row has is joined by no query that has rarer ones enough."""
    rows = spark.range(3_000).select(F.col("id").alias("doc_id"), F.struct(F.array(F.lit("hot"), F.concat(F.lit("t"), F.col("id") % 50)).alias("tags"), F.array(F.concat(F.lit("t"), F.col("id") % 50)).alias("objects"), F.array().cast("array<string>").alias("description"), F.array().cast("array<string>").alias("folder")).alias("parts"))
    queries = spark.createDataFrame([(i, ["hot", f"t{i}"]) for i in range(5)], "item long, t array<string>")
    found = postings.best(rows, queries, "item", "doc_id", 0.5, 20)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    got = found.collect()
    assert len(got) == 100 and all(r.doc_id % 50 == r.item and round(r.score, 6) == 1.3 for r in got)


def test_edges(spark):
    rows, queries = _rows(spark, 5, 5), spark.createDataFrame(QUERIES, "item long, t array<string>")
    assert postings.best(rows.limit(0), queries, "item", "doc_id", 0.5, 3).count() == 0
    assert postings.best(rows, queries.limit(0), "item", "doc_id", 0.5, 3).count() == 0
    with pytest.raises(ValueError):
        postings.best(rows, queries, "item", "doc_id", 0.0, 3)
