"""Mixing: targets and copies against SQL, the sample against sorted ranks and its probabilities."""

import duckdb
import pytest
from pyspark.sql import functions as F

from lumenframe.llm import mixing

COLUMNS = ["doc_id", "size", "source_size", "target", "copies", "taken"]


def rows_of(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


def sql(frame):
    con = duckdb.connect()
    con.register("given", frame)
    con.execute("CREATE TABLE documents AS SELECT doc_id::BIGINT AS doc_id, text::VARCHAR AS text, source::VARCHAR AS source FROM given")
    found = con.execute(mixing.ORACLE)
    names = [d[0] for d in found.description]
    return sorted((tuple(r[names.index(c)] for c in COLUMNS) for r in found.fetchall()), key=str)


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_equals_sql_and_meets_the_targets(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = rows_of(mixing.mix(docs))
    assert got == sql(docs.select("doc_id", "text", "source").toPandas())
    assert got == rows_of(mixing.mix(docs.repartition(7)))  # whatever the partitioning
    by = {}
    for _, size, source_size, target, copies, taken in got:
        assert taken == copies * size and copies <= 2 and target <= 2 * source_size
        by.setdefault((source_size, target), []).append((taken, size))
    for (source_size, target), some in by.items():
        # ten documents a source: as near as the choice of whole documents allows
        rest, off = target % source_size, sum(t for t, _ in some) - target
        sizes, sums = [s for _, s in some], {0}
        for s in sizes:
            sums |= {x + s for x in sums}
        assert abs(off) <= min(abs(x - rest) for x in sums) + 0.05 * target + min(s for s in sizes if s)


CASES = {
    "nulls, empty texts, repeated rows": [(None, None, None), (None, "a b", None), (1, "", "x"), (1, "a b c", "x"), (1, "a b c", "x"), (2, " \t\n", "é"), (3, "one two", "é"), (3, "one two", "é"), (4, "x " * 20_000, "y")],
    "a source of nothing": [(1, "", "a"), (2, "a b c d e f g h", "b"), (3, None, "a"), (4, "a b c d", "c")],
    "one small source is full": [(i, "w " * 50, "big") for i in range(40)] + [(100, "a b", "a"), (101, "a", "a"), (102, "c d e", "z")],
    "one source": [(i, "w " * (i + 1), "s") for i in range(30)],
    "hot source": [(i, "w " * (1 + i % 9), "hot" if i % 3 else f"s{i % 8}") for i in range(300)],
}


@pytest.mark.parametrize("name", CASES)
def test_cases_equal_sql(spark, name):
    docs = table(spark, CASES[name]).withColumns({c: F.lit(1) for c in ("size", "class", "id", "u", "whole", "target", "drawn", "inclusion")})
    got = rows_of(mixing.mix(docs))
    assert got == sql(docs.select("doc_id", "text", "source").toPandas())
    assert len(got) == len(CASES[name]) and all(t == 0 for _, s, *_, t in got if s == 0)


def test_empty_table(spark):
    assert mixing.mix(table(spark, [])).count() == 0


def test_sample_is_the_least_ranks(spark):
    """Fixed sizes, the least ranks of each stratum, and inclusion as often as the probabilities say."""
    profile = [0.05, 0.1, 0.2, 0.35, 0.5, 0.5, 0.65, 0.8, 0.9, 0.95, 0.0, 1.0]  # adds up to 6
    strata = 500
    rows = [(s, i, p) for s in range(strata) for i, p in enumerate(profile)] + [(None, i, 0.3) for i in range(3_000)]
    df = spark.createDataFrame(rows, "s long, i long, p double").withColumn("u", mixing.uniform(F.lit(7), F.col("s"), F.col("i")))
    got = mixing.pareto_sample(df, ["s"], "p", "u", ["i"]).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.s, []).append(r)
    for s, some in by.items():
        wanted = 6 if s is not None else 900
        assert sum(r.drawn for r in some) == wanted
        ranks = sorted((0.0 if r.p == 1 else float("inf") if r.p == 0 else r.u / (1 - r.u) / (r.p / (1 - r.p)), r.i) for r in some)
        assert {r.i for r in some if r.drawn} == {i for _, i in ranks[:wanted]}
    for i, p in enumerate(profile):
        often = sum(r.drawn for r in got if r.s is not None and r.i == i) / strata
        assert abs(often - p) <= 4.5 * (p * (1 - p) / strata) ** 0.5 + 0.01


def test_only_the_border_is_sorted(spark):
    """Of a stratum of 40,000 rows the window sees a few hundred."""
    df = spark.range(40_000).select(F.lit("s").alias("s"), F.col("id").alias("i"), F.lit(0.4).alias("p"), mixing.uniform(F.lit(1), F.col("id")).alias("u"))
    got = mixing.pareto_sample(df, ["s"], "p", "u", ["i"])
    assert got.where("drawn").count() == 16_000
    rank = (F.col("u") / (1 - F.col("u"))) / (0.4 / 0.6)
    scale = (40_000 * 0.24) ** 0.5
    per_bin = df.select(F.floor((rank - 1) * scale * mixing.FINE).alias("b")).where(F.abs("b") < mixing.BINS).groupBy("b").count()
    assert per_bin.agg(F.max("count")).first()[0] < 200


def test_no_python_and_no_texts_beyond_the_first_map(spark, sf):
    plan = mixing.mix(spark.read.parquet(f"{sf}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "text" not in plan


def test_classes_are_sixteenths_of_octaves(spark):
    got = spark.range(1, 5000).select("id", mixing.size_class(F.col("id")).alias("c")).collect()
    by = {}
    for r in got:
        by.setdefault(r.c, []).append(r.id)
    assert [r.c for r in got] == sorted(r.c for r in got)
    assert all(max(v) < 1.0625 * min(v) for v in by.values() if min(v) >= 16)
