"""Phrases against the plain model, SQL, and the stack against plain counts."""

from collections import Counter

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumenframe.llm import collocations


def found(docs, **options):
    return sorted(tuple(r) for r in collocations.collocations(docs, **options).collect())


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("xy"), st.lists(st.sampled_from("abc"), max_size=3), st.integers(1, 3)), max_size=30), st.integers(1, 4))
def test_stack_counts_all_prefixes(rows, least):
    want = Counter()
    for lang, words, n in rows:
        for k in range(len(words) + 1):
            want[lang, tuple(words[:k])] += n
    stack, got = collocations.Stack(least), []
    for lang, words, n in sorted(rows, reverse=True):
        got.extend(stack.push(lang, words, n))
    got.extend(stack.close())
    assert {(a, tuple(w)): n for a, w, n in got} == {k: n for k, n in want.items() if n >= least or len(k[1]) < 2}
    assert len(got) == len({(a, tuple(w)) for a, w, _ in got})


def test_equals_the_model_on_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.lang, r.text) for r in docs.collect()]
    want = collocations.brute(rows)
    assert want and found(docs) == want
    # a bitmap so small that nearly every bit is set prunes nothing and changes nothing
    assert found(docs.repartition(5), bits=15) == want
    assert found(docs, top=20) == collocations.brute(rows, top=20)


def test_longer_phrases_and_other_limits(spark):
    text = "In the end, in the END of it all. of it all we see the end of it; "
    rows = [("en", text * 9), ("de", "a b c d e " * 7), (None, "x y z " * 6), ("und", "x y " * 3)]
    docs = spark.createDataFrame(rows, "lang string, text string").select("text", "lang")
    for options in ({"max_n": 4, "least": 3, "inside": 50}, {"max_n": 2, "least": 5, "inside": 1}, {"max_n": 5, "least": 2, "inside": 100}, {"max_n": 3, "least": 4, "inside": 90}):
        assert found(docs, **options) == collocations.brute(rows, **options)


AWKWARD = ["", None, " \t ", "....", "one", "A b\tC d.", "é😀 ünï é😀 ünï", "\x00\x01 \x00\x01", "x" * 50_000, "lorem ipsum dolor " * 3_000, "a a a a a a a a a a a a a", "p\x0bq\x0cr\rs", "p q r s " * 12, "\xa0   \xa0   " * 6]


def test_awkward_texts_repeated_rows_and_clashing_names(spark):
    rows = [(lang, t) for t in AWKWARD for lang in ("en", None, "und", "fr")] + [("en", "p q r s " * 12)] * 3
    docs = spark.createDataFrame([(*r, 1) for r in rows], "lang string, text string, n int").withColumns({c: F.lit("clash") for c in ("words", "a", "l", "r", "score", "phrase", "rank", "at", "count")})
    assert found(docs) == collocations.brute(rows)


def test_empty_table(spark):
    assert found(spark.createDataFrame([], "lang string, text string")) == []


def test_sql_says_the_same(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    cur = con.execute(collocations.ORACLE)
    names = [d[0] for d in cur.description]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = collocations.collocations(docs)
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(cur.fetchall())


def test_scores_beyond_64_bits_are_exact(spark):
    """The products of large counts, in the decimals that the scores use."""
    a, l, r = 3_000_000_007, 4_000_000_009, 5_000_000_021
    whole = {c: f"cast({v}L as decimal(18,0))" for c, v in (("a", a), ("l", l), ("r", r))}
    got = spark.sql(f"SELECT (cast(1000000 as decimal(38,0)) * ({whole['a']} * {whole['a']})) div ({whole['l']} * {whole['r']}) AS s").first().s
    assert got == 1_000_000 * a * a // (l * r)


@pytest.mark.parametrize("bits", [15, 26])
def test_bitmaps_hold_every_frequent_phrase(spark, sf, bits):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("text", F.coalesce("lang", F.lit("und")).alias("lang"))
    maps = [spark.sparkContext.broadcast(collocations._frequent(docs, 1, [], bits, 10))]
    for n in (2, 3):
        maps.append(spark.sparkContext.broadcast(collocations._frequent(docs, n, maps, bits, 10)))
    counts = {(r.lang, tuple(r.words)): r.n for r in collocations.suffixes(docs, 3, maps, bits).groupBy("lang", "words").agg(F.sum("n").alias("n")).collect()}
    prefixes = Counter()
    for (lang, w), n in counts.items():
        for k in range(len(w) + 1):
            prefixes[lang, w[:k]] += n
    for lang, _, phrase, a, *_ in collocations.brute([(r.lang, r.text) for r in docs.collect()], inside=10**9):
        assert prefixes[lang, tuple(phrase.split(" "))] == a
    if bits == 26:  # few chance marks: positions that begin no frequent word give empty suffixes
        assert sum(n for (_, w), n in counts.items() if not w) > 0
