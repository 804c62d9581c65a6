"""Both joins of the URL filter give the same rows; the measured size picks between them."""

import pytest

from lumenframe.llm import url_filter

ODD = (("a.com", "/x", "block"), ("a.com", "/x", "allow"), ("com", "", "block"), ("a.com", "/xy/z", "allow"), ("org", "/a/b/", "block"), ("b.org", "/a/b/c", "allow"))
URLS = [None, "", "http://a.com/xy", "http://a.com/xy/z1", "http://b.com", "http://b.org/a/b/c/d", "http://c.org/a/b/x?y", "x://org/a/b/", "http://COM", "ftp://a.b.c.d.org/a/bb"]


@pytest.mark.parametrize("rules", [url_filter.RULES, ODD, ()])
def test_lookups_equal_the_salted_join(spark, sf, rules):
    made = spark.createDataFrame(list(enumerate(URLS, 10_000)) + [(10_000, "http://a.com/xy")], "page_id long, url string")
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url").unionByName(made)
    small, large = url_filter.judge_urls(pages, rules), url_filter.judge_urls(pages, rules, broadcast_bytes=-1, salts=3)
    assert sorted(map(str, small.collect())) == sorted(map(str, large.collect()))
    assert small.count() == pages.count()


def test_equal_rules_block_wins(spark):
    p = spark.createDataFrame([(1, "http://a.com/x1")], "page_id long, url string")
    assert url_filter.judge_urls(p, ODD).first().verdict == "block"


def test_plans(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    text = lambda df: df._jdf.queryExecution().executedPlan().toString()
    small = text(url_filter.judge_urls(pages))
    assert "BroadcastHashJoin" in small and "Generate" not in small and "SortMergeJoin" not in small
    assert all("__path" not in line for line in small.splitlines() if "Exchange" in line)
    assert "__salt" in text(url_filter.judge_urls(pages, broadcast_bytes=-1))
