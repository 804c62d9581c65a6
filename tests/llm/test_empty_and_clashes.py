"""Empty tables, and tables with clashing extra columns, through every operator."""

import pytest
from pyspark.sql import functions as F

from lumenframe.llm import collocations, cover_tree, decontaminate, hard_negatives, mixing, packing, pii, quality, queries, secrets, simhash, token_counts, url_filter, warc

CLASHES = ("base", "extra", "spans", "fp", "least", "root", "node", "component_id", "hits", "items", "n_words", "start", "length", "part", "rank", "score", "x", "q", "rule", "stem", "digest", "first_id", "record_type", "at", "__x", "__part", "__at", "__row", "__spans", "__new", "__digest", "__best", "__n", "__h", "__i", "_c0", "bits")


def _clashing(df):
    return df.withColumns({c: F.lit("clash") for c in CLASHES if c not in df.columns})


@pytest.fixture(scope="module")
def tables(spark, sf):
    return {t: _clashing(spark.read.parquet(f"{sf}/{t}.parquet").limit(20)) for t in ("documents", "pages", "embeddings", "benchmark")} | {"labels": spark.read.parquet(f"{sf}/labels.parquet")}


OPERATORS = {
    "token_counts": lambda t: token_counts.token_counts(t["documents"], queries.vocabulary("byte_bpe_50k.tiktoken")),
    "pii": lambda t: pii.digest(pii.find_pii(t["documents"])),
    "redact": lambda t: pii.redact(t["documents"]),
    "quality": lambda t: quality.score(t["documents"], t["labels"]),
    "select": lambda t: quality.select(t["documents"], t["labels"]),
    "decontaminate": lambda t: decontaminate.digest(decontaminate.decontaminate(t["documents"], t["benchmark"])),
    "drop_contaminated": lambda t: decontaminate.drop_contaminated(t["documents"], t["benchmark"]),
    "simhash": lambda t: simhash.digest(simhash.near_duplicates(t["documents"])),
    "keep_one": lambda t: simhash.keep_one(t["documents"]),
    "secrets": lambda t: secrets.digest(secrets.find_secrets(t["documents"])),
    "warc": lambda t: warc.round_trip(t["pages"]),
    "url_filter": lambda t: url_filter.judge_urls(t["pages"]),
    "cover_tree": lambda t: cover_tree.exact_topk(t["embeddings"], F.col("vec_id") % 10 == 0),
    "mixing": lambda t: mixing.mix(t["documents"]),
    "collocations": lambda t: collocations.collocations(t["documents"], least=2),
    "hard_negatives": lambda t: hard_negatives.mine(t["embeddings"], F.col("vec_id") % 5 == 0),
    "packing": lambda t: packing.pack(t["documents"], queries.vocabulary("byte_bpe_50k.json")),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_clashing_columns(tables, name):
    assert OPERATORS[name](tables).count() > 0


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_tables(tables, name):
    assert OPERATORS[name]({k: v.limit(0) for k, v in tables.items()}).count() == 0
