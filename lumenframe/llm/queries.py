"""Driver queries of the subpackage: one for each operator, over whole tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, cover_tree, decontaminate, hard_negatives, mixing, packing, pii, quality, secrets, simhash, token_counts, url_filter, warc
from ._util import load


def vocabulary(name: str) -> str:
    """A public vocabulary file; ``LUMENFRAME_TOKENIZERS`` names another folder."""
    if folder := os.environ.get("LUMENFRAME_TOKENIZERS"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(load(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find_pii(load(spark, sf_dir, "documents")))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.decontaminate(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark")))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(simhash.near_duplicates(load(spark, sf_dir, "documents")))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.find_secrets(load(spark, sf_dir, "documents")))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(load(spark, sf_dir, "pages"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(load(spark, sf_dir, "pages"))


def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.exact_topk(load(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(load(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(load(spark, sf_dir, "documents"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(load(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(load(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label=moved)


QUERIES = {
    f.__name__: f
    for f in (
        op1_token_counts, op2_pii, op3_quality, op4_decontaminate, op5_simhash, op6_secrets, op7_warc, op8_url_filter, op9_exact_topk, op10_packing,
        op11_mixing, op12_collocations, op13_hard_negatives,
    )
}

#: Where SQL can say it; the others are tested against plain models in tests/llm.
ORACLES = {
    "op4_decontaminate": decontaminate.ORACLE, "op7_warc": warc.ORACLE, "op8_url_filter": url_filter.ORACLE, "op9_exact_topk": cover_tree.ORACLE,
    "op11_mixing": mixing.ORACLE, "op12_collocations": collocations.ORACLE, "op13_hard_negatives": hard_negatives.ORACLE,
}
