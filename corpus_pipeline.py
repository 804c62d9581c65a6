"""The training-data pipeline over ``documents``: quality, near copies, benchmark, personal data, packing.

Every stage takes ``(spark, docs, sf_dir)``; all but the last return the
columns of ``docs``.  The driver writes each stage's rows as Parquet and
reads them again for the next; ``run`` does the same in the shared folder.

Defined cases, for all stages: an empty table gives no rows; a null text is an
empty one; texts are processed whole; ids may be null or repeat, and equal
rows are rows of their own, of which only the near-copy stage drops any;
columns besides ``doc_id`` and ``text`` may have any name and stay as they are
(but for ``n_chars``, which the redaction sets anew).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumenframe.llm import decontaminate, packing, pii, quality, simhash
from lumenframe.llm._util import load, materialise
from lumenframe.llm.queries import vocabulary


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier accepts.

    A null or empty text is scored by the bias alone; rows of equal text get
    equal verdicts; without labels of two grades all rows stay.
    """
    return quality.select(docs, load(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each SimHash component: that with the least id, and of those the one read first.

    Texts without words are one component; rows without an id come last; an
    id that repeats with different texts keeps one row of each component.
    """
    return simhash.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no window of a benchmark item; texts without words and empty benchmarks hit nothing."""
    return decontaminate.drop_contaminated(docs, load(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, personal data replaced by the name of its kind; a null text stays null."""
    return pii.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all rows in sequences of 1024 tokens; a null or empty text is its end token alone."""
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", keep_quality),
    ("SimHash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("PII", redact_personal_data),
    ("packing", pack_sequences),
]

#: No stage but the benchmark one can be said in SQL; tests hold the stages against plain models.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialise(docs)
    return docs
