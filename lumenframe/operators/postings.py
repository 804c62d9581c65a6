"""Tag search by postings: queries meet rows only through the terms that they share.

Every row gives a posting for each of its distinct terms, with the parts
(tags, objects, description, folder) that hold it; the score of a row is the
weighted count of the terms that it shares with a query in each part.  Only postings of terms
that some query has are kept.

Most rows that share a term share only frequent ones.  So every query gets a
floor first: the kth best score within a bounded sample of rows, which no kth
best of all rows is below.  Its most frequent terms, as long as the most that they
could add up to stays below the floor (or the threshold), can't make a result by themselves:
they are not joined.  The other, rarer terms find the candidates by an
equi-join on the term; candidates alone are then scored in full, by an
equi-join on the row.  Postings of a hot term are salted, so no task holds all of them.

Defined cases: a query without terms and a row without terms find nothing;
scores are unbounded above; a threshold of 0 or less is an error, as rows
without a shared term would be results; equal scores go by the row's key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.functions.text import SEMANTIC_WEIGHTS, parts_score
from lumenframe.operators.tiles import least_hashed
from lumenframe.storage import stored

PARTS = ("tags", "objects", "description", "folder")
#: Groups that the postings of a term are dealt into.
SALTS = 32


def of_rows(rows: DataFrame, key: str, used: DataFrame) -> DataFrame:
    """``key, term`` and for each part whether it holds the term, of rows ``key, parts`` and the terms ``u``."""
    def named(part: str) -> Column:
        return F.transform(F.array_distinct(F.col("parts")[part]), lambda t: F.struct(t.alias("term"), F.lit(part).alias("part")))

    listed = F.flatten(F.array(*map(named, PARTS)))
    each = rows.select(key, F.explode(listed).alias("x")).select(key, "x.term", "x.part").join(used, F.col("term") == F.col("u"), "left_semi")
    return each.groupBy(key, "term").agg(*[F.max((F.col("part") == p).cast("int")).alias(p) for p in PARTS])


def _score(weights) -> Column:
    """The sum in the order of the parts, as the scalar form has it."""
    total = F.lit(0.0)
    for weight, p in zip(weights, PARTS, strict=True):
        total = total + F.lit(weight) * F.col(p)
    return total


def _scored(pairs: DataFrame, query_key: str, key: str, weights) -> DataFrame:
    summed = pairs.groupBy(query_key, key).agg(*[F.sum(p).alias(p) for p in PARTS])
    return summed.select(query_key, key, _score(weights).alias("score"))


def best(rows: DataFrame, queries: DataFrame, query_key: str, key: str, threshold: float, k: int, *, weights=SEMANTIC_WEIGHTS, sample: int = 2_000) -> DataFrame:
    """The k best rows (``key, parts``) of every query (``query_key, t``: its terms): ``query_key, key, score, rank``."""
    if threshold <= 0:
        raise ValueError("a threshold of 0 or less would make a result of every row")
    asked = stored(queries.select(query_key, F.explode(F.array_distinct("t")).alias("term")).where("term is not null"))
    used = asked.select(F.col("term").alias("u")).distinct()
    n = rows.count()
    held = stored(of_rows(rows, key, used))  # cut to the queries' terms before anything is shuffled
    some = least_hashed(held.select(F.col(key).alias("s")).distinct(), "s", sample, n)
    few = held.join(F.broadcast(some), F.col(key) == F.col("s"), "left_semi")
    first = _scored(asked.join(few.withColumnRenamed("term", "pt"), F.col("term") == F.col("pt")), query_key, key, weights)
    order = Window.partitionBy("f_query").orderBy(F.desc("score"))
    floors = first.select(F.col(query_key).alias("f_query"), "score").withColumn("at", F.row_number().over(order)).where(F.col("at") == k).select("f_query", F.col("score").alias("floor"))
    # how often terms occur, and the most that one adds: postings are salted, so a hot term is no task's
    salt = F.pmod(F.xxhash64(key), F.lit(SALTS))
    terms = held.groupBy("term", salt.alias("salt")).agg(F.count("*").alias("rows"), F.max(_score(weights)).alias("most")).groupBy(F.col("term").alias("t_term")).agg(F.sum("rows").alias("rows"), F.max("most").alias("most"))
    told = asked.join(terms, F.col("term") == F.col("t_term")).join(floors, F.col(query_key) == F.col("f_query"), "left")
    # scores round to six places before they are compared, so a floor is taken a little lower
    floor = F.greatest(F.coalesce("floor", F.lit(0.0)), F.lit(float(threshold))) - 2e-6
    upto = F.sum("most").over(Window.partitionBy(query_key).orderBy(F.desc("rows"), "term"))
    terms_of = stored(told.withColumn("rare", upto >= floor).select(query_key, "term", "rare"))
    rare = terms_of.where("rare").select(query_key, F.col("term").alias("q_term"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("q_salt"))
    found = held.join(rare, (F.col("term") == F.col("q_term")) & (salt == F.col("q_salt"))).groupBy(query_key, key).agg(F.count("*").alias("shared"))
    candidates = found.select(F.col(query_key).alias("c_query"), F.col(key).alias("c_key"))
    # all terms of a candidate's row that its query has
    wide = held.groupBy(F.col(key).alias("w_key")).agg(F.struct(*[F.collect_list(F.when(F.col(p) == 1, F.col("term"))).alias(p) for p in PARTS]).alias("held"))
    queried = terms_of.groupBy(F.col(query_key).alias("z_query")).agg(F.collect_set("term").alias("all"))
    whole = candidates.join(wide, F.col("c_key") == F.col("w_key")).join(queried, F.col("c_query") == F.col("z_query"))
    scored = whole.select(F.col("c_query").alias(query_key), F.col("c_key").alias(key), parts_score(F.col("all"), F.col("held"), weights).alias("score")).where(F.col("score") >= threshold)
    order = Window.partitionBy(query_key).orderBy(F.desc(F.round("score", 6)), key)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
