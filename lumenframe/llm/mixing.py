"""Mixing sources to target weights by Pareto order sampling, in DataFrame functions only.

Sources in code point order, null last, weigh ``weights``, repeating.  They
share ``share`` times all words by weight; none gets more than ``most`` times
its own words, and what it can't take is shared again among the others.  A
source's target over its words gives every document the same expected number
of copies: the whole part is allocated as certain copies, the rest is a
sample.

The sample is laid out by size class (sixteenths of an octave), from the longest
documents to the shortest: each class gets a whole number of documents, the
words that this rounding leaves over or short go to the next class.  Rounding
is random, so no class is favoured, as long as the shorter documents can make
up for it.  The inclusion probability of a document
is the share of its class that is drawn, and differs between classes.

``pareto_sample`` draws the fixed-size samples: a document ranks by its random
odds ``u / (1 - u)`` over its inclusion odds ``p / (1 - p)``, and the least
ranks of a stratum are drawn.  The rank at which a stratum is cut lies at 1,
within a few times ``1 / sqrt(sum p (1 - p))``.  So the ranks around 1 are
counted in bins of that scale, and only the rows of the bin that holds the cut
are sorted: about the square root of the stratum, whatever share of the corpus
it holds.  What falls beyond the bins is in the first or the last one, and cut
as exactly.

The random numbers come from a digest of the seed, the id and the size, so
reruns agree, whatever the partitioning.

Defined cases: a null or empty text has size 0, of which nothing is taken;
null ids are drawn like others; repeated rows are rows of their own, and those
of equal id and size, which have equal ranks, are drawn one after the other; a
null source is a source, the last; a source without words has target 0; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._util import materialise

WORD = r"[^\x20\x09-\x0D]+"
#: Bins of ranks on either side of 1, and how many make one standard deviation of the number of ranks below 1.
BINS, FINE = 64, 4
#: A digest's first 13 hexadecimal digits as a number between 0 and 1.
_DIGITS, _STEPS = 13, 1 << 52


def uniform(*parts: Column) -> Column:
    """A number between 0 and 1, both excluded, that depends on the values alone."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return (F.conv(F.substring(F.md5(text), 1, _DIGITS), 16, 10).cast("double") + 0.5) / F.lit(float(_STEPS))


def pareto_sample(rows: DataFrame, strata: Sequence[str], inclusion: str, random: str, ties: Sequence[str] = ()) -> DataFrame:
    """``rows`` and ``drawn``: fixed-size samples of unequal probabilities, one of each stratum.

    ``inclusion`` is a row's probability from 0 to 1; rows of 1 are always
    drawn, rows of 0 never.  A stratum's sample has as many rows as the
    probabilities add up to, rounded.  ``random`` lies between 0 and 1.
    ``rows`` is read several times and should be a stored table.
    """
    p, u = F.col(inclusion), F.col(random)
    open_ = (p > 0) & (p < 1)
    rank = (u / (1 - u)) / (p / (1 - p))
    names = [f"__s{i}" for i in range(len(strata))]
    sizes = rows.where(open_).groupBy(*[F.col(s).alias(n) for s, n in zip(strata, names, strict=True)]).agg(F.floor(F.sum(p) + 0.5).alias("__n"), F.sqrt(F.sum(p * (1 - p))).alias("__scale"))
    sizes = materialise(sizes)

    def with_strata(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
        same = [F.col(s).eqNullSafe(F.col(n)) for s, n in zip(strata, names, strict=True)]
        return left.join(right, same, how)

    at = F.floor(F.least(F.greatest((F.col("__rank") - 1) * F.col("__scale") * FINE, F.lit(-float(BINS))), F.lit(float(BINS)))).cast("int")
    placed = with_strata(rows.where(open_).withColumn("__rank", rank), sizes, "inner").withColumn("__bin", at)
    counts = placed.groupBy(*names, "__bin").agg(F.count("*").alias("__rows"), F.first("__n").alias("__n"))
    upto = F.sum("__rows").over(Window.partitionBy(*names).orderBy("__bin"))  # at most 2 * BINS + 1 rows in a stratum
    # the first bin that reaches the sample's size is cut, after __left of its rows
    cut = counts.withColumn("__upto", upto).where(F.col("__upto") >= F.col("__n")).groupBy(*names).agg(
        F.min(F.struct("__bin", (F.col("__n") - F.col("__upto") + F.col("__rows")).alias("left"))).alias("__cut")
    ).select(*names, F.col("__cut.__bin").alias("__cut"), F.col("__cut.left").alias("__left"))
    cut = materialise(sizes.withColumnsRenamed({n: f"_{n}" for n in names}).join(cut, [F.col(f"_{n}").eqNullSafe(F.col(n)) for n in names]).select(*names, "__scale", "__cut", "__left"))
    found = with_strata(rows.where(open_).withColumn("__rank", rank), cut, "left").withColumn("__bin", at)
    sure = found.where(F.col("__bin").isNull() | (F.col("__bin") != F.col("__cut"))).select(*rows.columns, F.coalesce(F.col("__bin") < F.col("__cut"), F.lit(False)).alias("drawn"))
    order = Window.partitionBy(*strata).orderBy("__rank", *ties)
    border = found.where(F.col("__bin") == F.col("__cut")).withColumn("__place", F.row_number().over(order)).select(*rows.columns, (F.col("__place") <= F.col("__left")).alias("drawn"))
    return rows.where(~open_ | p.isNull()).withColumn("drawn", F.coalesce(p >= 1, F.lit(False))).unionByName(sure).unionByName(border)


def numbered(values: DataFrame, *order: Column) -> DataFrame:
    """``values`` with ``place`` from 0: sorted in ranges, and counted range by range."""
    placed = materialise(values.orderBy(*order).withColumn("__id", F.monotonically_increasing_id()))
    part, at = F.shiftright("__id", 33), F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    before, starts = 0, []
    for r in placed.groupBy(part.alias("part")).count().orderBy("part").collect():  # one row for each range
        starts.append((r["part"], before))
        before += r["count"]
    ranges = values.sparkSession.createDataFrame(starts, "__part long, __before long")
    return placed.join(F.broadcast(ranges), part == F.col("__part")).select(*values.columns, (F.col("__before") + at).alias("place"))


def targets(sizes: DataFrame, weights: Sequence[int], share: float, most: int) -> DataFrame:
    """``source, n, source_size, target`` of ``source, n, source_size``."""
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    known = materialise(numbered(sizes, F.asc_nulls_last("source")).withColumn("weight", weight))
    total = known.agg(F.sum("source_size"), F.sum("weight")).first()
    words, weight = share * (total[0] or 0), total[1] or 0
    left, per, full = words, weight, 0
    while per:  # each round fills at least one more source
        over = F.lit(left) * F.col("weight") > F.lit(per) * most * F.col("source_size")
        now = known.where(over).agg(F.count("*"), F.sum("source_size"), F.sum("weight")).first()
        if now[0] == full:
            break
        full, left, per = now[0], words - most * now[1], weight - now[2]
    limit = (F.lit(most) * F.col("source_size")).cast("double")
    part = F.least(F.lit(left) * F.col("weight") / F.lit(float(per)), limit) if per else limit
    return materialise(known.select("source", "n", "source_size", part.alias("target")))


def size_class(size: Column) -> Column:
    """Sixteenths of an octave: the number's highest bit and the four bits after it."""
    top = (F.length(F.bin(size)) - 1).cast("int")
    return (16 * top + F.call_function("shiftright", size * 16, top).bitwiseAND(F.lit(15))).cast("int")


def layout(rows: DataFrame, wanted: DataFrame, seed: int) -> DataFrame:
    """``source, class, whole, inclusion, source_size, target``: how many copies are certain, and the share of a class that is drawn."""
    classes = rows.where("size > 0").groupBy("source", "class").agg(F.count("*").alias("docs"), F.sum("size").alias("words"))
    # a source has as many classes as sizes have sixteenths of an octave: a few hundred
    lists = classes.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("class", "docs", "words")), asc=False).alias("classes")).withColumnRenamed("source", "__source")
    plan = wanted.where("source_size > 0").join(lists, F.col("source").eqNullSafe(F.col("__source")))
    plan = plan.withColumn("whole", F.floor(F.col("target") / F.col("source_size")))
    plan = plan.withColumn("rest", (F.col("target") - F.col("whole") * F.col("source_size")) / F.col("source_size"))
    rest = F.col("rest")

    def step(acc: Column, c: Column) -> Column:
        due, after, mean = rest * c["words"] + acc["carry"], acc["left"] - c["words"], c["words"] / c["docs"]
        # so many that the shorter documents can make up for the rounding; if none can, the nearest number
        low, high = F.ceil((due - (1 - rest) * after) / mean), F.floor((due + rest * after) / mean)
        by_chance = F.floor(due / mean + uniform(F.lit(seed), F.col("source"), c["class"]))
        drawn = F.when(low > high, F.floor(due / mean + 0.5)).otherwise(F.least(F.greatest(by_chance, low), high))
        drawn = F.least(F.greatest(drawn, F.lit(0)), c["docs"])
        done = F.struct(c["class"].alias("class"), (drawn.cast("double") / c["docs"]).alias("inclusion"))
        return F.struct((due - drawn * mean).alias("carry"), after.alias("left"), F.concat(acc["out"], F.array(done)).alias("out"))

    start = F.struct(F.lit(0.0).alias("carry"), F.col("source_size").alias("left"), F.expr("cast(array() as array<struct<class:int,inclusion:double>>)").alias("out"))
    each = plan.withColumn("out", F.aggregate("classes", start, step, lambda a: a["out"]))
    return materialise(each.select("source", "source_size", "target", "whole", F.explode("out").alias("c")).select("source", "source_size", "target", "whole", "c.class", "c.inclusion"))


def mix(
    docs: DataFrame,
    *,
    weights: Sequence[int] = (3, 1, 2),
    share: float = 1.5,
    most: int = 2,
    seed: int = 42,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """``id_col, size, source_size, target, copies, taken`` of every row; ``taken`` is ``copies`` times ``size``.

    Texts are read once and never shuffled; what is joined and sorted after
    that is an id, a source and a size.
    """
    size = F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), size.alias("size"))
    rows = materialise(rows.withColumn("class", F.when(F.col("size") > 0, size_class(F.col("size")))))
    sizes = materialise(rows.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("source_size")))
    wanted = targets(sizes, weights, share, most)
    plan = layout(rows, wanted, seed).withColumnsRenamed({"source": "p_source", "class": "p_class"})
    drawn_from = rows.where("size > 0").join(plan, F.col("source").eqNullSafe(F.col("p_source")) & (F.col("class") == F.col("p_class"))).drop("p_source", "p_class")
    drawn_from = materialise(drawn_from.withColumn("u", uniform(F.lit(seed), F.col("id"), F.col("size"))))
    copies = pareto_sample(drawn_from, ["source", "class"], "inclusion", "u", ["id", "size"])
    copies = copies.select("id", "size", "source_size", "target", (F.col("whole") + F.col("drawn").cast("long")).alias("copies"))
    # a source of empty texts has no class
    bare = rows.where("size = 0").join(wanted.select(F.col("source").alias("p_source"), "source_size", "target"), F.col("source").eqNullSafe(F.col("p_source")))
    copies = copies.unionByName(bare.select("id", "size", "source_size", "target", F.lit(0).cast("long").alias("copies")))
    return copies.select(F.col("id").alias(id_col), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


ORACLE = """
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, [3, 1, 2][1 + ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::INTEGER] AS w FROM d GROUP BY source
), fill AS (
  -- sources by what they can take for their weight: those before the first that isn't full are full
  SELECT *, 1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(2 * source_size) OVER before, 0) AS rest,
         sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS per
  FROM s WINDOW before AS (ORDER BY source_size * 6 // w RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), level AS (
  SELECT rest::DOUBLE AS rest, per::DOUBLE AS per FROM fill WHERE rest * w <= 2 * source_size * per ORDER BY source_size * 6 // w LIMIT 1
), t AS (
  SELECT source, source_size, least(rest * w / per, (2 * source_size)::DOUBLE) AS target FROM s, level
), c AS (
  SELECT *, 16 * e + (((size * 16) >> e) & 15) AS class FROM (SELECT *, (length(bin(size)) - 1)::BIGINT AS e FROM d WHERE size > 0)
), k AS (
  SELECT source, class, count(*)::DOUBLE AS docs, sum(size)::BIGINT AS words, row_number() OVER (PARTITION BY source ORDER BY class DESC) AS i FROM c GROUP BY source, class
), p AS (
  SELECT k.*, source_size, target, floor(target / source_size) AS whole, (target - floor(target / source_size) * source_size) / source_size AS rest, words / docs AS mean,
         coalesce(sum(words) OVER (PARTITION BY k.source ORDER BY class DESC ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0)::DOUBLE AS after,
         (('0x' || substr(md5('42:' || coalesce(k.source, 'null') || ':' || class), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u
  FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source WHERE source_size > 0
), f AS (
  SELECT DISTINCT source, 0::BIGINT AS i, 0::DOUBLE AS carry, 0::BIGINT AS drawn FROM p
  UNION ALL
  SELECT source, i, due - drawn * mean, drawn FROM (
    SELECT *, least(greatest(CASE WHEN low > high THEN floor(due / mean + 0.5) ELSE least(greatest(floor(due / mean + u), low), high) END, 0), docs)::BIGINT AS drawn FROM (
      SELECT *, ceil((due - (1 - rest) * after) / mean) AS low, floor((due + rest * after) / mean) AS high FROM (
        SELECT p.*, p.rest * p.words + f.carry AS due FROM f JOIN p ON p.i = f.i + 1 AND p.source IS NOT DISTINCT FROM f.source
      )
    )
  )
), r AS (
  SELECT c.doc_id, c.size, p.source_size, p.target, p.whole, f.drawn,
         row_number() OVER (PARTITION BY c.source, c.class ORDER BY md5('42:' || coalesce(c.doc_id::VARCHAR, 'null') || ':' || c.size)[1:13], c.doc_id, c.size) AS place
  FROM c JOIN p ON c.source IS NOT DISTINCT FROM p.source AND c.class = p.class
         JOIN f ON f.source IS NOT DISTINCT FROM p.source AND f.i = p.i
)
SELECT doc_id, size, source_size, target, whole::BIGINT + (place <= drawn)::BIGINT AS copies, size * (whole::BIGINT + (place <= drawn)::BIGINT) AS taken FROM r
UNION ALL
SELECT doc_id, size, source_size, target, 0, 0 FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source WHERE size = 0
"""
