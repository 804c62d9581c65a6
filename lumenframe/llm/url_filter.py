"""URL filter: host suffixes and path prefixes, joined with the rules on short hash prefixes.

Every URL is expanded into the suffixes of its host (whole labels) and the
prefixes of its path (up to each slash); expressions equi-join the rules on
the first hex digits of their SHA-256, full digests confirm, and of the rules
that fit, the longest host and path together wins (then the longer host).
Only shapes (label count, slash count) that some rule has are expanded, so a
URL gives at most as many expressions as there are shapes, however long it is.

A rule's path may end anywhere: it is joined by its part up to the last slash
and confirmed as a prefix of the whole path.

Defined cases: null URL, or none with ``://``, has empty host and path and
the default verdict; a rule fits its host and all subdomains; repeated rows
are judged row by row; of equal rules with different verdicts block wins;
without rules, or in an empty table, there is nothing to join and every row
has the default; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (host, path, verdict)
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
DEFAULT = "allow"


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    url = F.coalesce(url, F.lit(""))
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def _stem(path: str) -> str:
    return path[: path.rfind("/") + 1]


def _shapes(rows: list[tuple]) -> list[tuple[int, int]]:
    """(labels of the host, slashes of the path) that rules have."""
    return sorted({(h.count(".") + 1, _stem(p).count("/")) for h, p, _ in rows})


def _digest(labels: int, slashes: int) -> Column:
    """Digest of one expression of the URL; null where its host or path is shorter."""
    n_labels = F.length("__host") - F.length(F.translate("__host", ".", "")) + 1
    n_slashes = F.length("__path") - F.length(F.translate("__path", "/", ""))
    head = F.concat(F.substring_index("__path", "/", slashes), F.lit("/")) if slashes else F.lit("")
    return F.when((n_labels >= labels) & (n_slashes >= slashes), F.sha2(F.concat(F.substring_index("__host", ".", -labels), head), 256))


def judge_urls(
    pages: DataFrame,
    rules=RULES,
    *,
    id_col: str = "page_id",
    url_col: str = "url",
    default: str = DEFAULT,
    prefix_digits: int = 8,
    broadcast_bytes: int = 8 << 20,
    salts: int = 32,
) -> DataFrame:
    """``id_col, host, path, rule, verdict`` of every row.

    The rules are given by the caller as a list, so their size is measured:
    up to ``broadcast_bytes`` they are broadcast, and each shape of an
    expression (label count, slash count) is one lookup join that moves no
    URL.  Larger lists are joined by one salted equi-join of all expressions:
    a digest that very many URLs share (``com/``) is dealt into ``salts``
    keys, and the rules are repeated for each.
    """
    rows = [(str(h), str(p), str(v)) for h, p, v in rules]
    table = _rule_table(pages.sparkSession, rows, prefix_digits)
    host, path = parts(F.col(url_col))
    work = pages.select(F.col(id_col).alias("__id"), host.alias("__host"), path.alias("__path"))
    size = sum(len(x.encode()) for row in rows for x in row) + 128 * len(rows)
    if size <= broadcast_bytes:
        found = _by_lookups(work, F.broadcast(table), _shapes(rows), prefix_digits)
    else:
        found = _by_salted_join(work, table, _shapes(rows), prefix_digits, salts)
    return found.select(
        F.col("__id").alias(id_col), F.col("__host").alias("host"), F.col("__path").alias("path"),
        F.col("__best.rule").alias("rule"), F.coalesce("__best.verdict", F.lit(default)).alias("verdict"),
    )


def _rule_table(spark, rows: list[tuple], prefix_digits: int) -> DataFrame:
    """One row for each digest: its key, and the rules with that stem in order of precedence."""
    made = [(h, p, h + p, h + _stem(p), v) for h, p, v in rows]
    table = spark.createDataFrame(made, "host string, path string, rule string, stem string, verdict string")
    weight = F.struct(F.length("rule").alias("n"), F.length("host").alias("h"), F.when(F.col("verdict") == "block", 1).otherwise(0).alias("b"), "rule", "verdict", "path")
    table = table.groupBy(F.sha2("stem", 256).alias("__rule_digest")).agg(F.collect_list(weight).alias("__rules"))
    return table.withColumn("__rule_key", F.substring("__rule_digest", 1, prefix_digits))


def _fitting(rules: Column) -> Column:
    """The best rule of a stem that the whole path confirms."""
    return F.array_max(F.filter(rules, lambda r: F.startswith(F.col("__path"), r["path"])))


def _by_lookups(work: DataFrame, table: DataFrame, shapes: list[tuple[int, int]], prefix_digits: int) -> DataFrame:
    columns, best = work.columns, []
    for i, shape in enumerate(shapes):
        own = table.select(*[F.col(c).alias(f"{c}{i}") for c in ("__rule_key", "__rule_digest", "__rules")])
        work = work.withColumn("__digest", _digest(*shape))
        match = (F.substring("__digest", 1, prefix_digits) == F.col(f"__rule_key{i}")) & (F.col("__digest") == F.col(f"__rule_digest{i}"))
        work = work.join(own, match, "left").withColumn(f"__best{i}", _fitting(F.col(f"__rules{i}"))).select(*columns, *[b for b in best], f"__best{i}")
        best.append(f"__best{i}")
    top = F.greatest(*best) if len(best) > 1 else F.col(best[0]) if best else F.lit(None).cast("struct<rule:string,verdict:string>")
    return work.select(*columns, top.alias("__best"))


def _by_salted_join(work: DataFrame, table: DataFrame, shapes: list[tuple[int, int]], prefix_digits: int, salts: int) -> DataFrame:
    work = work.withColumn("__row", F.monotonically_increasing_id())
    digests = F.filter(F.array(*[_digest(*s) for s in shapes]), lambda d: d.isNotNull())
    work = work.withColumn("__digest", F.explode_outer(digests)).withColumn("__salt", F.pmod("__row", F.lit(salts)))
    table = table.withColumn("__rule_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    match = (F.substring("__digest", 1, prefix_digits) == F.col("__rule_key")) & (F.col("__digest") == F.col("__rule_digest")) & (F.col("__salt") == F.col("__rule_salt"))
    joined = work.join(table, match, "left").withColumn("__fits", _fitting(F.col("__rules")))
    first = [F.first(c).alias(c) for c in ("__id", "__host", "__path")]
    return joined.groupBy("__row").agg(*first, F.max("__fits").alias("__best"))


ORACLE = r"""
WITH u AS (
  SELECT page_id, CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN '' ELSE substr(url, strpos(url, '://') + 3) END AS rest FROM pages
), h AS (
  SELECT row_number() OVER () AS rn, page_id,
         translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
), r(rh, rp, v) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), j AS (
  SELECT h.*, rh || rp AS rule, v, row_number() OVER (PARTITION BY rn ORDER BY length(rh || rp) DESC, length(rh) DESC) AS k
  FROM h LEFT JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)
)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM j WHERE k = 1
"""
