"""Personal data: base rules plus bootstrapped contextual extraction, in DataFrame functions only.

Base rules give the seed entities (email, ip, card, phone), leftmost and non
overlapping for each kind over whole texts; matches that fail their check are
dropped without a retry.  A lexical pattern is the word before an entity.
The bipartite graph of patterns and instances (identifier-like values with
digits) is scored for ``rounds`` rounds: a pattern's confidence is the summed
score of its instances over *all* occurrences of its word in the corpus, its
support the summed score of its distinct instances, and it is accepted with
``min_confidence`` and ``min_seeds`` of them.  An instance's score is 1 for a
seed, else the confidence of its best accepted pattern, else 0: what a round discovers
supports the patterns of the next, so an identifier may be ``rounds`` steps from a
seed.  Identifier-like values that overlap an entity are that entity and count
once.  Identifiers behind the patterns that the last round accepts become spans of the kind
``context``; base spans are never changed.

A word is a run of letters, marks and digits (with underscores before a
letter) together with a quote and ``:`` or ``=`` that directly follow; between
it and its value stand other signs or blanks, or nothing.  Patterns and totals
are cut by this one rule, so ``id: X``, ``id=X`` and ``"id":"X"`` all count.
A run that goes on into the value is no word.

The patterns below are the base rules with start conditions and possessive or
lazy loops that make them linear and free of recursion in the JVM's regex
engine; their matches are those of the plain rules.

Defined cases: null text is empty; empty text has no spans; offsets are code
points, end exclusive; repeated rows are judged row by row, and their values
count once as distinct seeds; extra columns are ignored by ``find_pii`` and
kept by ``redact``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._util import held, materialise, places, plain, restored, returned

KINDS = ("email", "ip", "card", "phone")
CONTEXT = "context"
_W = "A-Za-z0-9._%+-"
_L = "A-Za-z0-9-"
PATTERNS = {
    "email": rf"(?:(?<![{_W}])|\G)[{_W}]++@[{_L}]++\.[{_L}][{_L}.]*?(?!\.?[{_L}])",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9][ -]?[0-9][0-9 -]*?(?![ -]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    # identifier-like: a run of these signs that holds a digit
    "candidate": r"(?<![A-Za-z0-9._/-])[A-Za-z._/-]*+[0-9][A-Za-z0-9._/-]*+",
}
#: Words before values, and what may stand between; possessive, hence linear.
_R = r"\p{L}\p{M}\p{N}"
WORD = rf"(?<![{_R}])[{_R}]++(?:_++(?=\p{{L}})[{_R}]++)*+(?:[\"']?+[:=])?+"
_BEFORE = rf"({WORD})[^{_R}]*+$"
#: A text without the sign can't match.
_NEEDS = {"email": "@", "phone": "+"}
#: Hash buckets of the words that are counted.
BUCKETS = 1 << 20
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_SPAN = "struct<start:long,kind:int,end:long,value:string,word:string,at:long,to:long>"
#: Strides of a running fold by doubling; an array has fewer than 2^31 elements.
_STRIDES = tuple(1 << k for k in range(31))


def _none() -> Column:
    return F.expr(f"cast(array() as array<{_SPAN}>)")


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, though the body uses it in lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _running(items: Column, step) -> Column:
    """Running folds over an array in n log n, by doubling.

    ``step(x, before, after)`` merges an element with those one stride before
    and behind it, which are null beyond the ends.
    """

    def double(acc: Column, d: Column) -> Column:
        return F.when(d < F.size(acc), F.transform(acc, lambda x, i: step(x, F.get(acc, i - d), F.get(acc, i + d)))).otherwise(acc)

    return F.aggregate(F.array(*map(F.lit, _STRIDES)), items, double)


def _word_before(gap: Column, hit: Column, first: Column) -> Column:
    """The last word of the gap; none where a run of the text goes on over either end of it."""
    word = F.when(first, F.regexp_extract(gap, _BEFORE, 1)).otherwise(F.regexp_extract(gap, "(?!^)" + _BEFORE, 1))
    glued = (gap.rlike(rf"[{_R}]$") & hit.rlike(rf"^[{_R}_]")) | (gap.rlike("_$") & hit.rlike(r"^\p{L}"))
    return F.when(glued, "").otherwise(F.lower(word))


def _occurrences(text: Column, kind: str, number: int) -> Column:
    """All matches with the word before, offsets in code points (start, end) and in bytes (at, to)."""
    pattern = F.lit(PATTERNS[kind])
    pairs = F.arrays_zip(F.split(text, PATTERNS[kind], -1).alias("gap"), F.regexp_extract_all(text, pattern, F.lit(0)).alias("hit"))

    def size(x: Column) -> Column:
        chars, octets = ((f(x["gap"]) + f(x["hit"])).cast("long") for f in (F.length, F.octet_length))
        return F.struct(x["gap"].alias("gap"), x["hit"].alias("hit"), chars.alias("end"), octets.alias("to"))

    def step(x: Column, before: Column, _: Column) -> Column:
        return F.struct(x["gap"].alias("gap"), x["hit"].alias("hit"), (x["end"] + F.coalesce(before["end"], F.lit(0))).alias("end"), (x["to"] + F.coalesce(before["to"], F.lit(0))).alias("to"))

    def span(x: Column, i: Column) -> Column:
        start, at = x["end"] - F.length(x["hit"]), x["to"] - F.octet_length(x["hit"])
        word = _word_before(x["gap"], x["hit"], i == 0)
        return F.struct(start.alias("start"), F.lit(number).alias("kind"), x["end"].alias("end"), x["hit"].alias("value"), word.alias("word"), at.alias("at"), x["to"].alias("to"))

    found = F.transform(_running(F.transform(F.filter(pairs, lambda x: x["hit"].isNotNull()), size), step), span)
    quick = F.contains(text, F.lit(_NEEDS[kind])) if kind in _NEEDS else text.rlike("[0-9]")
    return F.when(quick, found).otherwise(_none())


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike("^" + r"\.".join([_OCTET] * 4) + "$")
    if kind == "card":
        digits = _digits(value)
        return F.length(digits).between(12, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    if kind == "candidate":
        return F.length(_digits(value)) >= 4
    return F.lit(True)


def _check(kind: str):
    return lambda x: _valid(kind, x["value"])


def _is(kind: str):
    return lambda s: s["kind"] == kind


def _base(text: Column) -> Column:
    """Base spans and candidates of a text in order of start, then kind.

    A candidate that overlaps a base span is that span, and counts once: with
    all spans in order, it is met by the farthest end of the base spans up to
    it or by the start of the next one.
    """
    spans = F.array_sort(F.concat(*[F.filter(_occurrences(text, k, i), _check(k)) for i, k in enumerate((*KINDS, "candidate"))]))
    never = F.lit((1 << 63) - 1)

    def reach(s: Column) -> Column:
        return F.struct(s.alias("s"), F.when(s["kind"] < len(KINDS), s["end"]).otherwise(F.lit(0)).alias("reach"), F.when(s["kind"] < len(KINDS), s["start"]).otherwise(never).alias("ahead"))

    def step(x: Column, before: Column, after: Column) -> Column:
        return F.struct(x["s"].alias("s"), F.greatest(x["reach"], before["reach"]).alias("reach"), F.least(x["ahead"], after["ahead"]).alias("ahead"))

    free = lambda x: (x["s"]["kind"] < len(KINDS)) | ((x["reach"] <= x["s"]["start"]) & (x["ahead"] >= x["s"]["end"]))
    return F.transform(F.filter(_running(F.transform(spans, reach), step), free), lambda x: x["s"])


def _text(text_col: str) -> Column:
    return F.coalesce(F.col(text_col).cast("string"), F.lit(""))


def _totals(docs: DataFrame, text_col: str, support: DataFrame) -> DataFrame:
    """All occurrences of the words that may find support, over all documents.

    Words are cut before they are shuffled by a broadcast set of hash buckets,
    ``BUCKETS`` numbers at most whatever the corpus; what falls into the
    bucket of such a word by chance goes in the join after it.
    """
    mark = lambda w: F.xxhash64(w).bitwiseAND(F.lit(BUCKETS - 1))
    marks = support.select(mark("word").alias("mark")).distinct()
    words = docs.select(F.explode(F.regexp_extract_all(_text(text_col), F.lit(WORD), F.lit(0))).alias("w")).select(F.lower("w").alias("w"))
    words = words.join(F.broadcast(marks), mark("w") == F.col("mark"), "left_semi").groupBy("w").agg(F.count("*").alias("total"))
    return words.join(support, F.col("w") == F.col("word")).select("word", "total")


def _patterns(found: DataFrame, docs: DataFrame, text_col: str, rounds: int, min_confidence: float, min_seeds: int) -> DataFrame:
    """Words that the last round accepts."""
    spans = found.select(F.explode("__spans").alias("s"))
    edges = spans.where("s.word <> ''").groupBy(F.col("s.word").alias("word"), F.col("s.value").alias("value")).agg(
        F.count("*").alias("n"), F.max((F.col("s.kind") < len(KINDS)).cast("double")).alias("seed")
    )
    edges = materialise(edges)
    # scores are 1 at most, so a word with fewer values can't get the support
    known = materialise(edges.groupBy("word").agg(F.count("*").alias("values")).where(F.col("values") >= min_seeds))
    words = materialise(_totals(docs, text_col, known))
    edges = materialise(edges.withColumnRenamed("word", "ew").join(words, F.col("ew") == F.col("word")).select("word", "value", "n", "seed", "total"))
    # a value is a seed behind any of these words if it is one behind some
    scored = edges.groupBy(F.col("value").alias("iv")).agg(F.max("seed").alias("score"))
    told = F.least(F.lit(1.0), F.sum(F.col("n") * F.col("score")) / F.first("total")).alias("confidence")
    for i in range(rounds):
        patterns = edges.join(scored, F.col("value") == F.col("iv")).where("score > 0").groupBy("word").agg(told, F.sum("score").alias("support"))
        patterns = materialise(patterns.where((F.col("confidence") >= min_confidence) & (F.col("support") >= min_seeds)).select(F.col("word").alias("accepted"), "confidence"))
        if i + 1 < rounds:
            reached = edges.join(patterns, F.col("word") == F.col("accepted"), "left")
            scored = materialise(reached.groupBy(F.col("value").alias("iv")).agg(F.greatest(F.max("seed"), F.coalesce(F.max("confidence"), F.lit(0.0))).alias("score")))
    return patterns.select("accepted")


def _find(docs: DataFrame, columns: list[str], text_col: str, rounds: int, min_confidence: float, min_seeds: int) -> DataFrame:
    """``columns``, ``__spans`` (base and candidates) and ``__new`` (accepted candidates) of every row."""
    found = held(places(docs.select(*columns, _base(_text(text_col)).alias("__spans"))))
    accepted = _patterns(found, found if text_col in columns else docs, text_col, rounds, min_confidence, min_seeds)
    candidates = found.select("__part", "__at", F.explode(F.filter("__spans", lambda s: s["kind"] == len(KINDS))).alias("s"))
    extra = candidates.join(accepted, F.col("s.word") == F.col("accepted"), "left_semi")
    extra = extra.groupBy("__part", "__at").agg(F.array_sort(F.collect_list("s")).alias("__new"))
    return returned(found, extra, "__new").select(*columns, "__spans", F.coalesce("__new", _none()).alias("__new"))


def find_pii(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    rounds: int = 3,
    min_confidence: float = 0.5,
    min_seeds: int = 5,
) -> DataFrame:
    """``id_col, base, extra``: arrays of ``struct<start,end,kind,value>`` in order of start, then kind.

    Counts of words and the graph cover all documents; what is shuffled are
    words that may find support, values and spans, never texts.
    """
    found = _find(docs, [id_col], text_col, rounds, min_confidence, min_seeds)
    base = F.filter("__spans", lambda s: s["kind"] < len(KINDS))
    return found.select(id_col, F.transform(base, _named).alias("base"), F.transform("__new", _named).alias("extra"))


def _kind(s: Column) -> Column:
    return F.element_at(F.array(*[F.lit(k) for k in (*KINDS, CONTEXT)]), s["kind"] + 1)


def _named(s: Column) -> Column:
    return F.struct(s["start"].alias("start"), s["end"].alias("end"), _kind(s).alias("kind"), s["value"].alias("value"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    counts = [F.size(F.filter("base", _is(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    order = lambda s: F.struct(s["start"].alias("start"), F.array_position(F.array(*[F.lit(k) for k in (*KINDS, CONTEXT)]), s["kind"]).alias("o"), s["end"].alias("end"), s["kind"].alias("kind"))
    every = F.array_sort(F.transform(F.concat("base", "extra"), order))
    return found.select(id_col, *counts, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(every).alias("spans"))


def redact(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rounds: int = 3, min_confidence: float = 0.5, min_seeds: int = 5
) -> DataFrame:
    """``docs`` with every span replaced by ``<KIND>``; overlapping spans become one, named after the first."""
    docs, (id_col, text_col), names = plain(docs, id_col, text_col)
    found = _find(docs, docs.columns, text_col, rounds, min_confidence, min_seeds)
    spans = F.array_sort(F.concat(F.filter("__spans", lambda s: s["kind"] < len(KINDS)), "__new"))
    reach = lambda s: F.struct(s["at"].alias("at"), s["to"].alias("to"), _kind(s).alias("kind"))
    farthest = lambda x, before, _: F.struct(x["at"].alias("at"), F.greatest(x["to"], before["to"]).alias("to"), x["kind"].alias("kind"))
    some = lambda b, at, to: F.substring(b, (at + 1).cast("int"), (to - at).cast("int")).cast("string")

    def cut(octets: Column, spans: Column) -> Column:
        def piece(x: Column, i: Column) -> Column:
            before = F.coalesce(F.get(spans, i - 1)["to"], F.lit(0))
            return F.when(x["at"] >= before, F.concat(some(octets, before, x["at"]), F.lit("<"), F.upper(x["kind"]), F.lit(">"))).otherwise("")

        end = F.element_at(spans, -1)["to"]
        return F.concat(F.array_join(F.transform(spans, piece), ""), some(octets, end, F.octet_length(octets)))

    whole = F.col(text_col).cast("string").cast("binary")
    clean = _let(whole, lambda octets: _let(_running(F.transform("__all", reach), farthest), lambda s: cut(octets, s)))
    # written as a column of its own, so that the sort isn't repeated wherever the spans are used
    done = found.withColumn("__all", spans)
    done = done.withColumn("__clean", F.when(F.size("__all") > 0, clean))
    done = done.withColumn(text_col, F.coalesce("__clean", F.col(text_col)))
    if n_chars := names.get("n_chars"):
        done = done.withColumn(n_chars, F.coalesce(F.length("__clean").cast("long"), F.col(n_chars)))
    return restored(done, names)


def brute_base(text: str | None) -> list[tuple[int, int, str]]:
    """Plain model for tests: the base rules as they are stated."""
    import re

    rules = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }

    def luhn(d: str) -> bool:
        return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0

    out = []
    for k, rule in enumerate(rules):
        for m in re.finditer(rules[rule], text or ""):
            d = "".join(c for c in m[0] if c in "0123456789")
            ok = {
                "email": lambda: True,
                "ip": lambda: all(int(p) <= 255 for p in m[0].split(".")),
                "card": lambda: 12 <= len(d) <= 19 and luhn(d),
                "phone": lambda: 9 <= len(d) <= 15,
            }[rule]()
            if ok:
                out.append((m.start(), k, m.end(), rule))
    return [(a, b, r) for a, _, b, r in sorted(out)]
