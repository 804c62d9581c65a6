"""Secret scan: base rules plus multipart credential linking.

Base rules (``assign``, ``access``, ``hex``) are matched leftmost and non
overlapping for each kind over whole texts; failing matches are dropped
without a retry.  Beside them the scan collects weak parts of credentials:
access identifiers (``client_id``, ``user``, ``account`` ... with a value),
secret-like strings (whole runs of 20 or more letters, digits and ``+/_-``
that mix two of the classes lower, upper and digit, without a keyword) and
endpoints (URLs with a host, ``host = ...``).  No part has a greatest length.
Each part has a scope, the
``scope`` code points around it; an interval join of the three kinds by scope
reports a weak candidate only where a complementary part stands in its scope:
a weak secret needs an identifier (or access key) and an endpoint, an
identifier or endpoint is reported with such a secret, or with an ``assign``
or ``hex`` span, which is a secret without any complement.

Parts of a document meet only each other, so the join is a sweep over the
document's sorted parts: linear in text and reported spans, no shuffle.  Two
parts are in each other's scope when at most ``scope`` code points lie
between them.

Defined cases: null text is empty and gives no spans; an empty table gives no
rows; offsets are code points, end exclusive;
weak parts that overlap a base span are that span and only complement others;
repeated rows are scanned row by row; extra columns are ignored.
"""

from __future__ import annotations

import bisect
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _util

KINDS = ("assign", "access", "hex")
WEAK = ("identifier", "weak_secret", "endpoint")
#: Base spans that are secrets themselves.
STRONG = ("assign", "hex")


def _either(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_KEYWORD = "|".join(map(_either, ("password", "passwd", "secret", "token"))) + "|" + _either("api") + "_?" + _either("key")
_RULES = {
    "assign": re.compile(rf"(?:{_KEYWORD})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "hex": re.compile(r"[0-9a-f]{24,}"),
}
_PARTS = {
    "identifier": re.compile(r"\b(?:client_?id|user(?:name)?|login|account(?:_?id)?|access_?id)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9@._-]{3,}", re.A | re.I),
    # a whole run of at least two of the classes lower, upper and digit, behind a blank, a quote, "=" ...
    "weak_secret": re.compile(r"(?<![A-Za-z0-9+/_-])(?![a-z+/_-]*+(?![A-Z0-9]))(?![A-Z+/_-]*+(?![a-z0-9]))(?![0-9+/_-]*+(?![A-Za-z]))[A-Za-z0-9+/_-]{20,}+={0,2}+(?![A-Za-z0-9+/_=-])"),
    "endpoint": re.compile(r"(?<![A-Za-z0-9_+])[a-z][a-z0-9+]++://[A-Za-z0-9.-]+(?::[0-9]+)?|\b(?:host|endpoint|server)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9.-]{3,}", re.A),
}
Span = tuple[int, int, str]


def base_spans(text: str) -> list[Span]:
    out = []
    for m in _RULES["assign"].finditer(text):
        if m.end(1) - m.start(1) >= 6:
            out.append((*m.span(), "assign"))
    if "AKIA" in text:
        out += [(*m.span(), "access") for m in _RULES["access"].finditer(text) if m.end() - m.start() >= 20]
    out += [(*m.span(), "hex") for m in _RULES["hex"].finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def weak_parts(text: str) -> list[Span]:
    return sorted((*m.span(), k) for k, rule in _PARTS.items() for m in rule.finditer(text))


def link(base: list[Span], parts: list[Span], scope: int) -> list[Span]:
    """Weak candidates whose scope holds the complementary parts."""
    free = set(_outside(parts, base))
    # access keys among the base spans and parts that overlap a base span complement, but are reported already
    points = {k: [(a, b) for a, b, kind in parts if kind == k] for k in ("identifier", "endpoint")}
    access = [(a, b) for a, b, k in base if k == "access"]
    ends = {k: [b for _, b in p] for k, p in points.items()}
    access_ends = [b for _, b in access]

    def near(p: list[tuple[int, int]], e: list[int], a: int, b: int) -> list[tuple[int, int]]:
        """Parts within ``scope`` of [a, b): a range, as parts of a kind don't overlap and both their sides ascend."""
        return p[bisect.bisect_left(e, a - scope) : bisect.bisect_left(p, (b + scope + 1,))]

    found: set[Span] = set()
    secrets = [s for s in free if s[2] == "weak_secret"] + [s for s in base if s[2] in STRONG]
    for a, b, kind in secrets:
        ids, hosts = (near(points[k], ends[k], a, b) for k in ("identifier", "endpoint"))
        if kind in STRONG or (hosts and (ids or near(access, access_ends, a, b))):
            own = {(a, b, kind)} if kind == "weak_secret" else set()
            found |= own | free.intersection([(x, y, "identifier") for x, y in ids] + [(x, y, "endpoint") for x, y in hosts])
    return sorted(found, key=lambda s: (s[0], WEAK.index(s[2])))


def _outside(parts: list[Span], base: list[Span]) -> list[Span]:
    starts, out, reach, most = [a for a, _, _ in base], [], [], 0
    for _, b, _ in base:
        most = max(most, b)
        reach.append(most)
    for a, b, k in parts:
        i = bisect.bisect_left(starts, b)
        if not i or reach[i - 1] <= a:
            out.append((a, b, k))
    return out


def scan(text: str | None, scope: int = 200) -> tuple[list[Span], list[Span]]:
    """Base spans and linked weak spans of a whole text."""
    if not text:
        return [], []
    base = base_spans(text)
    # most texts hold no secret of either kind: the other parts are then not looked for
    if not any(k in STRONG for _, _, k in base) and not _PARTS["weak_secret"].search(text):
        return base, []
    return base, link(base, weak_parts(text), scope)


_SPANS = "array<struct<start:long,end:long,kind:string,value:string>>"


def find_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", scope: int = 200) -> DataFrame:
    """``id_col, base, linked``: spans with their texts; one map, no shuffle."""

    def run(batch):
        base, linked = [], []
        for text in batch.column(1):
            text = text.as_py()
            for out, spans in zip((base, linked), scan(text, scope), strict=True):
                out.append([{"start": a, "end": b, "kind": k, "value": text[a:b]} for a, b, k in spans])
        return batch.column(0), base, linked

    return _util.arrow_map(docs.select(id_col, text_col), run, f"`{id_col}` {dict(docs.dtypes)[id_col]}, base {_SPANS}, linked {_SPANS}")


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _is(kind: str):
    return lambda s: s["kind"] == kind


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    counts = [F.size(F.filter("base", _is(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    names = F.array(*[F.lit(k) for k in (*KINDS, *WEAK)])
    order = lambda s: F.struct(s["start"].alias("start"), F.array_position(names, s["kind"]).alias("o"), s["end"].alias("end"), s["kind"].alias("kind"))
    every = F.array_sort(F.transform(F.concat("base", "linked"), order))
    return found.select(id_col, *counts, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(every).alias("spans"))


def brute_link(base: list[Span], parts: list[Span], scope: int) -> list[Span]:
    """Plain model for tests: every secret against every part, by the distance between them."""
    near = lambda x, y: max(x[0] - y[1], y[0] - x[1]) <= scope
    free = [p for p in parts if not any(p[0] < b and p[1] > a for a, b, _ in base)]
    out = set()
    for s in [p for p in free if p[2] == "weak_secret"] + [x for x in base if x[2] in STRONG]:
        ids, hosts = ([p for p in parts if p[2] == k and near(s, p)] for k in ("identifier", "endpoint"))
        keys = [x for x in base if x[2] == "access" and near(s, x)]
        if s[2] in STRONG or (hosts and (ids or keys)):
            out |= {p for p in [*ids, *hosts, *([s] if s[2] == "weak_secret" else [])] if p in free}
    return sorted(out, key=lambda s: (s[0], WEAK.index(s[2])))


def brute_base(text: str | None) -> list[Span]:
    """Plain model for tests: the base rules as they are stated."""
    out = []
    for m in re.finditer(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text or "", re.A | re.I):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end(), "assign"))
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text or "") if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text or "") if len(m[0]) >= 24]
    return [(a, b, k) for a, _, b, k in sorted(out)]
